import random
from collections import Counter

import pytest

from pageframe.llm.scan_repair import Words, decode_page, fit_words, line_defects, paragraphs, repair_pages, repair_text

PLAIN = "The court accepts that the maintenance contract was settled before the hearing. The lower court dismissed the claim about the co-ownership agreement."
PAGE = "HARBOUR COURT, C-12/09\nThe court accep-\nts that the rnaintenance contract was settled bef¬\nore the hearing. The lower court dismissed the co-\nownership agreement.\n\nThe 1ower court about Sarn-\nrivik.\n– 3 –"


@pytest.fixture(scope="module")
def words():
    counts = {}
    for w in PLAIN.replace(".", "").split():
        counts[w] = counts.get(w, 0) + 200
    return Words(counts)


def test_defects(words):
    page = decode_page(PAGE, words)
    assert [k for k, f in enumerate(page.furniture) if f] == [0, 8]
    assert [k for k, f in enumerate(page.split) if f] == [1, 2, 6]
    assert [k for k, f in enumerate(page.misread) if f] == [2, 6]


def test_repair(words):
    assert repair_text(PAGE, words) == "The court accepts that the maintenance contract was settled before the hearing. The lower court dismissed the co-ownership agreement.\n\nThe lower court about Sarnrivik."
    assert repair_text(None, words) is None and repair_text("", words) == ""
    assert repair_text("The main tenance ofthe", words) == "The maintenance ofthe"


def test_paragraphs():
    lines = ["1. The court accepts that the claim was settled", "before the hearing.", "2. The lower court dismissed the agreement and", "the claim."]
    assert paragraphs(lines) == [[0, 1], [2, 3]]
    assert paragraphs([]) == [] and paragraphs(["", " "]) == []


def test_table(texts):
    rows = [(k, PLAIN) for k in range(100)] + [(500, "The court dismissed the mainten-\nance contract."), (500, "The court dismissed the mainten-\nance contract."), (501, None), (502, ""), (503, "x" * 200_000)]
    df = texts(rows)
    words = fit_words(df, "text")
    assert words.known("maintenance") and words.known("ownership")
    assert [tuple(r) for r in line_defects(df, "id", "text", words).collect()] == [(500, 0, "split_word")]
    got = {r["id"]: r["repaired"] for r in repair_pages(df, "id", "text", words).collect()}
    assert got[500] == "The court dismissed the maintenance contract." and got[501] is None and got[502] == "" and got[0] == PLAIN
    none = fit_words(texts([]), "text")
    assert line_defects(texts([]), "id", "text", none).count() == 0


def test_frequent_misreading():
    counts = {"where": 4000, "the": 9000, "court": 5000, "sat": 3000, "vvhere": 23, "coiirt": 15, "bear": 3000, "hear": 3000}
    words = Words(counts)
    assert words.known("vvhere") and not words.sound("vvhere") and words.sound("bear")
    page = decode_page("the court sat vvhere\nthe coiirt sat. the\nbear sat where the coii-\nrt. The court sat", words)
    assert [k for k, f in enumerate(page.misread) if f] == [0, 1, 2]
    assert page.repaired[:2] == ["the court sat where", "the court sat. the"]


def test_stretches(words):
    def fixed(text):
        page = decode_page(text + "\nthe claim.", words)
        return page.repaired[0], page.misread

    assert fixed("The rnain tenance contract") == ("The maintenance contract", [True, False])
    assert fixed("The main tenaucc contract") == ("The maintenance contract", [True, False])
    assert fixed("The main ten ance contract") == ("The maintenance contract", [False, False])
    # split, merge and confusion together
    assert fixed("The court oftbe land and the claim")[0].startswith("The court oftbe land") and not words.known("of")
    assert fixed("the maintenanceccntract was") == ("the maintenance contract was", [True, False])
    assert fixed("the claimdismisscd before") == ("the claim dismissed before", [True, False])
    assert fixed("the rnaintenancecontract was") == ("the maintenance contract was", [True, False])
    assert fixed("The court of Sarnrivik accepts") == ("The court of Sarnrivik accepts", [False, False])
    page = decode_page("The court dismissed the main-\ntenan cc contract.", words)
    assert page.split == [True, False] and page.misread == [False, True] and page.repaired[0] == "The court dismissed the maintenance"


def test_many_places():
    long = "nonintercommunicationalinitiations" + "lines" * 2
    words = Words({"indemnification": 5000, "october": 5000, long: 5000})
    assert words.taken_for("inclcmnificatiori")[0] == "indemnification"  # 3 of more than 14 places
    assert len(long) > 40 and words.taken_for(long.replace("mm", "mrn", 1))[0] == long
    assert words.taken_for("Oc+ober")[0] == "October"
    assert words.taken_for("inclcmniticatiorii") is None


def test_joint_defects():
    words = Words({"of": 9000, "the": 20000, "maintenance": 900, "contract": 1500, "judgment": 700, "court": 3000, "land": 400, "was": 5000, "given": 300, "a": 9000, "internationalisation": 900})
    assert words.known("of") and [words.decode(("oftbe",))[k][2] for k in (0, 1)] == ["of", "the"]

    def fixed(text):
        return decode_page(text + "\nthe court.", words).repaired[0]

    assert fixed("a judg ment was given") == "a judgment was given" and fixed("the court oftbe land") == "the court of the land"
    assert fixed("the rnain tenance contract") == "the maintenance contract" and fixed("the maintenanceccntract was") == "the maintenance contract was"
    # four confusions in a long word, and a word in five parts
    assert fixed("the intcmationalisatiori was") == "the internationalisation was" and fixed("the inter nat ion alis ation was") == "the internationalisation was"


PARTS = "the court accepts that a claim about notice of repair costs was settled before hearing and both sides knew it from contract which had been signed by parties in time while insurance premium maintenance agreement remained open for review under rules".split()
DEFECTS = {"o": "0", "l": "1", "e": "c", "m": "rn", "h": "b", "u": "n", "d": "cl", "w": "vv", "s": "5"}


def test_planted_defects_are_found():
    """Defects planted in clean pages, each found nineteen times of twenty, and hardly anything else."""
    rnd = random.Random(11)
    counts = Counter()
    for _ in range(3000):
        counts.update(rnd.choices(PARTS, k=60))
    words = Words(counts)
    truth, found = {k: set() for k in ("misread", "split_word", "furniture")}, {k: set() for k in ("misread", "split_word", "furniture")}
    for page in range(150):
        lines = []
        for n in range(12):
            line = [rnd.choice(PARTS) for _ in range(9)]
            if rnd.random() < 0.3:
                k = rnd.choice([k for k, w in enumerate(line) if len(w) > 4])
                places = [i for i, c in enumerate(line[k]) if c in DEFECTS]
                if places:
                    i = rnd.choice(places)
                    line[k] = line[k][:i] + DEFECTS[line[k][i]] + line[k][i + 1 :]
                    truth["misread"].add((page, n))
            lines.append(line)
        for n in range(11):
            if rnd.random() < 0.2 and len(lines[n + 1][0]) > 5 and (page, n + 1) not in truth["misread"]:
                w = lines[n + 1][0]
                lines[n].append(w[:3] + rnd.choice("-\u2010\xac\xad"))
                lines[n + 1][0] = w[3:]
                truth["split_word"].add((page, n))
        text = [" ".join(x) for x in lines] + [f"– {page + 1} –"]
        truth["furniture"].add((page, 12))
        p = decode_page("\n".join(text), words)
        for name, flags in (("misread", p.misread), ("split_word", p.split), ("furniture", p.furniture)):
            found[name] |= {(page, k) for k, f in enumerate(flags) if f}
    for name, cases in truth.items():
        both = len(cases & found[name])
        assert both >= 0.95 * len(cases) and both >= 0.98 * len(found[name]), (name, len(cases), len(found[name]), both)
