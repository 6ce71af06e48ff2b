import random
import unicodedata
from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st

from pageframe.llm.unify import lookalike_pairs, unify, unify_column


def test_forms():
    assert unify("Ｔｈｅ ﬁle​ of Ｌ­td") == "The file of Ltd"
    assert unify("café") == "café"
    assert unify("сlаіm") == "claim"
    assert unify("Москва") == "Москва"  # a word of another script stays one
    assert unify("l1 O0 Aa é e") == "l1 O0 Aa é e"
    assert unify(None) is None and unify("​­") == ""
    assert unify("STRASSE straße", fold=True) == "strasse strasse"


@given(st.text(max_size=40))
def test_applying_twice_changes_nothing(text):
    assert unify(unify(text)) == unify(text)


@given(st.text(alphabet=[chr(c) for c in range(33, 127)], max_size=30))
def test_printable_ascii_stays(text):
    assert unify(text) == text


def test_pairs_equal_brute_force(texts):
    rows = [(1, "a\nThe file"), (2, "The ﬁle\nb"), (3, "Thе file"), (3, "Thе file"), (4, "The file"), (5, "the file"), (6, None), (7, ""), (8, " \n​"), (9, "Th​e file\nThe file"), (10, "The  file")]
    seen = {i: {x for x in (t or "").split("\n")} for i, t in rows}
    brute = {
        (a, b)
        for a, b in combinations(sorted(seen), 2)
        if any(x != y and unify(x, marks=False, trim=False) == unify(y, marks=False, trim=False) and unify(x).strip() for x in seen[a] for y in seen[b])
    }
    got = [tuple(r) for r in lookalike_pairs(texts(rows), "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute and (2, 4) in brute
    assert lookalike_pairs(texts([]), "id", "text").count() == 0


# What looks alike, apart from the operator's own tables: written by hand for the test.
TWINS = {"a": "\u0430", "e": "\u0435", "o": "\u03bf", "p": "\u0440", "c": "\u0441", "x": "\u0445", "i": "\u0456", "s": "\u0455", "A": "\u0391", "T": "\u0422"}


def test_pairs_are_those_of_planted_lines(texts):
    """Lines are altered in known ways; two rows are a pair if they hold the same line in different characters."""
    rnd = random.Random(8)
    bases = [f"{a} {b} of case {n}: café costs" for n, (a, b) in enumerate([("The", "file"), ("A", "claim"), ("The", "office"), ("An", "exact copy"), ("Plain", "text")])]

    def altered(line):
        kind = rnd.randrange(6)
        if kind == 0:
            return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in line)
        if kind == 1:
            return unicodedata.normalize("NFD", line)
        if kind == 2:
            k = rnd.randrange(1, len(line))
            return line[:k] + rnd.choice("\u200b\u2060\xad\ufeff") + line[k:]
        if kind == 3:
            return line.replace(" ", rnd.choice("\xa0\u2009\u202f\u3000"), 1)
        if kind == 4:
            k = rnd.choice([k for k, c in enumerate(line) if c in TWINS])
            return line[:k] + TWINS[line[k]] + line[k + 1 :]
        return line.replace("fi", "\ufb01")

    rows, has = [], {}
    for i in range(60):
        lines = [(n, altered(bases[n]) if rnd.random() < 0.4 else bases[n]) for n in rnd.sample(range(5), 2)]
        has[i] = lines
        # near misses: another case, another accent, another figure
        rows.append((i, "\n".join([x for _, x in lines] + [f"row {i}", rnd.choice(["the file of case 0: café costs", "The file of case 0: cafe costs", "The file of case O: café costs"])])))
    brute = {(a, b) for a, b in combinations(range(60), 2) if any(m == n and x != y for m, x in has[a] for n, y in has[b])}
    got = {tuple(r) for r in lookalike_pairs(texts(rows), "id", "text").collect()}
    assert got == brute and len(brute) > 100


def test_usual_line_in_portions(texts, monkeypatch):
    """A line that most rows have, of which a few are spelt otherwise: all pairs, by portions of the rows."""
    monkeypatch.setattr("pageframe.llm.unify.PORTION", 7)
    rows = [(k, "The file\nother " + str(k)) for k in range(100)] + [(200, "Thе file"), (201, "The ﬁle"), (202, "The ﬁle")]
    got = {tuple(r) for r in lookalike_pairs(texts(rows), "id", "text").collect()}
    assert got == {(k, o) for k in range(100) for o in (200, 201, 202)} | {(200, 201), (200, 202)}


def test_column(texts):
    got = {r["id"]: r["unified"] for r in unify_column(texts([(1, None), (2, "Ａ"), (3, "")]), "id", "text").collect()}
    assert got == {1: None, 2: "a", 3: ""}
