import pytest

from pageframe.llm.shape import ShapeModel
from pageframe.llm.truncation import ending, hidden_limits, lengths, lost_end, stops_short, text_limits, truncated_texts, truncation_shares

BODY = "The court accepts that the claim was settled before the hearing.\nThe witness recalled that it was discussed twice"


@pytest.mark.parametrize(
    "end", [".", ', "as noted."', ".\nPage 4 / 12", ".\n– 3 –", ".\n7 | Harbour Court", ".\nHARBOUR COURT, C-12/09", ".\nDelivered at Dorrigan on 4 May 2013", ".\n(a) the storage tank", ".\n1\tFee\t3%", ", once on 3 May 2012."]
)
def test_complete(end):
    assert stops_short(BODY + end) is None


@pytest.mark.parametrize("end", ["", " by the cou", ", once on 3 May 20", ". See Kestrel v Hul", ". The lower court ordered E.", "...", ". The registry ", ". Nach", " and the\nrep", ", am 25."])
def test_cut(end):
    assert (stops_short(BODY + end) is None) == (end == ", am 25." and False)


def test_blank():
    assert stops_short(None) is None and stops_short("  \n") is None


def test_lost_end():
    truth = BODY.replace("\n", " ") + " by both sides of the table. Nothing else was said about the fee."
    assert lost_end(truth, truth) == 0 and lost_end(truth[:-1], truth) == 0
    assert lost_end(truth.replace("discussed", "disc1ssed"), truth) == 0
    assert lost_end(truth[:80], truth) > 20 and lost_end(truth[:80].replace("claim", "cla1m"), truth) > 20
    assert lost_end(None, truth) == 0 and lost_end("", truth) == 0 and lost_end("x", None) == 0


def test_lengths(texts):
    df = texts([(1, 'a"&\n😀é'), (2, None), (3, "")])
    got = {r["id"]: r.asDict() for r in df.select("id", *(c.alias(k) for k, c in lengths(df["text"]).items())).collect()}
    assert got[1] == {"id": 1, "characters": 6, "utf8_bytes": 10, "utf16_units": 7, "characters_crlf": 7, "utf8_bytes_crlf": 11, "characters_json": 8, "utf8_bytes_json": 12, "characters_html": 15, "utf8_bytes_html": 19}
    assert got[2]["characters"] is None and got[3]["utf8_bytes"] == 0


WORDS = "claim court hearing witness contract notice party record table bench letter file point fee wall storage".split()


def prose(k: int, n: int = 40) -> str:
    """Distinct sentences of prose without a stop at the end."""
    words = [WORDS[(k * 7 + j * (k + 3)) % len(WORDS)] for j in range(n)]
    return f"The {k + 1000} parties of the case accept that " + " and that the ".join(words)


def test_limits_and_cases(texts):
    full = [prose(k, 12) + "." + " It was so." * (k % 9) for k in range(60)]
    rows = [(k, "a", t[: 128 if k % 2 else 999]) for k, t in enumerate(full)] + [(900, "b", None), (901, "b", ""), (902, "b", "ERROR: no"), (903, None, full[0][:90]), (903, None, full[0][:90]), (904, "b", "\n \t")]
    df = texts(rows, "id bigint, engine string, text string")
    limits = [(r["origin"], r["encoding"], r["length"], r["n"]) for r in hidden_limits(df, "engine", "text").collect()]
    assert limits == [("a", "characters", 128, 30)]
    cases = truncated_texts(df, "id", "engine", "text", ShapeModel())
    got = {r["record_id"]: r for r in cases.collect()}
    assert set(got) == {k for k in range(60) if k % 2} | {903} and all(got[k]["at_limit"] == (k != 903) for k in got)
    shares = {r["origin"]: r["truncated"] for r in truncation_shares(cases, df, "id", "engine", "text").collect()}
    assert shares == {"a": 30, "b": 0, "": 1}
    empty = texts([], "id bigint, engine string, text string")
    assert truncated_texts(empty, "id", "engine", "text", ShapeModel()).count() == 0 and hidden_limits(empty, "engine", "text").count() == 0


def test_one_encoding_a_limit(texts):
    """A limit in bytes: of the encodings, only bytes puts texts with and without accents at one length."""
    long = [prose(k).replace("accept", "accépt" if k % 3 else "accept").replace("court", "cöurt" if k % 2 else "court") for k in range(80)]
    rows = [(k, "a", t.encode()[:400].decode("utf-8", "ignore")) for k, t in enumerate(long)]
    found = [(r["encoding"], r["length"]) for r in hidden_limits(texts(rows, "id bigint, engine string, text string"), "engine", "text").collect()]
    assert found == [("utf8_bytes", 400)]
    # one text delivered often is no limit
    again = [(k, "a", long[0][:300]) for k in range(90)]
    assert hidden_limits(texts(again, "id bigint, engine string, text string"), "engine", "text").count() == 0


def test_lengths_of_junk_are_no_limit(texts):
    """Junk of lines of one width piles up at its lengths, which are no limit; prose cut at one is."""
    junk = [(k, "a", "\n".join("".join("§~#*¶<>=\\^"[(k * 7 + i * (k + n + 3)) % 10] for i in range(67)) for n in range(4))) for k in range(60)]
    df = texts(junk + [(1000 + k, "a", prose(k)[:150]) for k in range(60)], "id bigint, engine string, text string")
    assert {r["length"] for r in hidden_limits(df, "engine", "text").collect()} == {150, 271}
    assert [(r["encoding"], r["length"]) for r in text_limits(df, "id", "engine", "text", ShapeModel()).collect()] == [("characters", 150)]
    assert {r["record_id"] for r in truncated_texts(df, "id", "engine", "text", ShapeModel()).collect()} == {1000 + k for k in range(60)}


def test_limit_decides(texts):
    cited = "The court accepts that the claim was settled before the hearing in the lower court. See\nHulolberg v Branmanetti [2016] NT"
    paged = "The court accepts that the claim was settled before the hearing in the lower court.\nHulolberg v Branmanetti [2016] NT"
    numbered = "The court accepts that the claim was settled before the hearing\nPage 3"
    assert stops_short(cited) is None and stops_short(cited, True) and stops_short(paged, True) is None and stops_short(numbered, True) is None
    assert ending(cited) == "open, header" and ending(paged) == "header" and ending(numbered) == "open, number"
    rows = [(k, o, prose(k)[: len(cited)]) for k in range(200) for o in "a"] + [(k + 1000, o, prose(k + 300, 6 + k % 20) + ".") for k in range(200) for o in "ab"]
    rows += [(5000, "a", cited), (5001, "b", cited)]
    df = texts(rows, "id bigint, source string, text string")
    got = {r["record_id"] for r in truncated_texts(df, "id", "source", "text", ShapeModel()).collect()}
    assert 5000 in got and 5001 not in got and set(range(200)) <= got


def test_drifted_output_is_aligned():
    truth = "The court accepts that the claim was settled before the hearing. " * 4 + "Nothing was said about the fee of the storage tank, which both sides had seen. The bench agrees."
    noisy = truth.replace("court", "c o u r t court").replace("settled", "sett1ed and settled")[: len(truth) - 20]
    assert lost_end(noisy, truth) > 20 and lost_end(truth.replace("claim", "claim of the claim claim claim"), truth) == 0
