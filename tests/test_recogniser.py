import numpy as np
import pytest
from pyspark.sql import functions as F

from pageframe.functions import text as txt
from pageframe.operators import benchmark, recogniser, store
from pageframe.operators.pixels_numpy import Preparation, decode_png, png, prepared, resized

PAGES = "job_id string, id string, bytes binary"


@pytest.fixture
def engines(monkeypatch):
    """Engines by tier: one that doesn't start, one that fails on some pages, and one that works."""

    def failing():
        def call(pages):
            if any(p and bytes(p).startswith(b"bad") for p in pages):
                raise RuntimeError("no text")
            return [f"standard {len(p or b'')}" for p in pages]

        return call

    def broken():
        raise RuntimeError("no device")

    monkeypatch.setattr(recogniser, "ENGINES", {"mock": recogniser._mock, "premium": broken, "standard": failing, "basic": lambda: lambda pages: [f"basic {len(p or b'')}" for p in pages]})


def test_start_goes_one_step_down(engines):
    assert recogniser.start("premium")[0] == "standard" and recogniser.start("basic")[0] == "basic"
    with pytest.raises(RuntimeError, match="no device"):
        recogniser.start("premium", strict=True)
    recogniser.ENGINES["standard"] = recogniser.ENGINES["premium"]
    with pytest.raises(RuntimeError, match="no device"):
        recogniser.start("premium")  # one step, not the whole ladder
    assert recogniser.start("standard")[0] == "basic"
    recogniser.ENGINES["basic:donut"] = lambda: lambda pages: ["model"] * len(pages)
    assert recogniser.start("basic", model="donut")[1]([b""]) == ["model"] and recogniser.start("basic", model="other")[1]([b"abc"]) == ["basic 3"]


def local_recognise(pages, tier, strict=False, model=None, key="id", data="bytes", prepare=None):
    """As ``recognise``, on the driver, where the engines of a test are."""
    name, call = recogniser.start(tier, strict, model)
    rows = []
    for r in pages.select(key, data).collect():
        try:
            rows.append((r[key], name, call([prepare(r[data]) if prepare else r[data]])[0], None))
        except RuntimeError as e:
            rows.append((r[key], name, None, str(e)))
    return pages.sparkSession.createDataFrame(rows, f"{key} string, {recogniser.RECOGNISED}")


def test_failed_jobs_run_again_further_down(spark, engines, monkeypatch):
    monkeypatch.setattr(recogniser, "recognise", local_recognise)
    pages = spark.createDataFrame([("a", "a1", bytearray(b"x")), ("a", "a2", bytearray(b"bad")), ("b", "b1", None)], PAGES)
    got = {r["id"]: (r["engine"], r["text"], r["error"]) for r in recogniser.recognise_jobs(pages, "standard").collect()}
    assert got == {"a1": ("basic", "basic 1", None), "a2": ("basic", "basic 3", None), "b1": ("standard", "standard 0", None)}
    strict = {r["id"]: r["error"] for r in recogniser.recognise_jobs(pages, "standard", strict=True).collect()}
    assert strict == {"a1": None, "a2": "no text", "b1": None}
    assert recogniser.recognise_jobs(pages.limit(0), "basic").count() == 0


def test_recognise_in_tasks(spark):
    pages = spark.createDataFrame([("a", "a1", bytearray(b"xyz")), ("a", "a2", None)], PAGES)
    got = {r["id"]: (r["engine"], r["text"]) for r in recogniser.recognise(pages, "mock").collect()}
    assert got == {"a1": ("mock", "page of 3 bytes"), "a2": ("mock", "page of 0 bytes")}


def test_boost(spark, monkeypatch):
    """Low pages are read again from prepared bytes, still low ones by the basic engine; a higher rank wins, a tie keeps the first."""
    texts = {"premium": "second", "basic": "third"}
    calls = []

    def again(pages, tier, strict=False, model=None, key="id", data="bytes", prepare=None):
        ids = sorted(r[0] for r in pages.select(key).collect())
        calls.append((tier, ids, prepare(b"no image")))
        return pages.sparkSession.createDataFrame([(i, tier, texts[tier], None) for i in ids], f"{key} string, {recogniser.RECOGNISED}")

    ranks = {("p2", "second"): 0.95, ("p3", "second"): 0.5, ("p4", "second"): 0.1, ("p3", "third"): 0.5, ("p4", "third"): 0.7, ("p5", "second"): 0.3, ("p5", "third"): 0.3}

    def score(df):
        return df.sparkSession.createDataFrame([(r["id"], r["text"], ranks[r["id"], r["text"]], ranks[r["id"], r["text"]]) for r in df.collect()], "id string, text string, score double, rank double")

    monkeypatch.setattr(recogniser, "recognise", again)
    pages = spark.createDataFrame([("j", f"p{k}", None) for k in range(1, 6)], PAGES)
    results = spark.createDataFrame([("p1", "first", 0.9, 0.9), ("p2", "first", 0.85, 0.85), ("p3", "first", 0.5, 0.5), ("p4", "first", 0.2, 0.2), ("p5", None, None, None)], "id string, text string, score double, rank double")
    got = {r["id"]: r["text"] for r in recogniser.boosted(pages, results, score).collect()}
    assert got == {"p1": "first", "p2": "second", "p3": "first", "p4": "third", "p5": "second"}
    assert calls == [("premium", ["p2", "p3", "p4", "p5"], b"no image"), ("basic", ["p3", "p4", "p5"], b"no image")]


@pytest.mark.parametrize(("profile", "characters", "words"), [("premium", 0.0, 0.0), ("standard", 0.006968641114982578, 0.02), ("basic", 0.0627177700348432, 0.28)])
def test_published_rates_of_the_profiles(spark, profile, characters, words):
    rows = spark.createDataFrame([(recogniser.mock_page("premium")[0], recogniser.mock_page(profile)[0])], "e string, a string")
    r = benchmark.metrics(rows, "e", "a").first()
    assert (r["char_error_rate"], r["word_error_rate"]) == pytest.approx((characters, words), abs=1e-15)
    assert (r["char_accuracy"], r["word_accuracy"]) == pytest.approx((1 - characters, 1 - words))


@pytest.mark.parametrize(("edits", "size", "word_edits", "words", "published"), [(3, 354, 3, 58, (0.00847457627118644, 0.05172413793103448))])
def test_published_rates_of_the_live_page(spark, edits, size, word_edits, words, published):
    """The measured page isn't published as text; one of its size and edits gives its rates."""
    truth = ["w%02d" % k for k in range(words)]
    e = " ".join(truth) + "x" * (size - len(" ".join(truth)))
    read = e.split()
    for k in range(word_edits):
        read[k * 9] = "?" + read[k * 9][1:]
    assert word_edits == edits
    r = benchmark.metrics(spark.createDataFrame([(e, " ".join(read)), (e, e)], "e string, a string"), "e", "a").collect()
    assert sorted((x["char_error_rate"], x["word_error_rate"]) for x in r) == [(0.0, 0.0), pytest.approx(published)]


def test_mock_profiles():
    text, regions = recogniser.mock_page()
    assert text == " ".join(t for t, _ in regions)
    assert len(recogniser.mock_page("malformed")[1]) == 4 and recogniser.mock_page("premium")[1][2] == ("Bill To: Northwind Logistics", (48.0, 120.0, 500.0, 24.0))


def test_parameters(spark):
    urls = ["https://x.test/?engine=premium&model=nougat&strictEngine=true&forceOcr=1&preprocess=%7B%22a%22%3A1%7D", "https://x.test/?engine=mock&mockProfile=odd&preprocess=%7Ba", "https://x.test/", None]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(urls)), "k int, u string").select("k", recogniser.parameters(F.col("u")).alias("p")).orderBy("k").collect()]
    assert tuple(got[0]) == ("premium", "nougat", True, True, '{"a":1}', None) and tuple(got[1]) == ("mock", None, False, False, None, "default")
    assert tuple(got[2]) == tuple(got[3]) == (None, None, False, False, None, None)
    made = spark.range(1).select(recogniser.address(F.lit("basic"), F.lit("donut"), F.lit('{"a": 1}')), recogniser.address(F.lit("basic"), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()
    assert made[0] == "/?engine=basic&strictEngine=1&forceOcr=1&model=donut&preprocess=%7B%22a%22%3A+1%7D" and made[1] == "/?engine=basic&strictEngine=1&forceOcr=1"


def test_prepared_pages():
    rnd = np.random.default_rng(3)
    g = rnd.integers(0, 256, (20, 30), dtype=np.uint8)
    assert (decode_png(png(g)) == g).all() and (resized(g, 30, 20) == g).all()
    big = resized(g, 60, 40)
    assert big.shape == (40, 60) and big.min() >= g.min() and big.max() <= g.max() and (resized(np.full((3, 5), 7, np.uint8), 11, 2) == 7).all()
    out = decode_png(prepared(png(g), Preparation(adaptive=True, block=5), 40, 10))
    assert out.shape == (27, 40) and set(np.unique(out)) <= {0, 255}  # enlarged by 4 / 3
    assert prepared(b"no image", Preparation()) == b"no image" and prepared(None, Preparation()) is None


def test_original_files(spark):
    jobs = spark.createDataFrame([("a", bytearray(b"own")), ("b", bytearray(b"own")), ("c", None)], "id string, original binary")
    reuse = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "job_id string, reuse_original boolean")
    made = spark.createDataFrame([(k, bytearray(b"made")) for k in "abc"], "id string, made binary")
    assert {r["id"]: bytes(r["pdf"]) for r in store.original_or(jobs, reuse, made).collect()} == {"a": b"own", "b": b"made", "c": b"made"}
    assert [t.count() for t in store.cleared(jobs, reuse)] == [0, 0]
    pages = spark.createDataFrame([(1, bytearray(b"x"), "data:,eQ=="), (2, None, "data:image/png;base64,eQ=="), (3, None, "https://x.test/a.png"), (4, None, None)], "k int, b binary, u string")
    assert {r["k"]: r["v"] and bytes(r["v"]) for r in pages.select("k", store.page_bytes(F.col("b"), F.col("u")).alias("v")).collect()} == {1: b"x", 2: b"y", 3: None, 4: None}


def test_dictionary(spark):
    """The score with a list of usual words: gibberish misses it, ordinary and business text does not."""
    usual = "the of and to a in is was for on that with this be by total amount invoice number date payment due please order customer address items price we are your from our team will it has been new every work".split()
    gibberish = " ".join(f"xqzp{i}kw" for i in range(25))
    common = "This is the work that we will do for you and it has been on the list of items to be done by our new team in this week and every week of this year with the price that was due"
    business = "Invoice number 4821\nDate of the order: 2 May 2026\nPlease make the payment to the address on this invoice.\nTotal amount due is $616.07 for the items in this order.\nWe are grateful to every customer of our team.\nThe price is the amount that was due by the date on the order."
    region = "array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"
    df = spark.createDataFrame([(k, t, "ocr", 0.9, None) for k, t in (("gibberish", gibberish), ("common", common), ("business", business), ("none", ""), ("null", None))], f"k string, t string, source string, c double, r {region}")
    scored = txt.with_quality(df.withColumn("ratio", txt.dictionary_ratio(F.col("t"), usual)), "t", "source", "c", "ratio", "r")
    got = {r["k"]: (r["score"], r["flags"], r["ratio"]) for r in scored.collect()}
    assert "dictionary-miss" in got["gibberish"][1] and got["gibberish"][0] < 0.8 and got["gibberish"][2] == 0.0
    assert "dictionary-miss" not in got["common"][1] and not {"dictionary-miss", "symbol-noise"} & set(got["business"][1]) and got["business"][0] > 0.85
    assert got["none"][2] is None and got["null"][2] is None
    assert df.select(txt.dictionary_ratio(F.col("t"), []).alias("x")).where("x > 0").count() == 0
