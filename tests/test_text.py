import pytest
from pyspark.sql import functions as F

from pageframe.functions import text as txt
from pageframe.operators import benchmark

REGION = "array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return row.select(column.alias("out")).first()["out"]


def test_normalise(spark):
    assert one(spark, txt.normalise(F.col("t")), t=("  Sample   OCR\u00a0\nText  ", "string")) == "sample ocr text"


def test_utf16_length(spark):
    assert one(spark, txt.utf16_length(F.col("t")), t=("x\u0304\U0001f600", "string")) == 4


@pytest.mark.parametrize(("heights", "odd"), [([20, 20, 1, 20], True), ([40, 20, 20, 22], False), ([20, 22, 19], False), ([20, 90], False), (None, False), ([float("nan"), 20, 20, 20], False)])
def test_height_anomaly(spark, heights, odd):
    regions = None if heights is None else [("a", 0.0, 0.0, 1.0, float(h), None) for h in heights]
    assert one(spark, txt.height_anomaly(F.col("r")), r=(regions, REGION)) is odd


def quality(spark, text, source="ocr", confidence=None, ratio=None, regions=None):
    df = spark.createDataFrame([(text, source, confidence, ratio, regions)], f"text string, source string, confidence double, ratio double, regions {REGION}")
    r = txt.with_quality(df, "text", "source", "confidence", "ratio", "regions").first()
    return r["score"], r["flags"]


def test_quality(spark):
    assert quality(spark, "Invoice 1234", "pdf-text") == (0.98, [])
    assert quality(spark, "") == quality(spark, None) == (0.85 - 0.25 - 0.2, ["very-short-text", "symbol-noise"])
    assert "symbol-noise" in quality(spark, "∎∎∎ ¤¤¤ §¶", confidence=0.7)[1]
    assert quality(spark, "ok", confidence=0.8)[1] == ["very-short-text", "word-shape-anomaly"]
    words = " ".join(f"xqzp{i}kw" for i in range(25))
    assert quality(spark, words, confidence=0.9, ratio=0.0)[1] == ["layout-collapse", "dictionary-miss"]
    assert quality(spark, "a plain line of ordinary text", confidence=float("nan"))[0] == 0.85
    assert quality(spark, "a plain line of ordinary text", confidence=7.0)[0] == 1.0


def test_markup(spark):
    tagged = "<s_menu><s_nm>Latte</s_nm><s_price> $5.00</s_price></s_menu>"
    assert one(spark, txt.strip_tags(F.col("t")), t=(tagged, "string")) == "Latte\n$5.00"
    assert one(spark, txt.strip_tags(F.col("t")), t=("<b>plain</b>  text", "string")) == "plain text"
    assert one(spark, txt.strip_markup(F.col("t")), t=("# Head\n\n\n\n**bold** and *it* $x$ \\[a\nb\\]", "string")) == "Head\n\nbold and it x"


def test_data_urls(spark):
    data = bytes(range(256)) * 3
    url = one(spark, txt.data_url(F.lit("image/png"), F.col("b")), b=(bytearray(data), "binary"))
    assert url.startswith("data:image/png;base64,") and "\n" not in url
    assert bytes(one(spark, txt.data_url_bytes(F.col("u")), u=(url, "string"))) == data
    assert bytes(one(spark, txt.data_url_bytes(F.col("u")), u=("none", "string"))) == b""


@pytest.mark.parametrize(("expected", "actual", "cer", "wer"), [("Invoice 4821", "Invoice 482l", 1 / 12, 1 / 2), ("", "", 0.0, 0.0), ("", "abc", 1.0, 1.0), ("a b", "A  b", 0.0, 0.0), (None, None, 0.0, 0.0), ("ab", "", 1.0, 1.0)])
def test_rates(spark, expected, actual, cer, wer):
    r = benchmark.metrics(spark.createDataFrame([(expected, actual)], "e string, a string"), "e", "a").first()
    assert r["char_error_rate"] == pytest.approx(cer) and r["word_error_rate"] == pytest.approx(wer) and r["char_accuracy"] == pytest.approx(1 - cer)


def test_word_rate_equals_the_whole_table(spark):
    import random

    rnd = random.Random(2)

    def naive(a, b):
        t = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return t[-1][-1]

    pairs = [tuple([rnd.choice(["aa", "b", "ccc"]) for _ in range(rnd.randint(1, 8))] for _ in range(2)) for _ in range(150)]
    # many different words, and more edits than the band has
    pairs += [([f"w{k}" for k in range(60)], [f"v{k}" for k in range(50)]), ([f"w{k}" for k in range(60)], [f"w{k}" for k in range(60) if k % 2])]
    df = spark.createDataFrame([(k, " ".join(e), " ".join(a)) for k, (e, a) in enumerate(pairs * 2)], "k int, e string, a string")
    for r in benchmark.rated(df, "e", "a").collect():
        e, a = pairs[r["k"] % len(pairs)]
        assert r["word_error_rate"] == pytest.approx(naive(e, a) / len(e))
    assert benchmark.rated(df, "e", "a").count() == len(pairs) * 2


def test_many_edits_leave_the_band(spark):
    e, a = "ab" * 60, "ba" * 30
    r = benchmark.metrics(spark.createDataFrame([(e, a), (e, "x" * 200)], "e string, a string"), "e", "a").collect()
    assert sorted(x["char_error_rate"] for x in r) == [pytest.approx(60 / 120), pytest.approx(200 / 120)]


def test_messages(spark):
    catalogs = {"en": {"pages": "{n} pages", "none": "Nothing yet"}, "de": {"pages": "{n} Seiten"}}
    rows = [(1, "de-AT", "pages"), (2, "de", "none"), (3, "fr", "pages"), (4, None, "none"), (5, "EN", "other")]
    message = txt.message(txt.localised(catalogs, F.col("l"), F.col("k")), {"n": F.lit(3)})
    got = {r["i"]: r["m"] for r in spark.createDataFrame(rows, "i int, l string, k string").select("i", message.alias("m")).collect()}
    assert got == {1: "3 Seiten", 2: "Nothing yet", 3: "3 pages", 4: "Nothing yet", 5: "other"}
