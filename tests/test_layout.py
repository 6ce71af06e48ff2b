import pytest
from pyspark.sql import functions as F

from pageframe.functions import geometry as geo
from pageframe.operators import layout

REGION = "array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"


def page(spark, boxes, key=1):
    rows = [tuple([t, *map(float, b), None]) for t, b in boxes]
    return spark.createDataFrame([(key, rows), (99, None), (98, [])], f"page int, regions {REGION}")


def lines(spark, boxes):
    df = layout.group_lines(page(spark, boxes), "page")
    out = {}
    for r in df.orderBy("line_no", "region_idx").collect():
        out.setdefault(r["line_no"], []).append(r["text"])
    return list(out.values())


def test_group_lines(spark):
    assert lines(spark, [("A", (50, 100, 100, 20)), ("B", (160, 102, 100, 20))]) == [["A", "B"]]
    assert lines(spark, [("A", (50, 50, 200, 20)), ("B", (50, 120, 200, 20))]) == [["A"], ["B"]]
    assert lines(spark, [("B", (200, 50, 50, 20)), ("A", (50, 52, 50, 20)), ("  ", (0, 0, 9, 9))]) == [["A", "B"]]


def kinds(spark, boxes, width=1000.0):
    ls = layout.page_lines(layout.group_lines(page(spark, boxes), "page"), ["page"])
    found = layout.validate_tables(layout.classify(ls, F.lit(width), F.lit(20.0)), ["page"])
    return [(r["kind"], r["list_number"]) for r in found.orderBy("line_no").collect()]


def test_classify(spark):
    assert kinds(spark, [("Title", (50, 10, 300, 50)), ("text", (50, 100, 300, 20))]) == [("heading", None), ("body", None)]
    assert kinds(spark, [("• One", (50, 10, 300, 20)), ("- Two", (50, 60, 300, 20)), ("12) Three", (50, 110, 300, 20))]) == [("bullet", None), ("bullet", None), ("numbered", 12)]


@pytest.mark.parametrize(("second", "kind"), [((20, 300, 550, 800), "table-row"), ((120, 450, 700, 900), "body"), (None, "body")])
def test_tables(spark, second, kind):
    boxes = [("c", (x, 100, 60, 20)) for x in (20, 300, 550, 800)] + [("c", (x, 150, 60, 20)) for x in second or ()]
    assert {k for k, _ in kinds(spark, boxes)} == {kind}


def test_merge(spark):
    def blocks(boxes):
        ls = layout.classify(layout.page_lines(layout.group_lines(page(spark, boxes), "page"), ["page"]), F.lit(1000.0), F.lit(20.0))
        return [r["text"] for r in layout.merge_body(ls, ["page"]).orderBy("block_no").collect()]

    assert blocks([("Line 1", (50, 100, 300, 20)), ("Line 2", (50, 130, 300, 20)), ("Line 3", (52, 160, 300, 20))]) == ["Line 1 Line 2 Line 3"]
    assert blocks([("A", (50, 100, 300, 20)), ("B", (150, 130, 300, 20))]) == ["A", "B"]
    assert blocks([("A", (50, 100, 300, 20)), ("T", (50, 130, 300, 50)), ("B", (50, 190, 300, 20))]) == ["A", "T", "B"]


def test_columns(spark):
    boxes = [("r1", (600, 10, 100, 20)), ("l2", (20, 50, 100, 20)), ("l1", (20, 10, 100, 20)), ("r2", (600, 50, 100, 20))]
    df = page(spark, boxes).withColumn("width", F.lit(1000.0))
    got = layout.order_by_columns(df, "regions", "width").orderBy("place").collect()
    assert [r["region"]["text"] for r in got] == ["l1", "l2", "r1", "r2"]
    few = layout.order_by_columns(page(spark, boxes[:3]).withColumn("width", F.lit(1000.0)), "regions", "width").orderBy("place").collect()
    assert [r["region"]["text"] for r in few] == ["r1", "l2", "l1"]


def test_columns_outside_of_the_page(spark):
    """A centre left or right of the page is in no column and goes to the last; blank regions don't count."""
    boxes = [("r1", (600, 10, 100, 20)), ("l2", (20, 50, 100, 20)), ("l1", (20, 10, 100, 20)), ("left", (-200, 5, 50, 20)), ("right", (1200, 70, 50, 20)), (" ", (300, 0, 9, 9))]
    got = layout.order_by_columns(page(spark, boxes).withColumn("width", F.lit(1000.0)), "regions", "width").orderBy("place").collect()
    last = max(r["column_no"] for r in got)
    assert {r["region"]["text"] for r in got if r["column_no"] == last} >= {"left", "right"} and [r["region"]["text"] for r in got].index("left") > [r["region"]["text"] for r in got].index("l2")
    few = [("b", (600, 10, 100, 20)), ("a", (20, 10, 100, 20)), ("c", (20, 90, 100, 20)), (" ", (0, 0, 9, 9)), ("", (5, 5, 9, 9))]
    got = layout.order_by_columns(page(spark, few).withColumn("width", F.lit(1000.0)), "regions", "width").orderBy("place").collect()
    assert [r["region"]["text"] for r in got] == ["b", "a", "c"] and {r["column_no"] for r in got} == {0}


def test_median_is_of_all_regions(spark):
    """One line of three high regions, two lines of one: the median of all heights is the high one, that of the lines' medians isn't."""
    boxes = [("a", (50, 10, 50, 60)), ("b", (150, 10, 50, 60)), ("c", (250, 10, 50, 60)), ("d", (50, 200, 50, 20)), ("e", (50, 300, 50, 20))]
    ls = layout.page_lines(layout.group_lines(page(spark, boxes), "page"), ["page"])
    assert [r["m"] for r in ls.select(layout.page_median(["page"]).alias("m")).collect()] == [60.0] * 3
    got = layout.classify(ls, F.lit(1000.0), layout.page_median(["page"])).orderBy("line_no").collect()
    assert [r["kind"] for r in got] == ["body"] * 3


def test_long_line_is_no_heading(spark):
    assert kinds(spark, [("x" * 119, (50, 10, 300, 50)), ("y" * 120, (50, 100, 300, 50)), ("text", (50, 200, 300, 20))]) == [("heading", None), ("body", None), ("body", None)]


def test_pdf_lines_keep_their_order(spark):
    def given(boxes):
        out = {}
        for r in layout.group_lines(page(spark, boxes), "page", given_order=True).orderBy("line_no", "region_idx").collect():
            out.setdefault(r["line_no"], []).append(r["text"])
        return list(out.values())

    # two columns at the same height stay two lines, as the next region of the first column comes between
    assert given([("l1", (20, 10, 100, 20)), ("l2", (20, 50, 100, 20)), ("r1", (600, 10, 100, 20)), ("r2", (600, 50, 100, 20))]) == [["l1"], ["l2"], ["r1"], ["r2"]]
    assert given([("b", (200, 52, 50, 20)), ("a", (50, 50, 50, 20)), (" ", (0, 0, 5, 5))]) == [["a", "b"]]
    # the leftmost region's top counts, not the first one's: 52 - 46 is under the limit of 8, 58 - 46 is not
    assert given([("b", (200, 52, 50, 20)), ("a", (50, 46, 50, 20)), ("c", (300, 58, 50, 20))]) == [["a", "b"], ["c"]]


def test_words_on_boxes(spark):
    from pageframe.operators import pages

    box = "struct<text:string,x:double,y:double,w:double,h:double,confidence:double>"
    words = [(None, 10.0 * k, 5.0, 8.0, 9.0, 0.9 - k / 10) for k in range(2)]
    rows = [(1, ("two words", 0.0, 0.0, 50.0, 9.0, 0.5), words), (2, ("three words here", 0.0, 0.0, 50.0, 9.0, 0.5), words)]
    df = spark.createDataFrame(rows, f"k int, line {box}, words array<{box}>")
    got = {r["k"]: [tuple(x) for x in r["r"]] for r in df.select("k", pages.word_regions(F.col("words"), F.col("line")).alias("r")).collect()}
    assert got == {1: [("two", 0.0, 5.0, 8.0, 9.0, 0.9), ("words", 10.0, 5.0, 8.0, 9.0, 0.8)], 2: [("three words here", 0.0, 0.0, 50.0, 9.0, 0.5)]}


def test_impossible_boxes(spark):
    inf, nan = float("inf"), float("nan")
    boxes = [("ok", (10, 10, 50, 20)), ("over", (90, 90, 50, 50)), ("nan", (0, 0, 5, nan)), ("none", (0, 0, 0, 5)), ("inf", (0, inf, 5, 5)), (" ", (1, 1, 1, 1)), ("out", (500, 0, 5, 5))]
    clean = page(spark, boxes).where("page = 1").select(F.explode(geo.clean_regions(F.col("regions"), F.lit(100.0), F.lit(100.0), True)).alias("r")).select("r.text", "r.w").collect()
    assert [tuple(r) for r in clean] == [("ok", 50.0), ("over", 10.0)]
