"""Lines, columns, tables, headings and paragraphs from boxes.

Grouping boxes into lines depends on the order of comparisons, so it is a fold
over one page's array, in Arrow batches and without a shuffle. All that follows
is windows over (page, line).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageframe.functions.text import BULLET, NUMBERED, filled, upper_median, utf16_length

LINES = "line_no int, region_idx int, text string, x double, y double, w double, h double"


def lines_in_given_order(regions: list[dict]) -> list[list[dict]]:
    """Lines of the PDF export, which keep the order that the regions come in, column by column.

    A region joins the line before it if its top lies within 0.4 of the upper
    median of the positive heights (20 without any) of that of the line's leftmost
    region.
    """
    full = [r for r in regions if (r["text"] or "").strip() and all(r[k] is not None for k in "xywh")]
    tall = sorted(r["h"] for r in full if r["h"] > 0)
    limit = 0.4 * (tall[len(tall) // 2] if tall else 20.0)
    out: list[list[dict]] = []
    for r in full:
        if out and abs(r["y"] - out[-1][0]["y"]) <= limit:
            out[-1].append(r)
            out[-1].sort(key=lambda q: q["x"])
        else:
            out.append([r])
    return out


def _group(regions: list[dict]) -> list[list[dict]]:
    """W08 with O04: lines of regions whose tops lie within 0.4 of the upper median height."""
    valid = [r for r in regions if (r["text"] or "").strip() and all(r[k] is not None for k in "xywh")]
    if not valid:
        return []
    limit = sorted(r["h"] for r in valid)[len(valid) // 2] * 0.4

    def reading(a: dict, b: dict) -> float:
        down = a["y"] - b["y"]
        return down if abs(down) > limit else a["x"] - b["x"]

    out: list[list[dict]] = []
    for r in sorted(valid, key=cmp_to_key(reading)):
        if out:
            tops = sorted(q["y"] for q in out[-1])
            if abs(r["y"] - tops[len(tops) // 2]) <= limit:
                out[-1].append(r)
                out[-1].sort(key=lambda q: q["x"])
                continue
        out.append([r])
    return out


def group_lines(df: DataFrame, key: str, regions: str = "regions", given_order: bool = False) -> DataFrame:
    """One row a region with its line: key, ``line_no``, ``region_idx`` and the box.

    The document export puts regions in reading order; with ``given_order`` they
    stay in the order of the array, as in the PDF export. Pages of null or empty
    regions, and regions without text or box, give no row.
    """
    group = lines_in_given_order if given_order else _group
    fields = to_arrow_schema(StructType.fromDDL(f"{key} {df.schema[key].dataType.simpleString()}, {LINES}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (k, n, j, r["text"], r["x"], r["y"], r["w"], r["h"])
                for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for n, line in enumerate(group(page or []))
                for j, r in enumerate(line)
            ]
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return df.select(key, regions).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {LINES}")


def page_lines(regions: DataFrame, page: list[str]) -> DataFrame:
    """One row a line of boxes: text, left, right, top, bottom, heights, median height, mean gap, lefts, and the boxes in their order."""
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(Window.partitionBy(*page, "line_no").orderBy("region_idx"))
    items = regions.withColumn("gap", gap)
    ordered = F.sort_array(F.collect_list(F.struct("region_idx", "text", "x", "h")))
    return items.groupBy(*page, "line_no").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("text"),
        F.min("x").alias("left_edge"), F.max(F.col("x") + F.col("w")).alias("right_edge"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.sort_array(F.collect_list("h")).alias("heights"), upper_median(F.collect_list("h")).alias("median_height"), F.avg("gap").alias("mean_gap"), F.count("*").alias("n_regions"), F.transform(ordered, lambda r: r["x"]).alias("lefts"),
        F.transform(ordered, lambda r: F.struct(r["text"].alias("text"), r["h"].alias("h"))).alias("cells"),
    )


def page_median(page: list[str]) -> Column:
    """The upper median of the heights of all of a page's regions; a window of one page's lines."""
    return upper_median(F.flatten(F.collect_list("heights").over(Window.partitionBy(*page))))


def classify(lines: DataFrame, width: Column, median: Column) -> DataFrame:
    """``kind`` and ``list_number`` of each line; ``median`` is the page's, 20 if null."""
    m = F.coalesce(median, F.lit(20.0))
    text = F.trim("text")
    number = F.regexp_extract(text, NUMBERED, 1)
    kind = (
        F.when((F.col("n_regions") >= 3) & (F.col("right_edge") - F.col("left_edge") > width * 0.6) & (F.col("mean_gap") > m * 0.8), "table-row")
        .when((F.col("median_height") > m * 1.35) & (utf16_length(text) < 120), "heading")
        .when(F.regexp_like(text, F.lit(BULLET)), "bullet")
        .when(number != "", "numbered")
        .otherwise("body")
    )
    return lines.withColumn("kind", kind).withColumn("list_number", F.when(F.col("kind") == "numbered", number.cast("int")))


def validate_tables(lines: DataFrame, page: list[str]) -> DataFrame:
    """runs of table rows that are one row long, or less than half aligned, become body."""
    w = Window.partitionBy(*page).orderBy("line_no")
    table = F.col("kind") == "table-row"
    runs = lines.withColumn("run", F.sum(F.when(table & F.coalesce(F.lag(F.col("kind")).over(w) == "table-row", F.lit(False)), 0).otherwise(1)).over(w))
    before = F.lag("lefts").over(Window.partitionBy(*page, "run").orderBy("line_no"))
    pairs = F.filter(F.zip_with(before, "lefts", lambda a, b: F.abs(a - b)), lambda d: d.isNotNull())
    checked = runs.withColumn("checks", F.coalesce(F.size(pairs), F.lit(0))).withColumn("aligned", F.coalesce(F.size(F.filter(pairs, lambda d: d <= 15)), F.lit(0)))
    checked = checked.withColumn("checks", F.greatest("checks", F.lit(0))).withColumn("aligned", F.greatest("aligned", F.lit(0)))
    whole = Window.partitionBy(*page, "run")
    score = F.sum("aligned").over(whole) / F.nullif(F.sum("checks").over(whole), F.lit(0))
    kept = (F.count("*").over(whole) >= 2) & (F.coalesce(score, F.lit(0.0)) >= 0.5)
    return checked.withColumn("kind", F.when(table & ~kept, "body").otherwise(F.col("kind"))).drop("run", "checks", "aligned")


def merge_body(lines: DataFrame, page: list[str]) -> DataFrame:
    """Consecutive body lines of like indentation, height and distance as one block."""
    w = Window.partitionBy(*page).orderBy("line_no")
    was = {c: F.lag(c).over(w) for c in ("kind", "left_edge", "median_height", "bottom")}
    ratio = F.when(was["median_height"] > 0, F.col("median_height") / was["median_height"]).otherwise(1.0)
    near = F.col("top") - was["bottom"] <= F.greatest(F.lit(20.0), 1.5 * was["median_height"])
    joins = (F.col("kind") == "body") & (was["kind"] == "body") & (F.abs(F.col("left_edge") - was["left_edge"]) <= 10) & (ratio >= 0.8) & (ratio <= 1.2) & near
    blocks = lines.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("block_no", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return blocks.groupBy(*page, "block_no").agg(
        F.min("kind").alias("kind"), F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("text"), upper_median(F.collect_list("median_height")).alias("median_height"),
        F.min_by("left_edge", "line_no").alias("left_edge"), F.count("*").alias("n_lines"), F.min("list_number").alias("list_number"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "cells"))), lambda r: r["cells"])).alias("cells"),
    )


def order_by_columns(df: DataFrame, regions: str, width: str) -> DataFrame:
    """One row a region with ``column_no``, ``place`` (reading order) and ``region``.

    Regions without text are left out. A gap of over a quarter of the width
    between sorted left edges parts columns; fewer than four regions are one
    column and keep their order. A region whose centre lies in no column, left or
    right of the page, goes to the last. The steps are columns of their own, so
    that none is computed twice.
    """
    limit = F.col(width) * 0.25
    full = df.withColumn("_full", F.filter(regions, lambda r: filled(r["text"])))
    edges = full.withColumn("_edges", F.sort_array(F.transform("_full", lambda r: r["x"])))
    less = F.greatest(F.size("_edges") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("_edges", F.lit(1), less), F.slice("_edges", F.lit(2), less), lambda a, b: F.when(b - a > limit, (b + a) / 2))
    bounds = edges.withColumn("_bounds", F.when(F.size("_full") >= 4, F.filter(gaps, lambda b: b.isNotNull())).otherwise(F.array().cast("array<double>")))
    centre = lambda r: r["x"] + r["w"] / 2
    outside = lambda r: (centre(r) < 0) | (centre(r) >= F.col(width))
    column = lambda r: F.when(outside(r), F.size("_bounds")).otherwise(F.size(F.filter("_bounds", lambda b: centre(r) >= b)))
    placed = F.transform("_full", lambda r, i: F.struct(column(r).alias("column_no"), F.when(F.size("_bounds") > 0, r["y"]).otherwise(0.0).alias("down"), i.alias("was"), r.alias("region")))
    kept = [c for c in df.columns if c not in (regions, width)]
    # the outer form, as for the other Spark infers a filter on the array, for which it would be worked out once more
    flat = bounds.withColumn("_placed", F.array_sort(placed)).select(*kept, F.posexplode_outer("_placed").alias("place", "_p")).where("place is not null")
    return flat.select(*kept, "place", F.col("_p.column_no").alias("column_no"), F.col("_p.region").alias("region"))
