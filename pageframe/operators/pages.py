"""Pages through recognition: routing, attempts, merging and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores under which a page is recognised again, prepared again, and rescued.
LOW, BOOST, RESCUE = 0.8, 0.9, 0.84
# Score and flags of a page without a result.
FALLBACK_SCORE, FALLBACK_FLAGS = 0.85 - 0.25 - 0.2, ("empty-result", "very-short-text", "symbol-noise")


def to_recognise(pages: DataFrame) -> DataFrame:
    """Pages without native text; filtered before any recogniser runs."""
    return pages.where(F.coalesce(F.col("source_kind") != "pdf-text", F.lit(True)))


def force_ocr(pages: DataFrame, force: bool) -> DataFrame:
    """P07."""
    return pages.withColumn("source_kind", F.lit("scanned")).withColumn("has_native_text", F.lit(False)) if force else pages


def needs_retry(results: DataFrame, score: str = "quality_score", below: float = LOW) -> DataFrame:
    """A null or NaN score counts as zero."""
    s = F.when(F.col(score).isNull() | F.isnan(score), 0.0).otherwise(F.col(score))
    return results.where((s < below) & (F.col("source") != "pdf-text"))


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New results stand for old ones of the same page, ranked or not."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def best_of(results: DataFrame, keys: list[str], rank: Column, order: str) -> DataFrame:
    """Of a page's results that of the highest rank; the earlier one of ties.

    A pre-aggregated maximum, not a window, so a page with very many attempts
    is no single task's sort.
    """
    columns = [c for c in results.columns if c not in keys]
    top = results.where(rank.isNotNull()).groupBy(*keys).agg(F.max(F.struct(rank.alias("_rank"), (-F.col(order)).alias("_early"), *columns)).alias("_best"))
    return top.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in columns))


def or_fallback(text: Column, score: Column, flags: Column) -> Column:
    """P25: struct of text, score and flags; those of an empty result where the text is null."""
    empty = F.struct(F.lit("").alias("text"), F.lit(FALLBACK_SCORE).alias("score"), F.array(*map(F.lit, FALLBACK_FLAGS)).alias("flags"))
    return F.when(text.isNull(), empty).otherwise(F.struct(text.alias("text"), score.alias("score"), flags.alias("flags")))


def tier(has_gpu_api: Column, has_adapter: Column) -> Column:
    """E10."""
    return F.when(~F.coalesce(has_gpu_api, F.lit(False)), "basic").when(F.coalesce(has_adapter, F.lit(False)), "premium").otherwise("standard")


#: Numbers of an order that are ranked in one task.
SPAN = 1000


def ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``rank`` (from 1) and ``total`` of each row in its key, by a whole number ``order``.

    A key may hold any share of all rows: rows are ranked within spans of
    ``SPAN`` numbers, and the counts of a key's spans, one row each, summed up
    before. Ties of key and order share a span and are ranked in any order; rows
    whose order is null come first.
    """
    spanned = rows.withColumn("_span", F.floor(F.col(order) / SPAN))
    sizes = spanned.groupBy(key, "_span").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_span")
    before = sizes.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    placed = spanned.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_span").orderBy(order)))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_of"))
    return placed.join(before, same).withColumn("rank", F.col("_before") + F.col("_row")).drop("_span", "_row", "_key", "_of", "_before")


def progress(pages: DataFrame, job: str, order: str) -> DataFrame:
    """``completed`` and ``total`` of each page in its job."""
    return ranked(pages, job, order).withColumn("completed", F.col("rank").cast("int")).drop("rank")


def cycled(pages: DataFrame, order: str, responses: list[str]) -> DataFrame:
    """The mock recogniser's answers in turn."""
    k = F.pmod(F.col("rank") - 1, F.lit(len(responses)))
    return ranked(pages, "job_id", order).withColumn("text", F.element_at(F.array(*map(F.lit, responses)), (k + 1).cast("int"))).drop("rank", "total")


def selected(pages: DataFrame, wanted: list[int], index: str = "page_index") -> DataFrame:
    """The pages of these indices; an index that no page has is passed over."""
    return pages.where(F.col(index).isin([i for i in wanted if i >= 0]))


def normalised(results: DataFrame) -> DataFrame:
    """Results as they are saved: text, regions of text and box (no confidence), source, score, flags.

    Null texts are empty, null regions and flags none.
    """
    box = lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), *(r[k].alias(k) for k in "xywh"))
    kept = [c for c in results.columns if c not in ("text", "regions", "quality_flags")]
    return results.select(
        *kept, F.coalesce("text", F.lit("")).alias("text"), F.transform(F.coalesce("regions", F.array()), box).alias("regions"), F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags")
    )


def word_regions(words: Column, line: Column) -> Column:
    """A line's recognised words on the detector's word boxes, with its confidences, if there are as many; else the line's own box.

    ``words`` are structs of x, y, w, h and confidence, ``line`` one with text too.
    """
    tokens = F.filter(F.split(F.trim(line["text"]), r"\s+"), lambda w: w != "")
    fields = ("x", "y", "w", "h", "confidence")
    each = F.zip_with(tokens, words, lambda t, w: F.struct(t.alias("text"), *(w[k].alias(k) for k in fields)))
    whole = F.array(F.struct(line["text"].alias("text"), *(line[k].alias(k) for k in fields)))
    return F.when((F.size(words) > 1) & (F.size(tokens) == F.size(words)), each).otherwise(whole)
