"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import language, leakage, residue, scan_repair, shape, tokenizer, truncation, unify
from pageframe.llm._common import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_results", "result_id", *columns)


def _scanned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/ocr_results.parquet").where("source = 'ocr'").select("result_id", *columns)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs with their engine's usual name and the fixture's true text."""
    fixtures = table(spark, sf_dir, "bench_fixtures", "name", "ground_truth")
    engine = F.regexp_replace(F.lower(F.trim("engine")), "_", "-")
    return table(spark, sf_dir, "bench_results", "bench_id", "engine", "fixture", "extracted_text").withColumn("engine", engine).join(fixtures, F.col("fixture") == F.col("name"), "left").drop("name")



# The shapes' start values serve where shapes only narrow down another operator's cases.
_START = shape.ShapeModel()


def _truncated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_texts(_pages(spark, sf_dir, "engine", "text"), "result_id", "engine", "text", _START)


def _truncated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_texts(_runs(spark, sf_dir), "bench_id", "engine", "extracted_text", _START, "ground_truth")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated page texts and benchmark outputs."""
    pages = _truncated_pages(spark, sf_dir).select(F.lit("ocr_results").alias("table_name"), "record_id")
    runs = _truncated_runs(spark, sf_dir).select(F.lit("bench_results").alias("table_name"), "record_id")
    return pages.unionByName(runs)


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden storage limits of each engine, by encoding."""
    pages = truncation.text_limits(_pages(spark, sf_dir, "engine", "text"), "result_id", "engine", "text", _START).withColumn("table_name", F.lit("ocr_results"))
    runs = truncation.text_limits(_runs(spark, sf_dir), "bench_id", "engine", "extracted_text", _START, "ground_truth").withColumn("table_name", F.lit("bench_results"))
    return pages.unionByName(runs).select("table_name", "origin", "encoding", "length", "n")


def p1_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts by engine, encoding and length."""
    return truncation.length_counts(_pages(spark, sf_dir, "engine", "text"), "engine", "text")


def _shares(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    pages = _pages(spark, sf_dir, by, "text")
    cases = truncation.truncated_texts(pages, "result_id", by, "text", _START)
    return truncation.truncation_shares(cases, pages, "result_id", by, "text")


def p1_shares_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir, "engine")


def p1_shares_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir, "source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned pages with a split word, a misread word, or that are furniture."""
    words = scan_repair.fit_words(_pages(spark, sf_dir, "text"), "text")
    return scan_repair.line_defects(_scanned(spark, sf_dir, "text"), "result_id", "text", words).withColumnRenamed("record_id", "result_id")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    words = scan_repair.fit_words(_pages(spark, sf_dir, "text"), "text")
    return scan_repair.repair_pages(_scanned(spark, sf_dir, "text").dropDuplicates(["result_id"]), "result_id", "text", words)


def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of scanned regions, joined in their order and repaired."""
    words = scan_repair.fit_words(_pages(spark, sf_dir, "text"), "text")
    joined = F.array_join(F.transform("regions", lambda r: F.coalesce(r["text"], F.lit(""))), "\n")
    regions = _scanned(spark, sf_dir, "regions").dropDuplicates(["result_id"]).select("result_id", joined.alias("text"))
    return scan_repair.repair_pages(regions, "result_id", "text", words)


_STORED = ("quality_score", "quality_flags")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are lists, tables or junk."""
    pages = _pages(spark, sf_dir, "lang", "text", *_STORED)
    found = shape.classify_shapes(pages, "result_id", "text", *_STORED, common=language.common_words(pages, "lang", "text"))
    return found.where("shape <> 'prose'").select(F.col("record_id").alias("result_id"), "shape")


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and shape of each page beside its stored quality score."""
    pages = _pages(spark, sf_dir, "lang", "text", *_STORED)
    stats = shape.page_statistics(pages, "result_id", "text", *_STORED, common=language.common_words(pages, "lang", "text"))
    return shape.with_shapes(materialise(stats.dropDuplicates(["record_id"]))).withColumnRenamed("record_id", "result_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of results with a line that looks the same but has other characters."""
    pairs = unify.lookalike_pairs(_pages(spark, sf_dir, "text"), "result_id", "text")
    return pairs.toDF("result_id_a", "result_id_b")


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text in its one consistent form."""
    return unify.unify_column(_pages(spark, sf_dir, "text").dropDuplicates(["result_id"]), "result_id", "text")


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region text in its one consistent form."""
    regions = _pages(spark, sf_dir, "regions").dropDuplicates(["result_id"]).select("result_id", F.posexplode("regions").alias("region_idx", "r"))
    keyed = regions.select(F.format_string("%d:%d", "result_id", "region_idx").alias("region_id"), F.col("r.text").alias("text"))
    return unify.unify_column(keyed, "region_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose pages with a missing or wrong label or several languages, a row a language."""
    pages = _pages(spark, sf_dir, "lang", "text")
    model = language.fit_languages(pages, "lang", "text")
    return language.label_problems(pages, "result_id", "lang", "text", model, _START).select(F.col("record_id").alias("result_id"), "lang")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with confidence and kind of problem."""
    pages = _pages(spark, sf_dir, "lang", "text")
    model = language.fit_languages(pages, "lang", "text")
    return language.label_problems(pages, "result_id", "lang", "text", model, _START)


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every passage of every page."""
    pages = _pages(spark, sf_dir, "lang", "text").dropDuplicates(["result_id"])
    return language.page_passages(pages, "result_id", "text", language.fit_languages(pages, "lang", "text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 or more consecutive words of a test item."""
    return _leaks(spark, sf_dir).where(F.col("longest_run") >= leakage.RUN).select("doc_id", "item_id")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aligned pairs with their longest run and score, edited copies among them."""
    return _leaks(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler or an error page instead of a decision."""
    return p8_evidence(spark, sf_dir).select("doc_id")


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the kind of residue and the passage."""
    return residue.find_residue(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested by brute force, round trips and known cases."""
    sizes = {
        "characters": "length(text)",
        "utf8_bytes": "strlen(text)",
        "utf16_units": "length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))",
        "characters_crlf": "length(text) + length(text) - length(replace(text, chr(10), ''))",
        "utf8_bytes_crlf": "strlen(text) + length(text) - length(replace(text, chr(10), ''))",
    }
    escaped = " + ".join(f"length(text) - length(replace(text, {c}, ''))" for c in ("'\"'", "'\\'", "chr(10)", "chr(13)", "chr(9)"))
    entities = " + ".join(f"{n} * (length(text) - length(replace(text, '{c}', '')))" for n, c in ((4, "&"), (3, "<"), (3, ">"), (5, '"')))
    sizes |= {"characters_json": f"length(text) + {escaped}", "utf8_bytes_json": f"strlen(text) + {escaped}", "characters_html": f"length(text) + {entities}", "utf8_bytes_html": f"strlen(text) + {entities}"}
    unions = " UNION ALL ".join(f"SELECT coalesce(engine, '') AS origin, '{k}' AS encoding, CAST({v} AS INTEGER) AS length FROM ocr_results WHERE length(trim(text, ' ')) > 0" for k, v in sizes.items())
    return {"p1_lengths": f"SELECT origin, encoding, length, count(*) AS n FROM ({unions}) GROUP BY origin, encoding, length"}
