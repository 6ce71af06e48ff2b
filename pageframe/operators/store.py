"""The job store: upsert, listing, loading, retention and cascades over three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.functions.text import data_url_bytes

#: Days a job is kept, and jobs that are kept.
DAYS, KEPT = 30, 200


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """Of rows with one key the last written; ties and repeated rows give one."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), *(c for c in df.columns if c not in (key, by)))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def expiry(updated_at: Column, days: int = DAYS) -> Column:
    """So many calendar days later, in the session's time zone."""
    return updated_at + F.make_dt_interval(F.lit(days))


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """R01."""
    return jobs.where(F.col("expires_at") < now)


def retained(jobs: DataFrame, now: Column, cap: int = KEPT) -> DataFrame:
    """Unexpired jobs, the ``cap`` last updated of them.

    The top rows are taken in every partition before they meet, so no task sees
    all jobs.
    """
    alive = jobs.where(F.coalesce(F.col("expires_at") >= now, F.lit(True)))
    return alive.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(cap)


def cascade(table: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """The rows whose job is still there."""
    return table.join(jobs.select(F.col("id").alias(key)), key, "left_semi")


def listing(jobs: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The last updated jobs."""
    columns = ("id", "created_at", "updated_at", "source_name", "engine_tier", "page_count", "average_quality")
    return retained(jobs, now).orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(limit).select(*columns)


def page_keys(pages: DataFrame) -> DataFrame:
    """Stored pages with key and kind of file; a missing or empty kind is PNG."""
    return pages.select(F.concat_ws(":", "job_id", F.col("page_number").cast("string")).alias("id"), "job_id", "page_number", F.coalesce(F.nullif(F.col("mime_type"), F.lit("")), F.lit("image/png")).alias("mime_type"))


def artifacts_by_job(artifacts: DataFrame) -> DataFrame:
    """A row a job with the sizes of its pdf and docx, the first of each kind by id."""
    size = F.octet_length("bytes")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, size), F.when(F.col("kind") == kind, F.col("id")))
    return artifacts.groupBy("job_id").agg(first("pdf").alias("pdf_bytes"), first("docx").alias("docx_bytes"))


def pass_through(pages: DataFrame) -> DataFrame:
    """Jobs of which every page has native text, so that the original file serves."""
    return pages.groupBy("job_id").agg((F.coalesce(F.bool_and(F.col("source_kind") == "pdf-text"), F.lit(True)) & (F.count("*") > 0)).alias("reuse_original"), F.count("*").alias("pages"))


def original_or(jobs: DataFrame, reuse: DataFrame, made: DataFrame) -> DataFrame:
    """Id and ``pdf`` of each job: the original file's bytes where every page has native text and the file is there, else the made one.

    ``jobs`` have id and ``original``, ``reuse`` is of :func:`pass_through`, ``made`` has id and ``made``.
    """
    known = jobs.select("id", "original").join(reuse.select(F.col("job_id").alias("id"), "reuse_original"), "id", "left").join(made.select("id", "made"), "id", "left")
    return known.select("id", F.when(F.coalesce("reuse_original", F.lit(False)) & F.col("original").isNotNull(), F.col("original")).otherwise(F.col("made")).alias("pdf"))


def cleared(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table without its rows, to be written over it."""
    return tuple(t.limit(0) for t in tables)


def page_bytes(blob: Column, url: Column) -> Column:
    """A page's bytes: the stored ones, else those of its data address; null for another address, whose file a binary source reads."""
    return F.coalesce(blob, F.when(url.startswith("data:"), data_url_bytes(url)))
