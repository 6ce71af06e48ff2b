"""Results as they arrive: counts by page state, the latest result of a page, and expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pageframe.operators import store


def latest_results(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last result of each page so far; for update or complete mode."""
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return newest.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def first_deliveries(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Each row once; its state is let go ``late`` behind the newest event."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def retention(stream: DataFrame, path: str, checkpoint: str, cap: int = store.KEPT, now: Callable[[], Column] = F.current_timestamp) -> StreamingQuery:
    """The jobs that are kept, as a stream of job records brings them: unexpired, the last written of each id, ``cap`` at most.

    After each batch they are a folder ``batch=<number>`` of ``path``, so a
    batch that runs again writes the same folder; :func:`kept_jobs` reads the
    newest. State is ``cap`` rows, however many jobs have passed.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = kept_jobs(spark, path, batch.schema, number)
        every = batch if before is None else before.unionByName(batch)
        store.retained(store.latest(every, "id", "updated_at"), now(), cap).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_jobs(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame | None:
    """The jobs kept after the newest batch, or the newest one before a number; None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{path}/batch={max(numbers)}") if numbers else None


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, by: str) -> DataFrame:
    """Counts by window and kind, with events up to ``late`` behind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def on_pages(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``call`` gets each batch of pages in order; run until what is there has passed."""
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
