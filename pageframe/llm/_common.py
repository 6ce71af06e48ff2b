"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageframe.runtime import materialise

__all__ = ["count_keys", "map_columns", "materialise", "table"]

#: Text tokens a counting task keeps before it hands its partial counts on.
FLUSH_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a stored table, so that the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., dict[str, Any]]], schema: str) -> DataFrame:
    """Apply a function to the columns of every Arrow batch.

    ``make`` runs once a task and returns the function, which gets each column
    as a list and gives a dict of lists or arrays in the order of ``schema``.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = step(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out.values(), fields)], schema=fields)

    return df.mapInArrow(run, schema)


def count_keys(df: DataFrame, make: Callable[[], Callable[..., dict[Any, int]]], schema: str, unpack: Callable[[Any], tuple]) -> DataFrame:
    """Sum the counters that ``make()`` gives for each batch over all rows.

    Each task merges its batches' counters in memory, up to ``FLUSH_WORDS``
    keys, so the shuffle carries one row a key and task, not one a token.
    ``schema`` names the key columns and a last column ``n bigint``.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))
    names = fields.names[:-1]

    def flush(total: dict[Any, int]) -> pa.RecordBatch:
        rows = [(*unpack(k), n) for k, n in total.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, total = make(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, n in step(*(c.to_pylist() for c in batch.columns)).items():
                total[k] = total.get(k, 0) + n
            if len(total) > FLUSH_WORDS:
                yield flush(total)
                total = {}
        if total:
            yield flush(total)

    return df.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))
