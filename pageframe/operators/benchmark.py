"""Recognition benchmarks: grids, error rates, best runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.text import clamp01, normalise


#: Edits up to which a narrow band of the distance table suffices.
BAND = 24


def error_rate(distance: Column, size: Column, actual_size: Column) -> Column:
    """edits by expected length; an empty expectation gives 0 or 1."""
    return F.when(size == 0, F.when(actual_size == 0, 0.0).otherwise(1.0)).otherwise(distance / size)


def _edits(e: Column, a: Column) -> Column:
    # few edits are counted in a narrow band; only where there are more is the whole table filled
    band = F.levenshtein(e, a, BAND)
    return F.when(band >= 0, band).otherwise(F.levenshtein(e, a)).cast("double")


def rated(runs: DataFrame, expected: str, actual: str) -> DataFrame:
    """``char_error_rate`` over code points and ``word_error_rate`` over words of normalised texts; null texts count as empty.

    Words are coded as one character each, by their first place among the words
    of both texts, so that edits of words are counted as those of characters are,
    in the JVM. Each distinct pair of texts is compared once; runs meet it by
    hashes, not by texts.
    """
    key = [F.xxhash64(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((F.col(expected), "_he"), (F.col(actual), "_ha"))]
    sized = [F.length(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((expected, "_le"), (actual, "_la"))]
    keys = ["_he", "_ha", "_le", "_la"]
    # what follows is dear by pair, so the shuffle's partitions are not merged for being small
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = runs.select(*key, *sized, F.coalesce(expected, F.lit("")).alias("_e"), F.coalesce(actual, F.lit("")).alias("_a")).repartition(n, *keys)
    pairs = texts.groupBy(*keys).agg(F.first("_e").alias("_e"), F.first("_a").alias("_a"))
    pairs = pairs.withColumn("_e", normalise(F.col("_e"))).withColumn("_a", normalise(F.col("_a")))
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    pairs = pairs.withColumn("_we", tokens(F.col("_e"))).withColumn("_wa", tokens(F.col("_a")))
    pairs = pairs.withColumn("_known", F.array_distinct(F.concat("_we", "_wa")))
    code = lambda ws: F.array_join(F.transform(ws, lambda w: _character(F.array_position("_known", w))), "")
    pairs = pairs.withColumn("_ce", code(F.col("_we"))).withColumn("_ca", code(F.col("_wa")))
    done = pairs.select(
        *keys, error_rate(_edits(F.col("_e"), F.col("_a")), F.length("_e"), F.length("_a")).alias("char_error_rate"), error_rate(_edits(F.col("_ce"), F.col("_ca")), F.size("_we"), F.size("_wa")).alias("word_error_rate")
    )
    return runs.select("*", *key, *sized).join(done, keys).drop(*keys)


def _character(n: Column) -> Column:
    """A character for a number from 1 on, none of them a surrogate."""
    code = F.when(n < 0xD000, n + 32).otherwise(n + 0x10000)
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def metrics(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """both rates and accuracies."""
    return rated(df, expected, actual).withColumn("char_accuracy", clamp01(1 - F.col("char_error_rate"))).withColumn("word_accuracy", clamp01(1 - F.col("word_error_rate")))


def successful(runs: DataFrame, text: str = "extracted_text") -> DataFrame:
    """Runs with a text that is no error."""
    return runs.where((F.length(text) > 0) & ~F.col(text).startswith("ERROR"))


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """A short list, in its order, with each value's place and the list's length."""
    return values.agg(F.array_sort(F.collect_set(values.columns[0])).alias("_all")).select(F.posexplode("_all").alias(f"_{name}", name), F.size("_all").alias(f"_n_{name}"))


def grid(engines: DataFrame, fixtures: DataFrame, configurations: DataFrame) -> DataFrame:
    """Every combination of three small lists, which are the benchmark's own, not data, with its place ``i``.

    The place in the grid's order is worked out from those in the lists.
    """
    e, f, c = _numbered(engines, "engine"), _numbered(fixtures, "fixture"), _numbered(configurations, "preprocess")
    every = e.crossJoin(f).crossJoin(c)
    i = (F.col("_engine").cast("bigint") * F.col("_n_fixture") + F.col("_fixture")) * F.col("_n_preprocess") + F.col("_preprocess")
    return every.select("engine", "fixture", "preprocess", i.alias("i"))


def shard(df: DataFrame, index: str, shards: int, number: int) -> DataFrame:
    """The rows of one of so many shards, by their place."""
    return df.where(F.pmod(F.col(index), F.lit(shards)) == number)


def best_by(runs: DataFrame, keys: DataFrame, key: str, rate: str, order: str) -> DataFrame:
    """Of each key the run of the lowest rate, the first in order of ties; null where there is none."""
    best = runs.where(F.col(rate).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(rate).alias("rate"), F.col(order).alias("first"))).alias("best"))
    return keys.join(best, key, "left").select(key, F.col("best.first").alias(order), F.col("best.rate").alias(rate))
