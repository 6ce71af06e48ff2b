"""Image operators over the pixel relation (img, y, x, g): windows, joins and aggregates.

The same operators over whole images, in NumPy, are in ``pixels_numpy``; these
are their declarative form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.functions.text import js_round


def from_values(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Pixels of images whose values lie between -1 and 1."""
    flat = df.select(F.col(key).alias("img"), F.posexplode(values).alias("i", "v"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), js_round((F.col("v").cast("double") + 1) * 127.5))).cast("int")
    return flat.select("img", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), g.alias("g"))


def gray(r, g, b):  # noqa: ANN001, ANN201
    """I01."""
    return js_round(r * 0.299 + g * 0.587 + b * 0.114)


def integral(px: DataFrame) -> DataFrame:
    """Sums over all pixels above and to the left."""
    rows = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    columns = Window.partitionBy("img", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("_r", F.sum("g").over(rows)).withColumn("s", F.sum("_r").over(columns)).drop("_r")


def neighbours(px: DataFrame, half: int, width: int, height: int, replicate: bool) -> DataFrame:
    """One row a pixel and neighbour: the neighbour's value as ``v``.

    Each pixel is spread over the windows that it lies in, and met by the
    window's centre, so images stay apart and no pair of pixels is searched.
    ``replicate`` repeats border pixels for places outside of the image.
    """
    d = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    spread = px.select("img", "y", "x", d.alias("dy")).select("img", "y", "x", "dy", d.alias("dx"))
    ny, nx = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    if replicate:
        ny, nx = F.greatest(F.lit(0), F.least(F.lit(height - 1), ny)), F.greatest(F.lit(0), F.least(F.lit(width - 1), nx))
    at = spread.select("img", "y", "x", ny.alias("ny"), nx.alias("nx"))
    return at.join(px.select("img", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("g").alias("v")), ["img", "ny", "nx"]).select("img", "y", "x", "v")


def box_statistics(px: DataFrame, half: int, width: int, height: int) -> DataFrame:
    """Mean and standard deviation of the window clipped at the borders."""
    near = neighbours(px, half, width, height, replicate=False).groupBy("img", "y", "x").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    mean = F.col("s") / F.col("n")
    return px.join(near, ["img", "y", "x"]).select("img", "y", "x", "g", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("deviation"))


def median3(px: DataFrame, width: int, height: int) -> DataFrame:
    """W03, I04."""
    near = neighbours(px, 1, width, height, replicate=True)
    return near.groupBy("img", "y", "x").agg(F.element_at(F.sort_array(F.collect_list("v")), 5).alias("g"))


def erode(px: DataFrame, width: int, height: int, half: int = 1) -> DataFrame:
    """W04."""
    return neighbours(px, half, width, height, replicate=False).groupBy("img", "y", "x").agg(F.min("v").alias("g"))


def dilate(px: DataFrame, width: int, height: int, half: int = 1) -> DataFrame:
    """W04."""
    return neighbours(px, half, width, height, replicate=False).groupBy("img", "y", "x").agg(F.max("v").alias("g"))


def opened(px: DataFrame, width: int, height: int) -> DataFrame:
    """W05, I10."""
    return dilate(erode(px, width, height), width, height)


def closed(px: DataFrame, width: int, height: int) -> DataFrame:
    """W05, I10."""
    return erode(dilate(px, width, height), width, height)


def adaptive_threshold(px: DataFrame, block: int, c: float, width: int, height: int) -> DataFrame:
    """I07."""
    return box_statistics(px, block // 2, width, height).select("img", "y", "x", F.when(F.col("g") > F.col("mean") - c, 255).otherwise(0).alias("g"))


def sauvola(px: DataFrame, window: int, k: float, width: int, height: int) -> DataFrame:
    """I08."""
    limit = F.col("mean") * (1 + k * (F.col("deviation") / 128 - 1))
    return box_statistics(px, window // 2, width, height).select("img", "y", "x", F.when(F.col("g") > limit, 255).otherwise(0).alias("g"))


def unsharp(px: DataFrame, radius: int, amount: float, width: int, height: int) -> DataFrame:
    """I03."""
    sharp = js_round(F.col("g") + amount * (F.col("g") - F.col("mean")))
    return box_statistics(px, radius, width, height).select("img", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), sharp)).cast("int").alias("g"))


def histogram(px: DataFrame) -> DataFrame:
    """Count and running count of each value of each image."""
    counts = px.groupBy("img", "g").agg(F.count("*").alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy("img").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)))


def otsu_threshold(px: DataFrame) -> DataFrame:
    """The first value of the largest variance between the classes; over at most 256 rows an image."""
    counts = px.groupBy("img", "g").agg(F.count("*").alias("n"))
    run, all_ = Window.partitionBy("img").orderBy("g").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img")
    s = counts.select("img", "g", F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col("g")).over(run).alias("s0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("g")).over(all_).alias("s"))
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.when(F.col("w") == F.col("w0"), 0.0).otherwise(F.col("w0") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1))
    best = s.select("img", "g", between.alias("v")).groupBy("img").agg(F.max(F.struct("v", (-F.col("g")).alias("early"))).alias("best"))
    return best.select("img", (-F.col("best.early")).cast("int").alias("threshold"))
