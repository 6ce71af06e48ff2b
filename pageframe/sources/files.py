"""Images, PDF files and reports as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions import geometry as geo
from pageframe.functions.text import collapse, js_trim, utf16_length
from pageframe.sources.pdf_reader import Item, read_pages

#: Characters and regions from which a page's own text suffices, and how much larger pages are drawn.
LEAST_CHARACTERS, LEAST_REGIONS, SCALE = 24, 2, 3.0
SHOWN = "array<struct<text:string,x:double,y:double,size:double,width:double>>"


def route(path: Column, mime: Column) -> Column:
    """``pdf`` for PDF files, ``image`` for everything else."""
    return F.when((F.lower(mime) == "application/pdf") | F.lower(path).endswith(".pdf"), "pdf").otherwise("image")


def images(spark: SparkSession, path: str) -> DataFrame:
    """One page an image, with its size."""
    i = spark.read.format("image").load(path)
    return i.select(F.col("image.origin").alias("path"), F.lit(1).alias("page_number"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.lit("image").alias("source_kind"))


def reports(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All partial benchmark files of a folder, without the gathered one."""
    return spark.read.schema(ddl).option("multiLine", True).option("pathGlobFilter", "benchmark-*.json").json(path).where(~F.col("_metadata.file_name").endswith("benchmark-results.json"))


def pdf_items(data: bytes) -> list[tuple[int, float, float, list[Item]]]:
    """Pages of a PDF file: number, width, height and each shown string; none of a file that can't be read."""
    try:
        return read_pages(data)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return []


def native_regions(items: Column, height: Column, width: Column) -> Column:
    """The items of a page as the regions of its drawing."""
    text = lambda i: js_trim(i["text"])
    box = lambda i: geo.native_item(i["x"], i["y"], i["width"], i["size"], F.lit(None).cast("double"), utf16_length(text(i)), height, SCALE)
    regions = F.transform(items, lambda i: F.struct(text(i).alias("text"), *(box(i)[k].alias(k) for k in "xywh"), F.lit(None).cast("double").alias("confidence")))
    return geo.clean_regions(regions, width * SCALE, height * SCALE, before=False)


def pdf_pages(spark: SparkSession, path: str, least_characters: int = LEAST_CHARACTERS, least_regions: int = LEAST_REGIONS) -> DataFrame:
    """One row a page of each PDF file, ``pdf-text`` where its own text suffices, else ``scanned``.

    Gives path, page_number, width, height (of the page), source_kind, items,
    and, of a page with text of its own, ``regions`` and ``text`` of its drawing,
    which is ``SCALE`` times as large; the text is judged by the cleaned regions.
    Files that can't be read give no row. Drawing a page is left to a recogniser
    engine, as no library here draws.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    item = pa.list_(pa.struct([("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("size", pa.float64()), ("width", pa.float64())]))
    schema = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("items", item)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(name, n, w, h, [i._asdict() for i in items]) for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, w, h, items in pdf_items(data or b"")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

    pages = files.mapInArrow(run, f"path string, page_number int, width double, height double, items {SHOWN}")
    cleaned = pages.withColumn("regions", native_regions(F.col("items"), F.col("height"), F.col("width")))
    read = cleaned.withColumn("text", js_trim(collapse(F.array_join(F.transform("regions", lambda r: r["text"]), " "))))
    native = (utf16_length(F.col("text")) >= least_characters) & (F.size("regions") >= least_regions)
    kept = read.withColumn("source_kind", F.when(native, "pdf-text").otherwise("scanned"))
    only = lambda c: F.when(F.col("source_kind") == "pdf-text", F.col(c)).alias(c)
    return kept.select("path", "page_number", "width", "height", "source_kind", "items", only("regions"), only("text"))
