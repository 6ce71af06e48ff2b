"""Recogniser outputs as regions, the engine registry, and reports' text and chart measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageframe.functions.text import js_trim
from pageframe.operators.pixels_numpy import Preparation, prepared
from pageframe.runtime import materialise

#: An engine gets the bytes of pages and gives their texts.
Engine = Callable[[list[bytes | None]], list[str]]
#: Engines by name: a tier, a tier and model (``premium:donut``), or ``mock``, which runs without models.
ENGINES: dict[str, Callable[[], Engine]] = {}
#: The tier that stands in for one that doesn't start, those for one that fails on a page, and the one above.
ONE_DOWN = {"premium": "standard", "standard": "basic"}
DOWN = {"premium": ("standard", "basic"), "standard": ("basic",), "basic": ()}
ONE_UP = {"basic": "standard", "standard": "premium", "premium": "premium"}

# The mock recogniser's page, line by line, and its lines that a profile reads in another way.
COMPARISON = (
    "ACME Supplies, Inc.", "Invoice #4821", "Bill To: Northwind Logistics", "Item A4 Paper (5 boxes) x 3 @ $89.50 = $268.50", "Item USB-C Dock x 2 @ $149.00 = $298.00",
    "Subtotal: $566.50", "Tax (8.75%): $49.57", "Total due: $616.07", "Payment due date: 2026-03-01", "Notes: Deliver before 5pm. Leave at loading dock B.",
)
MISREAD = {
    "premium": {},
    "standard": {7: "Total due: $616.70"},
    "basic": {
        0: "ACME Suppiies Inc", 1: "lnvoice #482l", 2: "BiII To: Northwind Logistics", 3: "ltem A4 Paper (5 boxes) x 3 @ $89.50 = $268.50", 4: "ltem USB-C Dock x 2 @ $149.00 = $298.00",
        5: "SubtotaI: $566.50", 7: "TotaI due: $616.70", 8: "Payment due date: 2026-03-0l", 9: "Notes: Deiiver before 5prn. Leave at loading dock B",
    },
}
PLAIN = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", (("Lorem ipsum dolor sit amet,", (50.0, 50.0, 400.0, 30.0)), ("consectetur adipiscing elit.", (50.0, 90.0, 380.0, 30.0))))
MALFORMED = (
    "Result with malformed regions for PDF export resilience tests.",
    (("Invalid NaN height", (10.0, 20.0, 200.0, float("nan"))), ("Invalid zero width", (20.0, 60.0, 0.0, 22.0)), ("Invalid infinite y", (25.0, float("inf"), 160.0, 20.0)), ("Valid anchor text", (30.0, 95.0, 180.0, 24.0))),
)
PROFILES = ("default", *MISREAD, "malformed")
# The tiers, and the models that a tier can be asked for with.
TIERS = ("premium", "standard", "basic")
MODELS = ("trocr-hybrid", "trocr-base", "trocr-small-handwritten", "trocr-base-handwritten", "donut", "nougat", "mgp-str", "paddleocr", "tesseract-combined")


def register(name: str) -> Callable:
    """Add an engine: a function without arguments that gives page bytes to texts."""

    def add(make: Callable) -> Callable:
        ENGINES[name] = make
        return make

    return add


def _mock() -> Engine:
    return lambda pages: [f"page of {len(p or b'')} bytes" for p in pages]


register("mock")(_mock)


def mock_page(profile: str = "default") -> tuple[str, list[tuple[str, tuple[float, ...]]]]:
    """The text and the regions (text, box) that the mock recogniser gives of any page."""
    if profile in MISREAD:
        lines = [MISREAD[profile].get(k, x) for k, x in enumerate(COMPARISON)]
        return "\n".join(lines), [(x, (48.0, 48.0 + 36 * k, 500.0, 24.0)) for k, x in enumerate(lines)]
    text, regions = MALFORMED if profile == "malformed" else PLAIN
    return text, list(regions)


def start(tier: str, strict: bool = False, model: str | None = None) -> tuple[str, Engine]:
    """The engine of a tier, or of the one below where it doesn't start: one step, and none if the choice is strict.

    An engine for the model is taken if one is registered.
    """

    def make(name: str) -> Engine:
        return ENGINES[f"{name}:{model}" if f"{name}:{model}" in ENGINES else name]()

    try:
        return tier, make(tier)
    except Exception:
        if strict or tier not in ONE_DOWN:
            raise
        return ONE_DOWN[tier], make(ONE_DOWN[tier])


RECOGNISED = "engine string, text string, error string"


def recognise(pages: DataFrame, tier: str, strict: bool = False, model: str | None = None, key: str = "id", data: str = "bytes", prepare: Callable[[bytes | None], bytes | None] | None = None) -> DataFrame:
    """Texts of pages: key, ``engine`` (the one that ran), ``text``, ``error``.

    An engine is started once a task. A page that fails has a null text and an
    error; the others go on. ``prepare`` makes each page's bytes ready before.
    Filter pages before: this stage is the dear one.
    """
    kind = pages.schema[key].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {RECOGNISED}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, call = start(tier, strict, model)
        for b in batches:
            rows = []
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((k, name, call([prepare(page) if prepare else page])[0], None))
                except Exception as e:  # noqa: BLE001  an engine may fail in any way
                    rows.append((k, name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, schema)], schema=schema)

    return pages.select(key, data).mapInArrow(run, f"{key} {kind}, {RECOGNISED}")


def recognise_jobs(pages: DataFrame, tier: str, strict: bool = False, model: str | None = None, job: str = "job_id", key: str = "id", data: str = "bytes") -> DataFrame:
    """As :func:`recognise`, with ``job_id``; the jobs of which a page fails run again, whole, one tier further down.

    The last tier's errors stand. A strict choice has no other tier. What a tier
    gave is kept in the shared folder, as recognition is dear.
    """
    out = None
    jobs = pages.select(key, job).distinct()
    left = pages
    for name in (tier, *(() if strict else DOWN.get(tier, ()))):
        last = strict or name == (DOWN.get(tier) or (tier,))[-1]
        done = materialise(recognise(left, name, strict, model, key, data).dropDuplicates([key]).join(jobs, key))
        failed = done.where("error is not null").select(job).distinct()
        part = done if last else done.join(failed, job, "left_anti")
        out = part if out is None else out.unionByName(part)
        left = left.join(failed, job, "left_semi")
        if last:
            break
    return out


#: Score under which a premium page is prepared and read again, and under which the basic engine reads it too; how each time.
BOOSTS = ((0.9, "premium", Preparation(adaptive=True, block=21, c=7.0)), (0.84, "basic", Preparation(adaptive=True, block=19, c=9.0)))
LEAST_SIZE = (1400, 1000)


def boosted(pages: DataFrame, results: DataFrame, score: Callable[[DataFrame], DataFrame], strict: bool = False, model: str | None = None, key: str = "id", data: str = "bytes") -> DataFrame:
    """Premium results, of which low ones are read again from prepared pages, and still low ones by the basic engine.

    ``results`` have the key, ``text``, ``score`` and ``rank``; ``score`` adds
    the latter two to new texts. A page keeps its result unless a later one's
    rank is higher; one without a result has a score of 0. Pages that fail again
    keep what they have.
    """
    best = results.select(key, "text", "score", "rank")
    for below, tier, preparation in BOOSTS:
        low = best.where(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)) < below).select(key)
        again = recognise(pages.join(low, key, "left_semi"), tier, strict, model, key, data, lambda b, p=preparation: prepared(b, p, *LEAST_SIZE))
        candidates = score(again.where("error is null and text is not null").select(key, "text")).select(key, "text", "score", "rank")
        every = best.withColumn("_turn", F.lit(0)).unionByName(candidates.withColumn("_turn", F.lit(1)))
        first = F.struct(F.coalesce("rank", F.lit(float("-inf"))).alias("rank"), (-F.col("_turn")).alias("turn"), "text", "score", F.col("rank").alias("own"))
        best = materialise(every.groupBy(key).agg(F.max(first).alias("_b")).select(key, "_b.text", "_b.score", F.col("_b.own").alias("rank")))
    return best


def parameters(url: Column) -> Column:
    """Engine, model, strict, force_ocr, preprocess and mock_profile of an address; what is none of the known values is null.

    ``1`` and ``true`` are true. Preparation that is no JSON is null.
    """
    get = lambda k: F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(k)))
    among = lambda c, values: F.when(c.isin(*values), c)
    true = lambda c: F.coalesce(c.isin("1", "true"), F.lit(False))
    json = get("preprocess")
    mock = get("engine") == "mock"
    return F.struct(
        among(get("engine"), (*TIERS, "mock")).alias("engine"), among(get("model"), MODELS).alias("model"), true(get("strictEngine")).alias("strict"), true(get("forceOcr")).alias("force_ocr"),
        F.when(F.try_parse_json(json).isNotNull(), json).alias("preprocess"), F.when(mock, F.coalesce(among(get("mockProfile"), PROFILES), F.lit("default"))).alias("mock_profile"),
    )


def address(engine: Column, model: Column, preprocess: Column) -> Column:
    """F32: the query of a benchmark run: a strict choice, recognition forced, and what isn't null of model and preparation."""
    pair = lambda k, c: F.concat(F.lit(f"&{k}="), F.url_encode(c))
    return F.concat(F.lit("/?engine="), F.url_encode(engine), F.lit("&strictEngine=1&forceOcr=1"), F.coalesce(pair("model", model), F.lit("")), F.coalesce(pair("preprocess", preprocess), F.lit("")))


def flatten_lines(df: DataFrame, blocks: str) -> DataFrame:
    """One row a line of blocks > paragraphs > lines, with its words kept.

    A line's text is that of its words, its own where it has none. Lines of no
    text, or of a box without size, are left out.
    """
    rest = [c for c in df.columns if c != blocks]
    step = df.select(*rest, F.posexplode(blocks).alias("block_no", "_b"))
    step = step.select(*rest, "block_no", F.posexplode("_b.paragraphs").alias("paragraph_no", "_p"))
    step = step.select(*rest, "block_no", "paragraph_no", F.posexplode("_p.lines").alias("line_no", "_l"))
    words = F.coalesce("_l.words", F.array())
    text = F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: w["text"]), " ")).otherwise(F.coalesce("_l.text", F.lit("")))
    flat = step.select(*rest, "block_no", "paragraph_no", "line_no", js_trim(text).alias("text"), words.alias("words"), *(F.col(f"_l.{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "confidence")))
    return flat.where("text <> '' and x1 > x0 and y1 > y0").withColumn("confidence", F.col("confidence") / 100)


def detected(item: Column, width: Column, height: Column) -> Column:
    """Text, confidence and box of a detector's item, each under any of its names."""
    return F.struct(F.coalesce(item["text"], item["value"], F.lit("")).alias("text"), F.coalesce(item["confidence"], item["score"]).alias("confidence"), F.coalesce(item["box"], item["points"]).alias("points"))


def whole_page(text: Column, width: Column, height: Column) -> Column:
    """one region of the whole page, none for an empty text."""
    region = F.struct(text.alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), width.cast("double").alias("w"), height.cast("double").alias("h"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(region)).otherwise(F.slice(F.array(region), 1, 0))


def stacked_lines(lines: Column) -> Column:
    """lines one below the other, as the mock engine lays them out."""
    return F.transform(lines, lambda t, i: F.struct(t.alias("text"), F.lit(48.0).alias("x"), (i * 36 + 48).cast("double").alias("y"), F.lit(500.0).alias("w"), F.lit(24.0).alias("h")))


def spacing(box_width: Column, natural: Column, text: Column) -> Column:
    """spare width by spaces, else by gaps between characters, else none."""
    spare = F.greatest(box_width - natural, F.lit(0.0))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.struct(
        F.when(spaces > 0, spare / spaces).otherwise(0.0).alias("word"), F.when((spaces == 0) & (F.length(text) > 1), spare / (F.length(text) - 1)).otherwise(0.0).alias("character")
    )


def wrapped(text: Column, width: int) -> Column:
    """words filled into lines of so many characters; blank paragraphs stay, a longer word has its own line."""

    def fill(paragraph: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def add(s: Column, w: Column) -> Column:
            fits = F.length(s["open"]) + 1 + F.length(w) <= width
            return (
                F.when(s["open"] == "", F.struct(s["done"].alias("done"), w.alias("open")))
                .when(fits, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit(" "), w).alias("open")))
                .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), w.alias("open")))
            )

        words = F.filter(F.split(paragraph, r"\s+"), lambda w: w != "")
        return F.aggregate(words, start, add, lambda s: F.concat(s["done"], F.array(s["open"])))

    return F.flatten(F.transform(F.split(text, "\n"), fill))


def bar_width(track: Column, accuracy: Column) -> Column:
    """F29."""
    return track * F.greatest(F.lit(0.0), F.least(F.lit(1.0), accuracy))


def scaled_widths(df: DataFrame, table: str, width: str, content: float) -> DataFrame:
    """column widths scaled to the content's where their sum is more."""
    total = F.sum(width).over(Window.partitionBy(table))
    return df.withColumn(width, F.when(total > content, F.col(width) * (content / total)).otherwise(F.col(width)))
