"""The queries of the core operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions import geometry as geo
from pageframe.functions import text as txt
from pageframe.operators import benchmark, layout, pages, pixels, pixels_numpy, recogniser, store
from pageframe.sources import exports

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row a key. What follows is dear by row, so the shuffle's partitions are not merged for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).dropDuplicates([key])


def _results(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Results without second deliveries, which differ by ``loaded_at`` only."""
    return _once(_t(spark, d, "ocr_results").select("result_id", *columns), "result_id")


def _delivered(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """All deliveries; for steps by row, whose narrow outcome is freed of repeats instead of the wide rows."""
    return _t(spark, d, "ocr_results").select("result_id", *columns)


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(_t(spark, d, "stored_jobs"), "id", "updated_at")


_R = "r AS (SELECT DISTINCT ON (result_id) * FROM ocr_results ORDER BY result_id, loaded_at)"
_J = "j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at, source_name, engine_tier, page_count, average_quality, expires_at) AS n FROM stored_jobs) WHERE n = 1)"
_NOW = "(SELECT max(updated_at) + INTERVAL 5 DAY FROM stored_jobs)"
_WS = txt.SPACE


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


_UTF16 = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
_ALLOWED = txt.ALLOWED.replace("'", "''")

# --- text functions


@query(f"WITH {_R} SELECT result_id, trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g'), ' ') AS normalised FROM r")
def text_normalised(spark: SparkSession, d: str) -> DataFrame:
    """F01."""
    return _results(spark, d, "text").select("result_id", txt.normalise(F.col("text")).alias("normalised"))


@query(
    f"WITH {_R}, t AS (SELECT result_id, {_trim('text')} AS t FROM r WHERE text IS NOT NULL) SELECT result_id, CAST({_UTF16.format('t')} AS INTEGER) AS units,"
    f" CAST(len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(len(list_filter(string_split(t, chr(10)), lambda w: w <> '')) AS INTEGER) AS lines FROM t"
)
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    t = _delivered(spark, d, "text").where("text is not null").select("result_id", txt.js_trim(F.col("text")).alias("t"))
    return t.select("result_id", txt.utf16_length(F.col("t")).alias("units"), F.size(txt.words(F.col("t"))).alias("words"), F.size(txt.lines(F.col("t"))).alias("lines")).dropDuplicates(["result_id"])


@query(
    f"WITH {_R}, t AS (SELECT result_id, regexp_replace(text, '{_WS}+', '', 'g') AS s FROM r WHERE text IS NOT NULL)"
    f" SELECT result_id, CASE WHEN length(s) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace(s, '[{_ALLOWED}]', '', 'g'))::DOUBLE / length(s) END AS ratio FROM t"
)
def symbol_ratio(spark: SparkSession, d: str) -> DataFrame:
    """F07, A10."""
    return _delivered(spark, d, "text").where("text is not null").select("result_id", txt.suspicious_ratio(F.col("text")).alias("ratio")).dropDuplicates(["result_id"])


#: Share of all words from which a word is in the dictionary: at most its inverse are.
_DICTIONARY_SHARE = 0.0005


def corpus_dictionary(spark: SparkSession, d: str) -> list[str]:
    """The dictionary by rule: the words of a-z that make up ``_DICTIONARY_SHARE`` of those of all deliveries, so 2,000 at most."""
    # tokens are counted as they stand first, so that each distinct one is stripped once
    tokens = _t(spark, d, "ocr_results").select(F.explode(txt.dictionary_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = tokens.select(txt.dictionary_word(F.col("token")).alias("word"), "n")
    counts = words.where(F.regexp_like("word", F.lit("^[a-z]+(['-][a-z]+)*$"))).groupBy("word").agg(F.sum("n").alias("n"))
    # the total is one row of the same counts, whose exchange is read again
    total = counts.agg(F.sum("n").alias("total")).hint("broadcast")
    return sorted(r["word"] for r in counts.join(total, F.col("n") >= F.col("total") * _DICTIONARY_SHARE).collect())


_WORDS = f"w AS (SELECT result_id, regexp_replace(u, '^[^a-z]+|[^a-z]+$', '', 'g') AS word FROM (SELECT result_id, unnest(regexp_split_to_array(lower(text), '{_WS}+')) AS u FROM ocr_results WHERE text IS NOT NULL) WHERE length(u) > 1)"
_DICT = "c AS (SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '^[a-z]+([''-][a-z]+)*$') GROUP BY word), k AS (SELECT word FROM c WHERE n >= (SELECT sum(n) FROM c) * 0.0005::DOUBLE)"
_RATIO = "q AS (SELECT result_id, count(k.word)::DOUBLE / count(*) AS ratio FROM w LEFT JOIN k USING (word) GROUP BY result_id)"


@query(f"WITH {_R}, {_WORDS}, {_DICT}, {_RATIO} SELECT * FROM q")
def dictionary_ratio(spark: SparkSession, d: str) -> DataFrame:
    """F08."""
    ratio = txt.dictionary_ratio(F.col("text"), corpus_dictionary(spark, d))
    return _delivered(spark, d, "text").select("result_id", ratio.alias("ratio")).where("ratio is not null").dropDuplicates(["result_id"])


_HEIGHTS = "list_sort(list_filter(list_transform(coalesce(regions, []), lambda x: x.h), lambda h: h > 0 AND NOT isnan(h) AND h < 'Infinity'::DOUBLE))"
_ANOMALY = "CASE WHEN len(hs) < 3 THEN false ELSE hs[len(hs)] > hs[len(hs) // 2 + 1] * 3::DOUBLE OR hs[1] < hs[len(hs) // 2 + 1] * 0.3::DOUBLE END"


@query(f"WITH {_R}, h AS (SELECT result_id, {_HEIGHTS} AS hs FROM r) SELECT result_id, {_ANOMALY} AS anomaly, hs[len(hs) // 2 + 1] AS median FROM h")
def region_heights(spark: SparkSession, d: str) -> DataFrame:
    """F09, A02."""
    heights = F.filter(F.transform(F.coalesce("regions", F.array()), lambda r: r["h"]), lambda h: (h > 0) & ~F.isnan(h) & (h < float("inf")))
    return _delivered(spark, d, "regions").select("result_id", txt.height_anomaly(F.col("regions")).alias("anomaly"), txt.upper_median(heights).alias("median")).dropDuplicates(["result_id"])


def _scored(spark: SparkSession, d: str, dictionary: list[str] | None = None) -> DataFrame:
    """Each delivered row's score; the narrow outcome, not the texts, is freed of second deliveries.

    ``dictionary`` is the list of usual words that the scores are made with; the
    corpus' own where none is given.
    """
    known = corpus_dictionary(spark, d) if dictionary is None else dictionary
    r = _delivered(spark, d, "job_id", "page_number", "attempt", "source", "lang", "text", "regions", "quality_score")
    scored = txt.with_quality(r, "text", "source", "quality_score", known, "regions")
    narrow = scored.select("result_id", "job_id", "page_number", "attempt", "source", "lang", "score", "flags", "rank")
    return narrow.dropDuplicates(["result_id"])


def _scored_sql() -> str:
    hits = {
        "very-short-text": "units < 20", "word-shape-anomaly": "words > 0 AND (mean > 11 OR mean < 2.2)", "symbol-noise": "noise > 0.15", "layout-collapse": "lines <= 1 AND words >= 20",
        "dictionary-miss": "words >= 20 AND coalesce(ratio < 0.5, false)", "height-anomaly": _ANOMALY,
    }
    score = "CASE WHEN quality_score IS NULL OR isnan(quality_score) THEN 0.85::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, quality_score)) END"
    for flag, penalty in txt.PENALTIES:
        score = f"({score} - CASE WHEN {hits[flag]} THEN {penalty}::DOUBLE ELSE 0::DOUBLE END)"
    flags = "list_filter([" + ", ".join(f"CASE WHEN {hits[f]} THEN '{f}' END" for f, _ in txt.PENALTIES) + "], lambda f: f IS NOT NULL)"
    return (
        f"WITH {_R}, {_WORDS}, {_DICT}, {_RATIO}, t AS (SELECT r.*, ratio, {_trim('coalesce(text, chr(32))')} AS t, {_HEIGHTS} AS hs FROM r LEFT JOIN q USING (result_id)),"
        f" m AS (SELECT *, {_UTF16.format('t')} AS units, regexp_replace(t, '{_WS}+', '', 'g') AS s, len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda w: w <> '')) AS words, len(list_filter(string_split(t, chr(10)), lambda w: w <> '')) AS lines FROM t),"
        f" e AS (SELECT *, CASE WHEN words > 0 THEN ({_UTF16.format('s')})::DOUBLE / words END AS mean, CASE WHEN length(s) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace(s, '[{_ALLOWED}]', '', 'g'))::DOUBLE / length(s) END AS noise FROM m),"
        f" z AS (SELECT *, CASE WHEN source = 'pdf-text' THEN 0.98::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, {score})) END AS score, CASE WHEN source = 'pdf-text' THEN []::VARCHAR[] ELSE {flags} END AS flags FROM e),"
        " ranked AS (SELECT *, score + CASE WHEN words >= 18 THEN 0.03::DOUBLE ELSE 0::DOUBLE END + CASE WHEN units >= 120 THEN 0.02::DOUBLE ELSE 0::DOUBLE END - CASE WHEN list_contains(flags, 'symbol-noise') THEN 0.05::DOUBLE ELSE 0::DOUBLE END"
        " - CASE WHEN list_contains(flags, 'very-short-text') THEN 0.08::DOUBLE ELSE 0::DOUBLE END AS rank FROM z)"
    )


_SCORED = _scored_sql()


@query(f"{_SCORED} SELECT result_id, score, array_to_string(flags, ',') AS flags, rank FROM ranked")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """F10, F11, A13."""
    return _scored(spark, d).select("result_id", "score", F.array_join("flags", ",").alias("flags"), "rank")


@query(f"{_SCORED} SELECT lang, count(*) AS results, round(coalesce(avg(score), 0), 6) AS average, sum((score < 0.8 AND source <> 'pdf-text')::INT)::BIGINT AS low, sum(len(flags))::BIGINT AS flags FROM ranked GROUP BY lang")
def quality_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: scan, score, dictionary join, aggregate."""
    low = F.sum(F.when((F.col("score") < pages.LOW) & (F.col("source") != "pdf-text"), 1).otherwise(0))
    return _scored(spark, d).groupBy("lang").agg(F.count("*").alias("results"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average"), low.alias("low"), F.sum(F.size("flags")).alias("flags"))


@query(f"{_SCORED} SELECT job_id, page_number, result_id, score FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number ORDER BY rank DESC, result_id) AS n FROM ranked) WHERE n = 1")
def best_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Each page's attempt of the highest rank."""
    s = _scored(spark, d).select("job_id", "page_number", "result_id", "score", "rank")
    return pages.best_of(s, ["job_id", "page_number"], F.col("rank"), "result_id").select("job_id", "page_number", "result_id", "score")


@query(f"WITH {_R} SELECT result_id, CASE WHEN quality_score IS NULL OR isnan(quality_score) THEN 0 ELSE quality_score END AS score FROM r WHERE source <> 'pdf-text' AND CASE WHEN quality_score IS NULL OR isnan(quality_score) THEN 0 ELSE quality_score END < 0.84")
def retry_candidates(spark: SparkSession, d: str) -> DataFrame:
    """P10, P11, E14."""
    low = pages.needs_retry(_results(spark, d, "source", "quality_score"), below=pages.RESCUE)
    return low.select("result_id", F.when(F.col("quality_score").isNull() | F.isnan("quality_score"), 0.0).otherwise(F.col("quality_score")).alias("score"))


@query(f"WITH {_R}, a AS (SELECT job_id, page_number, attempt, min(result_id) AS result_id FROM r GROUP BY ALL) SELECT job_id, page_number, coalesce(b.result_id, a.result_id) AS result_id FROM (SELECT * FROM a WHERE attempt = 1) a FULL JOIN (SELECT * FROM a WHERE attempt = 2) b USING (job_id, page_number)")
def overlaid_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Second attempts stand for first ones."""
    a = _results(spark, d, "job_id", "page_number", "attempt").groupBy("job_id", "page_number", "attempt").agg(F.min("result_id").alias("result_id"))
    pick = lambda n: a.where(F.col("attempt") == n).select("job_id", "page_number", "result_id")
    return pages.overlay(pick(1), pick(2), ["job_id", "page_number"])


@query(f"WITH {_R} SELECT result_id, coalesce(text, '') AS text, CASE WHEN text IS NULL THEN 0.39999999999999997::DOUBLE ELSE CASE WHEN quality_score IS NULL OR isnan(quality_score) THEN 0 ELSE quality_score END END AS score, CASE WHEN text IS NULL THEN 3 ELSE 0 END AS n_flags FROM r")
def fallback_results(spark: SparkSession, d: str) -> DataFrame:
    """P25."""
    s = F.coalesce(F.nanvl(F.col("quality_score"), F.lit(0.0)), F.lit(0.0))
    f = pages.or_fallback(F.col("text"), s, F.array().cast("array<string>"))
    return _results(spark, d, "text", "quality_score").select("result_id", f.alias("f")).select("result_id", "f.text", "f.score", F.size("f.flags").alias("n_flags"))


@query("SELECT id, job_id, page_number FROM (SELECT DISTINCT id, job_id, page_number, source_kind FROM stored_pages) WHERE coalesce(source_kind <> 'pdf-text', true)")
def pages_to_recognise(spark: SparkSession, d: str) -> DataFrame:
    """The filter reaches the scan; no bytes are read."""
    return pages.to_recognise(_t(spark, d, "stored_pages").select("id", "job_id", "page_number", "source_kind").distinct()).drop("source_kind")


@query("WITH p AS (SELECT DISTINCT job_id, page_number FROM stored_pages) SELECT job_id, page_number, row_number() OVER (PARTITION BY job_id ORDER BY page_number)::INT AS completed, count(*) OVER (PARTITION BY job_id)::BIGINT AS total FROM p")
def page_progress(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return pages.progress(_t(spark, d, "stored_pages").select("job_id", "page_number").distinct(), "job_id", "page_number")


@query("WITH p AS (SELECT DISTINCT job_id, page_number FROM stored_pages) SELECT job_id, page_number, ['first','second','third'][CAST((row_number() OVER (PARTITION BY job_id ORDER BY page_number) - 1) % 3 + 1 AS INT)] AS text FROM p")
def mock_responses(spark: SparkSession, d: str) -> DataFrame:
    """W14, E09."""
    return pages.cycled(_t(spark, d, "stored_pages").select("job_id", "page_number").distinct(), "page_number", ["first", "second", "third"])


@query("SELECT event_id, CASE WHEN NOT coalesce(value > 20, false) THEN 'basic' WHEN coalesce(value > 60, false) THEN 'premium' ELSE 'standard' END AS tier FROM events")
def engine_tiers(spark: SparkSession, d: str) -> DataFrame:
    """E10, over stand-in capabilities."""
    return _t(spark, d, "events").select("event_id", pages.tier(F.col("value") > 20, F.col("value") > 60).alias("tier"))


# --- regions and layout

_PAGES = "p AS (SELECT job_id, page_number, max(width)::DOUBLE AS width, max(height)::DOUBLE AS height FROM stored_pages GROUP BY ALL)"


def _placed(spark: SparkSession, d: str, column: str = "regions") -> DataFrame:
    """Results with the size of their page; 1000 by 1000 where it is missing."""
    size = _t(spark, d, "stored_pages").groupBy("job_id", "page_number").agg(F.max("width").cast("double").alias("width"), F.max("height").cast("double").alias("height"))
    r = _results(spark, d, "job_id", "page_number", column).join(size, ["job_id", "page_number"], "left")
    return r.withColumn("width", F.coalesce("width", F.lit(1000.0))).withColumn("height", F.coalesce("height", F.lit(1000.0)))


_PLACED = f"WITH {_R}, {_PAGES}, s AS (SELECT result_id, regions, coalesce(width, 1000) AS width, coalesce(height, 1000) AS height FROM r LEFT JOIN p USING (job_id, page_number))"
_FLAT = ", f AS (SELECT result_id, width, height, i - 1 AS region_idx, regions[i] AS g FROM (SELECT *, unnest(range(1, len(regions) + 1)) AS i FROM s)), v AS (SELECT result_id, region_idx, width, height, g.text AS text, g.x AS x, g.y AS y, g.w AS w, g.h AS h FROM f)"
_FINITE = " AND ".join(f"isfinite({c})" for c in "xywh")
_CLIP = "cx AS (SELECT *, greatest(0::DOUBLE, least(width, x)) AS cx, greatest(0::DOUBLE, least(height, y)) AS cy FROM v WHERE " + _FINITE + " AND " + _trim("coalesce(text, '')") + " <> ''#EXTRA#), cw AS (SELECT *, greatest(0::DOUBLE, least(width - cx, w)) AS cw, greatest(0::DOUBLE, least(height - cy, h)) AS ch FROM cx)"


def _cleaned(spark: SparkSession, d: str, before: bool) -> DataFrame:
    clean = _placed(spark, d).select("result_id", F.posexplode_outer(geo.clean_regions(F.col("regions"), F.col("width"), F.col("height"), before)).alias("place", "g")).where("place is not null")
    return clean.select("result_id", F.col("place").cast("bigint").alias("place"), "g.text", "g.x", "g.y", "g.w", "g.h")


_CLEANED = " SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY region_idx) - 1 AS place, text, cx AS x, cy AS y, cw AS w, ch AS h FROM cw WHERE cw > 0 AND ch > 0"


@query(_PLACED + _FLAT + ", " + _CLIP.replace("#EXTRA#", "") + _CLEANED)
def native_regions(spark: SparkSession, d: str) -> DataFrame:
    """P12, P14, J01."""
    return _cleaned(spark, d, before=False)


@query(_PLACED + _FLAT + ", " + _CLIP.replace("#EXTRA#", " AND w > 0 AND h > 0") + _CLEANED)
def export_regions(spark: SparkSession, d: str) -> DataFrame:
    """P13, P27, J02."""
    return _cleaned(spark, d, before=True)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    flat = _placed(spark, d).select("result_id", "width", "height", F.posexplode("regions").alias("region_idx", "g"))
    return flat.select("result_id", F.col("region_idx").cast("bigint").alias("region_idx"), "width", "height", "g.text", "g.x", "g.y", "g.w", "g.h").where(geo.finite(F.col("x")) & geo.finite(F.col("y")) & geo.finite(F.col("w")) & geo.finite(F.col("h")))


_BOXES = _PLACED + _FLAT + f", b AS (SELECT * FROM v WHERE {_FINITE})"


@query(_BOXES + ' SELECT result_id, region_idx, x / width * 100 AS "left", y / height * 100 AS top, w / width * 100 AS width, h / height * 100 AS height FROM b')
def overlays(spark: SparkSession, d: str) -> DataFrame:
    """P20, N04."""
    r = _regions(spark, d)
    return r.select("result_id", "region_idx", geo.overlay(F.struct("x", "y", "w", "h"), F.col("width"), F.col("height")).alias("o")).select("result_id", "region_idx", "o.*")


@query(_BOXES + ", c AS (SELECT *, greatest(0::DOUBLE, x - 4) AS px, greatest(0::DOUBLE, y - 4) AS py FROM b) SELECT result_id, region_idx, px AS x, py AS y, least(width - px, w + 8) AS w, least(height - py, h + 8) AS h FROM c")
def crops(spark: SparkSession, d: str) -> DataFrame:
    """P26."""
    r = _regions(spark, d)
    return r.select("result_id", "region_idx", geo.crop(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height")).alias("c")).select("result_id", "region_idx", "c.*")


@query(_BOXES + " SELECT result_id, region_idx, greatest(16, floor(h * 0.75::DOUBLE * 2 + 0.5::DOUBLE))::BIGINT AS half_points, greatest(0::DOUBLE, least(height, height - y - h + greatest(4::DOUBLE, least(48::DOUBLE, h * 0.85::DOUBLE)) * 0.2::DOUBLE)) AS baseline FROM b")
def font_sizes(spark: SparkSession, d: str) -> DataFrame:
    """F21, F22 (height bound), F24."""
    font = geo.clamp(F.col("h") * 0.85, F.lit(4.0), F.lit(48.0))
    return _regions(spark, d).select("result_id", "region_idx", geo.font_half_points(F.col("h")).cast("bigint").alias("half_points"), geo.pdf_baseline(F.col("y"), F.col("h"), font, F.col("height")).alias("baseline"))


@query(
    _PLACED.replace("SELECT result_id, regions,", "SELECT result_id, list_filter(coalesce(regions, []), lambda g: isfinite(g.x) AND isfinite(g.w) AND isfinite(g.y) AND " + _trim("coalesce(g.text, '')") + " <> '') AS regions,")
    + ", e AS (SELECT *, list_sort(list_transform(regions, lambda g: g.x)) AS xs FROM s),"
    " b AS (SELECT *, CASE WHEN len(regions) < 4 THEN []::DOUBLE[] ELSE list_transform(list_filter(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1] > width * 0.25::DOUBLE), lambda i: (xs[i] + xs[i - 1]) / 2) END AS bs FROM e),"
    " f AS (SELECT result_id, width, bs, i, regions[i] AS g FROM (SELECT *, unnest(range(1, len(regions) + 1)) AS i FROM b)),"
    " c AS (SELECT result_id, i, g, bs, CASE WHEN g.x + g.w / 2 < 0 OR g.x + g.w / 2 >= width THEN len(bs) ELSE len(list_filter(bs, lambda q: g.x + g.w / 2 >= q)) END AS column_no FROM f)"
    " SELECT result_id, (row_number() OVER (PARTITION BY result_id ORDER BY column_no, CASE WHEN len(bs) > 0 THEN g.y ELSE 0 END, i) - 1)::INT AS place, column_no::INT AS column_no, g.text AS text, g.x AS x, g.y AS y FROM c"
)
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every region with its column and its place in reading order."""
    fit = F.filter(F.coalesce("regions", F.array()), lambda g: geo.finite(g["x"]) & geo.finite(g["w"]) & geo.finite(g["y"]))
    pages_ = _placed(spark, d).select("result_id", fit.alias("regions"), "width")
    return layout.order_by_columns(pages_, "regions", "width").select("result_id", "place", "column_no", "region.text", "region.x", "region.y")


@query()
def grouped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of boxes by a fold over each page's array."""
    finite = F.filter("regions", lambda g: geo.finite(g["x"]) & geo.finite(g["y"]) & geo.finite(g["h"]))
    return layout.group_lines(_results(spark, d, "regions").select("result_id", finite.alias("regions")), "result_id")


@query()
def pdf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the PDF export, of regions in column order."""
    fit = F.filter(F.coalesce("regions", F.array()), lambda g: geo.finite(g["x"]) & geo.finite(g["y"]) & geo.finite(g["w"]) & geo.finite(g["h"]))
    pages_ = _placed(spark, d).select("result_id", fit.alias("regions"), "width")
    ordered = layout.order_by_columns(pages_, "regions", "width").groupBy("result_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "region"))), lambda r: r["region"]).alias("regions"))
    return layout.group_lines(ordered, "result_id", given_order=True)


_PREFIXES = ("", "• ", "12. ", "3) ", "- ", "1234. ", "–")


def _item_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of boxes for the layout rules: an order is a line, its items are boxes, 16 orders a page."""
    i = _t(spark, d, "lineitem")
    boxes = i.select(
        F.floor(F.col("l_orderkey") / 16).alias("page"), (F.col("l_orderkey") % 16).cast("int").alias("line_no"), (F.col("l_linenumber") - 1).alias("region_idx"), F.concat(F.when(F.col("l_linenumber") == 1, F.element_at(F.array(*map(F.lit, _PREFIXES)), (F.pmod("l_orderkey", F.lit(7)) + 1).cast("int"))).otherwise(""), F.col("l_returnflag"), F.lit(" "), F.repeat(F.col("l_linestatus"), F.when(F.col("l_suppkey") % 9 == 0, 130).otherwise(1))).alias("text"),
        ((F.col("l_linenumber") - 1) * 140.0 + F.pmod(F.col("l_quantity"), F.lit(3.0)) * 8).alias("x"), ((F.col("l_orderkey") % 16) * 30.0).alias("y"), F.lit(60.0).alias("w"), (16 + F.pmod("l_partkey", F.lit(3)) * 4.0 + F.when(F.col("l_discount") > 0.09, 20).otherwise(0)).alias("h"),
    ).dropDuplicates(["page", "line_no", "region_idx"])
    return layout.page_lines(boxes, ["page"])


_ITEMS = (
    "i AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) floor(l_orderkey / 16.0)::BIGINT AS page, (l_orderkey % 16)::INT AS line_no, l_linenumber - 1 AS region_idx, CASE WHEN l_linenumber = 1 THEN ['', '• ', '12. ', '3) ', '- ', '1234. ', '–'][(l_orderkey % 7 + 1)::INT] ELSE '' END || l_returnflag || ' ' || repeat(l_linestatus, CASE WHEN l_suppkey % 9 = 0 THEN 130 ELSE 1 END) AS text, (l_linenumber - 1) * 140::DOUBLE + (l_quantity % 3) * 8 AS x,"
    " (l_orderkey % 16) * 30::DOUBLE AS y, 60::DOUBLE AS w, 16 + (l_partkey % 3) * 4::DOUBLE + CASE WHEN l_discount > 0.09::DOUBLE THEN 20 ELSE 0 END AS h FROM lineitem ORDER BY l_orderkey, l_linenumber), g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY page, line_no ORDER BY region_idx) AS gap FROM i),"
    " l AS (SELECT page, line_no, string_agg(text, ' ' ORDER BY region_idx) AS text, min(x) AS left_edge, max(x + w) AS right_edge, min(y) AS top, max(y + h) AS bottom, list_sort(list(h))[count(*) // 2 + 1] AS median_height, avg(gap) AS mean_gap, count(*) AS n_regions, list(x ORDER BY region_idx) AS lefts FROM g GROUP BY ALL)"
)


@query(
    f"WITH {_ITEMS}, m AS (SELECT page, list_sort(list(h))[count(*) // 2 + 1] AS m FROM i GROUP BY page), k AS (SELECT l.*, CASE WHEN n_regions >= 3 AND right_edge - left_edge > 600 AND mean_gap > m * 0.8::DOUBLE THEN 'table-row' WHEN median_height > m * 1.35::DOUBLE AND length(text) < 120 THEN 'heading'"
    " WHEN regexp_matches(trim(text), '^[•–-]') THEN 'bullet' WHEN regexp_matches(trim(text), '^\\d{1,3}[.)]\\s+') THEN 'numbered' ELSE 'body' END AS kind FROM l JOIN m USING (page)),"
    " r AS (SELECT *, sum(CASE WHEN kind = 'table-row' AND before = 'table-row' THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line_no) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY page ORDER BY line_no) AS before FROM k)),"
    " c AS (SELECT *, list_filter(list_transform(range(1, least(len(lefts), coalesce(len(prev), 0)) + 1), lambda q: abs(lefts[q] - prev[q])), lambda z: z IS NOT NULL) AS ds FROM (SELECT *, lag(lefts) OVER (PARTITION BY page, run ORDER BY line_no) AS prev FROM r)),"
    " v AS (SELECT *, count(*) OVER p AS rows_, sum(len(ds)) OVER p AS checks, sum(len(list_filter(ds, lambda z: z <= 15))) OVER p AS aligned FROM c WINDOW p AS (PARTITION BY page, run))"
    " SELECT page, line_no, CASE WHEN kind = 'table-row' AND NOT (rows_ >= 2 AND coalesce(aligned / nullif(checks, 0), 0) >= 0.5) THEN 'body' ELSE kind END AS kind, CASE WHEN kind = 'numbered' THEN regexp_extract(trim(text), '^(\\d{1,3})', 1)::INT END AS list_number, n_regions, left_edge, median_height FROM v"
)
def classified_lines(spark: SparkSession, d: str) -> DataFrame:
    """F17, F18, W06, W07, J10, A03-A06."""
    lines = _item_lines(spark, d)
    kinds = layout.validate_tables(layout.classify(lines, F.lit(1000.0), layout.page_median(["page"])), ["page"])
    return kinds.select("page", "line_no", "kind", "list_number", "n_regions", "left_edge", "median_height")


@query(
    f"WITH {_ITEMS}, k AS (SELECT *, CASE WHEN median_height > 30 * 1.35::DOUBLE AND length(text) < 120 THEN 'heading' WHEN regexp_matches(trim(text), '^[•–-]') THEN 'bullet' WHEN regexp_matches(trim(text), '^\\d{{1,3}}[.)]\\s+') THEN 'numbered' ELSE 'body' END AS kind FROM l), b AS (SELECT *, lag(kind) OVER o AS pk, lag(left_edge) OVER o AS pl, lag(median_height) OVER o AS ph, lag(bottom) OVER o AS pb FROM k WINDOW o AS (PARTITION BY page ORDER BY line_no)),"
    " j AS (SELECT *, coalesce(kind = 'body' AND pk = 'body' AND abs(left_edge - pl) <= 10 AND median_height / ph BETWEEN 0.8::DOUBLE AND 1.2::DOUBLE AND top - pb <= greatest(20, 1.5::DOUBLE * ph), false) AS joins FROM b), n AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line_no)::BIGINT AS block_no FROM j)"
    " SELECT page, block_no, min(kind) AS kind, string_agg(text, ' ' ORDER BY line_no) AS text, list_sort(list(median_height))[count(*) // 2 + 1] AS median_height, arg_min(left_edge, line_no) AS left_edge, count(*) AS n_lines FROM n GROUP BY ALL"
)
def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    """W10, F19."""
    lines = layout.classify(_item_lines(spark, d), F.lit(100_000.0), F.lit(30.0))
    return layout.merge_body(lines, ["page"]).drop("cells", "list_number")


@query(
    f"WITH {_R}, l AS (SELECT result_id, unnest(string_split(text, chr(10))) AS line FROM r) SELECT CASE WHEN regexp_matches(line, '^[\\x{{2022}}\\x{{2023}}\\x{{25E6}}\\x{{2043}}\\x{{2219}}\\x{{25AA}}\\x{{25AB}}\\x{{25CF}}\\x{{25CB}}\\-\\x{{2013}}\\x{{2014}}]') THEN 'bullet'"
    " WHEN regexp_matches(line, '^(\\d{1,3})[.)]\\s+') THEN 'numbered' ELSE 'body' END AS kind, count(*) AS n FROM l WHERE line <> '' GROUP BY 1"
)
def list_items(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    line = F.col("line")
    kind = F.when(F.regexp_like(line, F.lit(txt.BULLET)), "bullet").when(F.regexp_like(line, F.lit(txt.NUMBERED)), "numbered").otherwise("body")
    return _results(spark, d, "text").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_discount AS dd, l_extendedprice AS e FROM lineitem), b AS (SELECT *, CASE WHEN dd = 0 THEN 12.0 ELSE dd * 100 END::DOUBLE AS h0 FROM a)"
    " SELECT k, n, q * 3 AS x, (800 - n * 40 - h0) * 3 AS y, CASE WHEN (q - 20) * 3 > 0 THEN (q - 20) * 3 ELSE greatest(n * (h0 * 3 * 0.4::DOUBLE), 6::DOUBLE) END AS w, h0 * 3 AS h FROM b"
)
def native_items(spark: SparkSession, d: str) -> DataFrame:
    """S02."""
    i = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity", "l_discount")
    box = geo.native_item(F.col("l_quantity"), (F.col("n") * 40).cast("double"), F.col("l_quantity") - 20, F.col("l_discount") * 100, F.lit(None).cast("double"), F.col("n"), F.lit(800.0))
    return i.select("k", "n", box.alias("b")).select("k", "n", "b.*")


@query("SELECT l_orderkey AS k, l_linenumber AS n, least(l_quantity, l_tax * 100) AS x, greatest(l_quantity, l_tax * 100) - least(l_quantity, l_tax * 100) AS w, CASE WHEN l_linenumber = 1 THEN 0::DOUBLE ELSE least(l_quantity, l_tax * 100) END AS polygon_x FROM lineitem")
def corner_boxes(spark: SparkSession, d: str) -> DataFrame:
    """P21, P22."""
    a, b = F.col("l_quantity"), F.col("l_tax") * 100
    corner = geo.from_corners(F.least(a, b), F.lit(0.0), F.greatest(a, b), F.lit(1.0))
    point = lambda x, y: F.array(x, F.lit(y))
    points = F.when(F.col("l_linenumber") > 1, F.array(point(a, 0.0), point(b, 0.0), point(b, 1.0), point(a, 1.0)))
    i = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), corner.alias("c"), geo.from_polygon(points, F.lit(100.0), F.lit(1.0)).alias("p"))
    return i.select("k", "n", "c.x", "c.w", F.col("p.x").alias("polygon_x"))


@query(
    "SELECT id, CASE WHEN width < 1500 OR height < 1500 THEN floor(width * least(greatest(1500::DOUBLE / width, 1500::DOUBLE / height, 1), 2) + 0.5) ELSE width END::BIGINT AS w, CASE WHEN width < 1500 OR height < 1500 THEN floor(height * least(greatest(1500::DOUBLE / width, 1500::DOUBLE / height, 1), 2) + 0.5) ELSE height END::BIGINT AS h"
    " FROM (SELECT DISTINCT id, width, height FROM stored_pages WHERE width > 0 AND height > 0)"
)
def upscaled_sizes(spark: SparkSession, d: str) -> DataFrame:
    """I11."""
    p = _t(spark, d, "stored_pages").select("id", "width", "height").where("width > 0 and height > 0").distinct()
    return p.select("id", geo.upscaled(F.col("width"), F.col("height"), 1500.0, 1500.0).alias("s")).select("id", F.col("s.w").cast("bigint").alias("w"), F.col("s.h").cast("bigint").alias("h"))


# --- parsing


@query(
    "WITH e AS (SELECT event_id, '<s_kind>' || event_type || '</s_kind> <s_empty> </s_empty><s_user>' || user_id || '</s_user>' AS raw, event_id % 3 = 0 AS plain, event_type, user_id FROM events)"
    " SELECT event_id, CASE WHEN plain THEN trim(event_type || ' ' || user_id) ELSE event_type || chr(10) || user_id END AS text FROM e"
)
def tagged_fields(spark: SparkSession, d: str) -> DataFrame:
    """leaf fields, or the text without tags."""
    e = _t(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"))
    tagged = F.concat(F.lit("<s_kind>"), "event_type", F.lit("</s_kind> <s_empty> </s_empty><s_user>"), "u", F.lit("</s_user>"))
    plain = F.concat(F.lit("<b>"), "event_type", F.lit("</b> \n <i>"), "u", F.lit("</i>"))
    return e.select("event_id", txt.strip_tags(F.when(F.col("event_id") % 3 == 0, plain).otherwise(tagged)).alias("text"))


@query(f"SELECT doc_id, {_trim('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#+\\s*', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '\\$([^$]+)\\$', '\\1', 'g'), '(?s)\\\\\\[.*?\\\\\\]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM documents")
def plain_markup(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    return _t(spark, d, "documents").select("doc_id", txt.strip_markup(F.col("text")).alias("text"))


@query(
    "WITH e AS (SELECT event_id, json_extract_string(props, '$.page') AS page, event_id % 5 AS k FROM events) SELECT event_id, page, ['premium', 'mock', NULL, 'basic', 'standard'][k + 1] AS engine, [NULL, 'donut', NULL, 'mgp-str', NULL][k + 1] AS model,"
    " k IN (0, 2) AS strict, k = 3 AS force_ocr, CASE WHEN k = 0 THEN '{\"blockSize\": 21}' END AS preprocess, CASE WHEN k = 1 THEN 'basic' END AS mock_profile FROM e"
)
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of an address and of a JSON text."""
    queries = (
        "engine=premium&strictEngine=1&preprocess=%7B%22blockSize%22%3A%2021%7D&mockProfile=basic", "engine=mock&model=donut&mockProfile=basic&preprocess=%7Bbad",
        "engine=other&model=other&strictEngine=true&forceOcr=yes", "engine=basic&model=mgp-str&forceOcr=true&strictEngine=0", "engine=standard&model=",
    )
    query = F.element_at(F.array(*map(F.lit, queries)), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    p = recogniser.parameters(F.concat(F.lit("https://x.test/?"), query))
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), p.alias("p")).select("event_id", "page", "p.*")


@query("SELECT id, 'data:' || coalesce(nullif(mime_type, ''), 'image/png') || ';base64,' || base64(bytes) AS url, octet_length(bytes)::INT AS size FROM (SELECT DISTINCT id, mime_type, bytes FROM stored_pages WHERE bytes IS NOT NULL)")
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as an address and back."""
    p = _t(spark, d, "stored_pages").select("id", "mime_type", "bytes").where("bytes is not null").distinct()
    url = txt.data_url(F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("image/png")), F.col("bytes"))
    return p.select("id", url.alias("url")).select("id", "url", F.octet_length(txt.data_url_bytes(F.col("url"))).alias("size"))


@query("SELECT id, 'mock' AS engine, 'page of ' || coalesce(octet_length(bytes), 0) || ' bytes' AS text, NULL::VARCHAR AS error FROM (SELECT DISTINCT id, source_kind, bytes FROM stored_pages) WHERE coalesce(source_kind <> 'pdf-text', true)")
def recognised_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without native text through the mock engine."""
    todo = pages.to_recognise(_t(spark, d, "stored_pages").select("id", "source_kind", "bytes").distinct())
    return recogniser.recognise(todo, "mock")


@query(
    "WITH t AS (SELECT * FROM (VALUES ('premium', 0::DOUBLE, 0::DOUBLE), ('standard', 2::DOUBLE / 287, 1::DOUBLE / 50), ('basic', 18::DOUBLE / 287, 14::DOUBLE / 50)) v(profile, char_error_rate, word_error_rate))"
    " SELECT *, 1 - char_error_rate AS char_accuracy, 1 - word_error_rate AS word_accuracy FROM t"
)
def profile_rates(spark: SparkSession, d: str) -> DataFrame:
    """The mock profiles against their true text; the published rates."""
    truth = recogniser.mock_page("premium")[0]
    rows = spark.createDataFrame([(p, truth, recogniser.mock_page(p)[0]) for p in recogniser.MISREAD], "profile string, expected string, actual string")
    return benchmark.metrics(rows, "expected", "actual").drop("expected", "actual")


@query(
    "SELECT DISTINCT engine, preprocess, '/?engine=' || t || '&strictEngine=1&forceOcr=1&model=' || engine || CASE WHEN preprocess IS NOT NULL THEN '&preprocess=' || url_encode(preprocess) ELSE '' END AS address"
    " FROM (SELECT DISTINCT replace(lower(trim(engine)), '_', '-') AS engine, preprocess, CASE WHEN lower(engine) LIKE '%base%' THEN 'premium' ELSE 'standard' END AS t FROM bench_results)"
)
def run_addresses(spark: SparkSession, d: str) -> DataFrame:
    """F32."""
    runs = _t(spark, d, "bench_results").select(F.regexp_replace(F.lower(F.trim("engine")), "_", "-").alias("engine"), "preprocess").distinct()
    return runs.select("engine", "preprocess", recogniser.address(F.when(F.col("engine").contains("base"), "premium").otherwise("standard"), F.col("engine"), F.col("preprocess")).alias("address"))


@query(
    f"WITH {_R}, f AS (SELECT result_id, list_filter(regions, lambda g: isfinite(g.x) AND isfinite(g.y) AND isfinite(g.w) AND isfinite(g.h)) AS gs FROM r), g AS (SELECT result_id, i - 1 AS line_no, gs[i] AS g FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS i FROM f))"
    f" SELECT result_id, line_no::INT AS line_no, {_trim('g.text')} AS text, g.x AS x0, g.y AS y0, g.x + g.w AS x1, g.y + g.h AS y1, g.confidence * 100 / 100 AS confidence FROM g WHERE {_trim('coalesce(g.text, chr(32))')} <> '' AND g.x + g.w > g.x AND g.y + g.h > g.y"
)
def detector_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of nested detector output, made of the regions."""
    fit = F.filter("regions", lambda g: geo.finite(g["x"]) & geo.finite(g["y"]) & geo.finite(g["w"]) & geo.finite(g["h"]))
    word = lambda g: F.array().cast("array<struct<text:string,x:double,y:double>>")
    line = F.transform(fit, lambda g: F.struct(g["text"].alias("text"), word(g).alias("words"), g["x"].alias("x0"), g["y"].alias("y0"), (g["x"] + g["w"]).alias("x1"), (g["y"] + g["h"]).alias("y1"), (g["confidence"] * 100).alias("confidence")))
    nested = _results(spark, d, "regions").where("regions is not null").select("result_id", F.array(F.struct(F.array(F.struct(line.alias("lines"))).alias("paragraphs"))).alias("blocks"))
    return recogniser.flatten_lines(nested, "blocks").select("result_id", "line_no", "text", "x0", "y0", "x1", "y1", "confidence")


@query(f"WITH {_R}, l AS (SELECT result_id, string_split(text, chr(10)) AS ls FROM r WHERE text IS NOT NULL) SELECT result_id, (i - 1)::INT AS line_no, ls[i] AS text, 48::DOUBLE AS x, (48 + 36 * (i - 1))::DOUBLE AS y, 500::DOUBLE AS w, 24::DOUBLE AS h FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)")
def stacked_lines(spark: SparkSession, d: str) -> DataFrame:
    """F36."""
    lines = _results(spark, d, "text").where("text is not null").select("result_id", F.posexplode(recogniser.stacked_lines(F.split("text", "\n"))).alias("line_no", "g"))
    return lines.select("result_id", "line_no", "g.*")


@query(
    "WITH RECURSIVE p AS (SELECT name, i AS paragraph_no, list_filter(regexp_split_to_array(ps[i], '\\s+'), lambda w: w <> '') AS ws FROM (SELECT name, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT name, string_split(ground_truth, chr(10)) AS ps FROM bench_fixtures))),"
    " t AS (SELECT name, paragraph_no, ws, 1 AS pos, '' AS open, NULL::VARCHAR AS done FROM p UNION ALL"
    " SELECT name, paragraph_no, ws, pos + 1, CASE WHEN pos > len(ws) THEN '' WHEN open = '' THEN ws[pos] WHEN length(open) + 1 + length(ws[pos]) <= 60 THEN open || ' ' || ws[pos] ELSE ws[pos] END,"
    " CASE WHEN pos > len(ws) THEN open WHEN open <> '' AND length(open) + 1 + length(ws[pos]) > 60 THEN open END FROM t WHERE pos <= len(ws) + 1)"
    " SELECT name, (row_number() OVER (PARTITION BY name ORDER BY paragraph_no, pos) - 1)::INT AS line_no, done AS line FROM t WHERE done IS NOT NULL"
)
def wrapped_texts(spark: SparkSession, d: str) -> DataFrame:
    """every fixture's text filled into lines of 60 characters, paragraph by paragraph."""
    return _t(spark, d, "bench_fixtures").select("name", F.posexplode(recogniser.wrapped(F.col("ground_truth"), 60)).alias("line_no", "line"))


@query(
    f"WITH {_R} SELECT result_id, i AS turn, CASE i WHEN 1 THEN coalesce(text, '') WHEN 2 THEN lang ELSE '' END AS text, CASE WHEN i = 1 THEN quality_score ELSE 0.5::DOUBLE END AS confidence, CASE WHEN i = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS x, CASE WHEN i = 1 THEN 5::DOUBLE ELSE 100::DOUBLE END AS w FROM r, (SELECT unnest([1, 2, 3]) AS i) WHERE NOT (i = 2 AND lang IS NULL)"
)
def detected_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of a detector, each with its text, score and place under another name."""
    item = "struct<text:string,value:string,confidence:double,score:double,box:array<array<double>>,points:array<array<double>>>"
    square = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 0), (6, 0), (6, 3), (1, 3))))
    no, none = F.lit(None).cast("string"), F.lit(None).cast("array<array<double>>")
    half = F.lit(0.5)
    items = F.array(
        F.struct(F.lit(1).alias("turn"), F.struct(F.col("text"), no, F.col("quality_score"), F.lit(None).cast("double"), square, none).cast(item).alias("item")),
        F.struct(F.lit(2).alias("turn"), F.struct(no, F.col("lang"), F.lit(None).cast("double"), half, none, F.slice(square, 1, 2)).cast(item).alias("item")),
        F.struct(F.lit(3).alias("turn"), F.struct(no, no, F.lit(None).cast("double"), half, none, none).cast(item).alias("item")),
    )
    flat = _results(spark, d, "text", "lang", "quality_score").select("result_id", "lang", F.explode(items).alias("i")).where("not (i.turn = 2 and lang is null)")
    found = flat.select("result_id", "i.turn", recogniser.detected(F.col("i.item"), F.lit(100.0), F.lit(50.0)).alias("f"))
    placed = found.withColumn("b", geo.from_polygon(F.col("f.points"), F.lit(100.0), F.lit(50.0)))
    return placed.select("result_id", "turn", "f.text", "f.confidence", "b.x", "b.w")


@query(_PLACED.replace("SELECT result_id, regions,", "SELECT result_id, text,") + " SELECT result_id, text, 0::DOUBLE AS x, 0::DOUBLE AS y, width AS w, height AS h FROM s WHERE coalesce(text, '') <> ''")
def whole_pages(spark: SparkSession, d: str) -> DataFrame:
    """one region of the whole page where there is a text."""
    size = _placed(spark, d, "text")
    return size.select("result_id", F.explode(recogniser.whole_page(F.col("text"), F.col("width"), F.col("height"))).alias("g")).select("result_id", "g.*")


@query(_BOXES + " SELECT result_id, region_idx, CASE WHEN greatest(w - 5 * length(text), 0) > 0 AND length(text) - length(replace(text, ' ', '')) > 0 THEN greatest(w - 5 * length(text), 0)::DOUBLE / (length(text) - length(replace(text, ' ', ''))) WHEN length(text) - length(replace(text, ' ', '')) = 0 AND length(text) > 1 THEN greatest(w - 5 * length(text), 0)::DOUBLE / (length(text) - 1) ELSE 0 END AS spare FROM b WHERE length(text) > 0")
def region_spacing(spark: SparkSession, d: str) -> DataFrame:
    """what words or characters of a region are set apart, at a width of five a character."""
    s = recogniser.spacing(F.col("w"), F.length("text") * 5.0, F.col("text"))
    return _regions(spark, d).where("length(text) > 0").select("result_id", "region_idx", (s["word"] + s["character"]).alias("spare"))


@query(_PLACED + _FLAT + " SELECT result_id, region_idx, h FROM v")
def flattened_heights(spark: SparkSession, d: str) -> DataFrame:
    """Every region's height, a row each."""
    flat = _results(spark, d, "regions").select("result_id", F.posexplode("regions").alias("region_idx", "g"))
    return flat.select("result_id", F.col("region_idx").cast("bigint").alias("region_idx"), "g.h")


@query(f"WITH {_R} SELECT result_id, i AS place, xs[i] AS edge FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT result_id, list_sort(list_filter(list_transform(regions, lambda g: g.x), lambda x: isfinite(x))) AS xs FROM r))")
def sorted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Left edges in their order."""
    xs = F.sort_array(F.filter(F.transform("regions", lambda g: g["x"]), geo.finite))
    return _results(spark, d, "regions").select("result_id", F.posexplode(xs).alias("place", "edge")).withColumn("place", F.col("place").cast("bigint") + 1)


@query(f"WITH {_R}, {_PAGES} SELECT r.result_id, r.page_number, CASE WHEN p.job_id IS NOT NULL THEN 'scanned' END AS source_kind, p.job_id IS NOT NULL AND false AS has_native_text FROM r LEFT JOIN p USING (job_id, page_number) WHERE page_number - 1 IN (0, 2, 5)")
def forced_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chosen pages, taken for scanned ones."""
    known = _t(spark, d, "stored_pages").select("job_id", "page_number").distinct()
    forced = pages.force_ocr(known.withColumn("source_kind", F.lit("pdf-text")), True)
    r = pages.selected(_results(spark, d, "job_id", "page_number").withColumn("page_index", F.col("page_number") - 1), [0, 2, -1, 5])
    return r.join(forced, ["job_id", "page_number"], "left").select("result_id", "page_number", "source_kind", F.coalesce("has_native_text", F.lit(False)).alias("has_native_text"))


@query(f"WITH {_R} SELECT result_id, coalesce(text, '') AS text, len(coalesce(regions, [])) AS regions, len(coalesce(quality_flags, [])) AS flags, source, quality_score FROM r")
def saved_results(spark: SparkSession, d: str) -> DataFrame:
    """Results as they are saved."""
    r = pages.normalised(_results(spark, d, "text", "regions", "source", "quality_score", "quality_flags"))
    return r.select("result_id", "text", F.size("regions").cast("bigint").alias("regions"), F.size("quality_flags").cast("bigint").alias("flags"), "source", "quality_score")


# --- the job store


@query(f"WITH {_J} SELECT id, updated_at, page_count FROM j")
def current_jobs(spark: SparkSession, d: str) -> DataFrame:
    """K01."""
    return _jobs(spark, d).select("id", "updated_at", "page_count")


def _now(jobs: DataFrame) -> DataFrame:
    return jobs.agg((F.max("updated_at") + F.expr("INTERVAL 5 DAYS")).alias("now"))


def _with_now(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    raw = _t(spark, d, "stored_jobs")
    return _jobs(spark, d).crossJoin(F.broadcast(_now(raw))), F.col("now")


@query(f"WITH {_J} SELECT id, expires_at FROM j WHERE expires_at < {_NOW}")
def expired_jobs(spark: SparkSession, d: str) -> DataFrame:
    """R01."""
    jobs, now = _with_now(spark, d)
    return store.expired(jobs, now).select("id", "expires_at")


_KEPT = f"kept AS (SELECT * FROM j WHERE coalesce(expires_at >= {_NOW}, true) ORDER BY updated_at DESC NULLS LAST, id LIMIT 200)"


@query(f"WITH {_J}, {_KEPT} SELECT id, updated_at FROM kept")
def retained_jobs(spark: SparkSession, d: str) -> DataFrame:
    """R02, O02, U03, J12."""
    jobs, now = _with_now(spark, d)
    return store.retained(jobs, now).select("id", "updated_at")


@query(f"WITH {_J}, {_KEPT} SELECT id, created_at, updated_at, source_name, engine_tier, page_count, average_quality FROM kept ORDER BY updated_at DESC NULLS LAST, id LIMIT 20")
def job_list(spark: SparkSession, d: str) -> DataFrame:
    """O01, P05."""
    jobs, now = _with_now(spark, d)
    return store.listing(jobs, now)


@query(f"WITH {_J}, {_KEPT} SELECT DISTINCT id, job_id, page_number FROM stored_pages WHERE job_id IN (SELECT id FROM kept)")
def pages_after_cascade(spark: SparkSession, d: str) -> DataFrame:
    """K13, J12."""
    jobs, now = _with_now(spark, d)
    return store.cascade(_t(spark, d, "stored_pages").select("id", "job_id", "page_number").distinct(), store.retained(jobs, now))


@query(f"WITH {_J} SELECT id, updated_at + INTERVAL 30 DAY AS expires, strftime(updated_at, '%Y-%m-%d') AS day FROM j")
def job_expiry(spark: SparkSession, d: str) -> DataFrame:
    """R03, R04."""
    return _jobs(spark, d).select("id", store.expiry(F.col("updated_at")).alias("expires"), F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query("SELECT DISTINCT job_id || ':' || page_number AS id, job_id, page_number, coalesce(nullif(mime_type, ''), 'image/png') AS mime_type FROM stored_pages")
def page_records(spark: SparkSession, d: str) -> DataFrame:
    """P02, P06."""
    return store.page_keys(_t(spark, d, "stored_pages")).distinct()


@query("SELECT job_id, arg_min(octet_length(bytes), id) FILTER (kind = 'pdf')::INT AS pdf_bytes, arg_min(octet_length(bytes), id) FILTER (kind = 'docx')::INT AS docx_bytes FROM stored_artifacts GROUP BY job_id")
def job_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """J04, P03."""
    return store.artifacts_by_job(_t(spark, d, "stored_artifacts"))


@query(f"WITH {_J}, p AS (SELECT DISTINCT job_id, page_number FROM stored_pages) SELECT j.id, page_number, row_number() OVER (PARTITION BY j.id ORDER BY page_number)::BIGINT AS place, count(*) OVER (PARTITION BY j.id)::BIGINT AS total FROM j JOIN p ON job_id = j.id")
def loaded_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Each job's pages in their order, a row a page, as one job may have any number of them."""
    p = _t(spark, d, "stored_pages").select(F.col("job_id").alias("id"), "page_number").distinct()
    return pages.ranked(_jobs(spark, d).select("id").join(p, "id"), "id", "page_number").withColumnRenamed("rank", "place")


@query("WITH p AS (SELECT job_id, page_number, min(source_kind) AS source_kind FROM stored_pages GROUP BY ALL) SELECT job_id, bool_and(source_kind = 'pdf-text') AND count(*) > 0 AS reuse_original, count(*) AS pages FROM p GROUP BY job_id")
def original_reuse(spark: SparkSession, d: str) -> DataFrame:
    """K04, A12."""
    p = _t(spark, d, "stored_pages").groupBy("job_id", "page_number").agg(F.min("source_kind").alias("source_kind"))
    return store.pass_through(p)


@query(f"WITH {_J} SELECT id, coalesce(page_count, 0) || ' pages · ' || CAST(floor(coalesce(average_quality, 0) * 100 + 0.5) AS BIGINT) || '% avg · ' || strftime(updated_at, '%Y-%m-%d') AS label FROM j WHERE coalesce(average_quality, 0) BETWEEN 0 AND 1")
def history_labels(spark: SparkSession, d: str) -> DataFrame:
    """F26, F28, F35."""
    j = _jobs(spark, d).where(F.coalesce("average_quality", F.lit(0.0)).between(0, 1))
    values = {"n": F.coalesce("page_count", F.lit(0)), "q": txt.js_round(F.coalesce("average_quality", F.lit(0.0)) * 100), "day": F.date_format("updated_at", "yyyy-MM-dd")}
    return j.select("id", txt.message(F.lit("{n} pages · {q}% avg · {day}"), values).alias("label"))


@query(f"WITH {_J} SELECT id, created_at, updated_at, source_name, engine_tier, page_count, average_quality, expires_at FROM j")
def stored_job_records(spark: SparkSession, d: str) -> DataFrame:
    """A job's own columns, without pages and results."""
    return _jobs(spark, d).select("id", "created_at", "updated_at", "source_name", "engine_tier", "page_count", "average_quality", "expires_at")


@query("WITH u AS (SELECT 'page' AS kind, id FROM stored_pages UNION ALL SELECT 'artifact', id FROM stored_artifacts UNION ALL SELECT 'job', id FROM stored_jobs) SELECT kind, count(*) AS records, count(DISTINCT id) AS ids FROM u GROUP BY kind")
def store_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The three stores' records together, by kind."""
    kinds = {"page": "stored_pages", "artifact": "stored_artifacts", "job": "stored_jobs"}
    parts = [_t(spark, d, t).select(F.lit(k).alias("kind"), "id") for k, t in kinds.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind").agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


@query("WITH a AS (SELECT job_id, arg_min(bytes, id) AS original FROM stored_artifacts WHERE kind = 'pdf' GROUP BY job_id), p AS (SELECT job_id, bool_and(k = 'pdf-text') AS reuse FROM (SELECT job_id, page_number, min(source_kind) AS k FROM stored_pages GROUP BY ALL) GROUP BY job_id) SELECT job_id AS id, CASE WHEN coalesce(reuse, true) AND original IS NOT NULL THEN md5(original) ELSE md5('made') END AS digest FROM p LEFT JOIN a USING (job_id)")
def exported_files(spark: SparkSession, d: str) -> DataFrame:
    """The original file's bytes where they serve, else a made file's."""
    reuse = store.pass_through(_t(spark, d, "stored_pages").groupBy("job_id", "page_number").agg(F.min("source_kind").alias("source_kind")))
    first = _t(spark, d, "stored_artifacts").where("kind = 'pdf'").groupBy("job_id").agg(F.min_by("bytes", "id").alias("original"))
    jobs = reuse.select(F.col("job_id").alias("id")).join(first.withColumnRenamed("job_id", "id"), "id", "left")
    made = reuse.select(F.col("job_id").alias("id"), F.lit(bytearray(b"made")).alias("made"))
    return store.original_or(jobs, reuse, made).select("id", F.md5("pdf").alias("digest"))


# --- benchmarks

_B = "b AS (SELECT DISTINCT ON (bench_id) bench_id, replace(lower(trim(engine)), '_', '-') AS engine, fixture, preprocess, extracted_text, elapsed_ms FROM bench_results ORDER BY bench_id)"
_OK = "o AS (SELECT b.*, f.ground_truth, trim(regexp_replace(lower(ground_truth), '{0}+', ' ', 'g'), ' ') AS e, trim(regexp_replace(lower(extracted_text), '{0}+', ' ', 'g'), ' ') AS a FROM b JOIN bench_fixtures f ON f.name = b.fixture WHERE length(extracted_text) > 0 AND NOT extracted_text LIKE 'ERROR%')".format(_WS)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "bench_results").select("bench_id", F.regexp_replace(F.lower(F.trim("engine")), "_", "-").alias("engine"), "fixture", "preprocess", "extracted_text", "elapsed_ms")
    return _once(b, "bench_id")


def _rated(spark: SparkSession, d: str) -> DataFrame:
    truth = _t(spark, d, "bench_fixtures").select(F.col("name").alias("fixture"), "ground_truth")
    return benchmark.rated(benchmark.successful(_runs(spark, d)).join(F.broadcast(truth), "fixture"), "ground_truth", "extracted_text").withColumnRenamed("char_error_rate", "cer").withColumnRenamed("word_error_rate", "wer")


@query(f"WITH {_B}, {_OK} SELECT bench_id, levenshtein(e, a)::DOUBLE / length(e) AS cer FROM o")
def character_rates(spark: SparkSession, d: str) -> DataFrame:
    """F02, F03, J11, P16."""
    return _rated(spark, d).select("bench_id", "cer")


@query(
    f"WITH {_B}, {_OK}, d AS (SELECT DISTINCT e, a FROM o), t AS (SELECT *, list_filter(string_split(e, ' '), lambda w: w <> '') AS we, list_filter(string_split(a, ' '), lambda w: w <> '') AS wa FROM d),"
    " k AS (SELECT *, list_distinct(list_concat(we, wa)) AS ws FROM t), c AS (SELECT *, array_to_string(list_transform(we, lambda w: chr((list_position(ws, w) + 1)::INT)), '') AS ce, array_to_string(list_transform(wa, lambda w: chr((list_position(ws, w) + 1)::INT)), '') AS ca FROM k),"
    " m AS (SELECT e, a, levenshtein(e, a)::DOUBLE / length(e) AS cer, levenshtein(ce, ca)::DOUBLE / len(we) AS wer FROM c)"
    " SELECT bench_id, cer AS char_error_rate, wer AS word_error_rate, greatest(0::DOUBLE, least(1::DOUBLE, 1 - cer)) AS char_accuracy, greatest(0::DOUBLE, least(1::DOUBLE, 1 - wer)) AS word_accuracy FROM o JOIN m USING (e, a)"
)
def word_rates(spark: SparkSession, d: str) -> DataFrame:
    """F04, F05."""
    truth = _t(spark, d, "bench_fixtures").select(F.col("name").alias("fixture"), "ground_truth")
    runs = benchmark.successful(_runs(spark, d)).join(F.broadcast(truth), "fixture")
    return benchmark.metrics(runs, "ground_truth", "extracted_text").select("bench_id", "char_error_rate", "word_error_rate", "char_accuracy", "word_accuracy")


@query(f"WITH {_B}, {_OK}, c AS (SELECT *, levenshtein(e, a)::DOUBLE / length(e) AS cer FROM o), m AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY cer, bench_id) AS n FROM c) SELECT f.name AS fixture, m.bench_id, m.cer FROM bench_fixtures f LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON m.fixture = f.name")
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    """A08, O07."""
    keys = _t(spark, d, "bench_fixtures").select(F.col("name").alias("fixture"))
    return benchmark.best_by(_rated(spark, d), keys, "fixture", "cer", "bench_id")


@query(f"WITH {_B} SELECT count(*) AS runs, count(DISTINCT engine) AS engines, count(DISTINCT fixture) AS fixtures, count(DISTINCT preprocess) AS preprocesses FROM b")
def benchmark_counts(spark: SparkSession, d: str) -> DataFrame:
    """A07, U02."""
    return _runs(spark, d).agg(F.count("*").alias("runs"), F.countDistinct("engine").alias("engines"), F.countDistinct("fixture").alias("fixtures"), F.countDistinct("preprocess").alias("preprocesses"))


@query("SELECT bench_id, 320 * greatest(0::DOUBLE, least(1::DOUBLE, metrics.char_accuracy)) AS bar FROM (SELECT DISTINCT ON (bench_id) * FROM bench_results ORDER BY bench_id) WHERE metrics.char_accuracy IS NOT NULL")
def chart_bars(spark: SparkSession, d: str) -> DataFrame:
    """F29, F06."""
    b = _once(_t(spark, d, "bench_results").select("bench_id", F.col("metrics.char_accuracy").alias("accuracy")), "bench_id")
    return b.where("accuracy is not null").select("bench_id", recogniser.bar_width(F.lit(320.0), F.col("accuracy")).alias("bar"))


@query("WITH w AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 4 AS w FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber)), t AS (SELECT *, sum(w) OVER (PARTITION BY k) AS total, max(w) OVER (PARTITION BY k) AS widest, count(*) OVER (PARTITION BY k) AS columns FROM w) SELECT k, n, CASE WHEN total > 500 THEN w * (500 / total) ELSE w END AS w, widest, columns FROM t")
def scaled_columns(spark: SparkSession, d: str) -> DataFrame:
    """Widths of a table's columns, scaled to 500 where they are more, its widest, and how many."""
    i = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 4).alias("w")).dropDuplicates(["k", "n"])
    table = i.groupBy("k").agg(F.max("w").alias("widest"), F.count("*").alias("columns"))
    return recogniser.scaled_widths(i, "k", "w", 500.0).join(table, "k").select("k", "n", "w", "widest", "columns")


@query(f"WITH {_B}, {_OK}, c AS (SELECT engine, preprocess, levenshtein(e, a)::DOUBLE / length(e) AS cer FROM o) SELECT engine, count(*) AS runs, round(avg(cer), 9) AS cer, '| ' || engine || ' | ' || count(*) || ' |' AS line, regexp_replace(engine, '[^a-zA-Z0-9-]', '_', 'g') AS label FROM c GROUP BY engine")
def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """K08, N05, F33."""
    r = _rated(spark, d).groupBy("engine").agg(F.count("*").alias("runs"), F.round(F.avg("cer"), 9).alias("cer"))
    return r.withColumn("line", F.format_string("| %s | %d |", "engine", "runs")).withColumn("label", txt.safe_label(F.col("engine")))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Every combination with its place ``i`` in the grid's order."""
    runs = _runs(spark, d)
    engines = runs.where(F.col("engine").contains("trocr") | (F.col("engine") == "donut")).select("engine").distinct()
    return benchmark.grid(engines, _t(spark, d, "bench_fixtures").select(F.col("name").alias("fixture")), runs.select("preprocess").distinct())


@query(f"WITH {_B}, e AS (SELECT DISTINCT engine FROM b WHERE engine LIKE '%trocr%' OR engine = 'donut'), p AS (SELECT DISTINCT preprocess FROM b), g AS (SELECT engine, name AS fixture, preprocess FROM e, bench_fixtures, p) SELECT * FROM (SELECT *, row_number() OVER (ORDER BY engine, fixture, preprocess) - 1 AS i FROM g) WHERE i % 3 = 1")
def benchmark_grid(spark: SparkSession, d: str) -> DataFrame:
    """J09, P17, P18."""
    return benchmark.shard(_grid(spark, d), "i", 3, 1)


@query(f"WITH {_B}, e AS (SELECT DISTINCT engine FROM b WHERE engine LIKE '%trocr%' OR engine = 'donut'), p AS (SELECT DISTINCT preprocess FROM b), g AS (SELECT engine, name AS fixture, preprocess FROM e, bench_fixtures, p) SELECT *, i % 3 AS shard FROM (SELECT *, row_number() OVER (ORDER BY engine, fixture, preprocess) - 1 AS i FROM g)")
def benchmark_whole_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid, with the shard of three that each row is in."""
    return _grid(spark, d).withColumn("shard", F.col("i") % 3)


@query(f"WITH {_B} SELECT bench_id, left(replace(extracted_text, chr(10), ' '), 70) || CASE WHEN length(extracted_text) > 70 THEN '...' ELSE '' END AS note FROM b")
def output_notes(spark: SparkSession, d: str) -> DataFrame:
    """F27, O08."""
    return _runs(spark, d).select("bench_id", txt.note(F.col("extracted_text")).alias("note"))


@query("SELECT name, i - 1 AS chunk_no, chunk FROM (SELECT name, unnest(range(1, len(cs) + 1)) AS i, cs[i] AS chunk FROM (SELECT name, regexp_extract_all(ground_truth, '.{1,70}(?:\\s|$)') AS cs FROM bench_fixtures))")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """F31."""
    chunks = F.regexp_extract_all("ground_truth", F.lit(r".{1,70}(?:\s|$)"), 0)
    return _t(spark, d, "bench_fixtures").select("name", F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every page: lines, their kinds, tables and paragraphs."""
    fit = F.filter(F.coalesce("regions", F.array()), lambda g: geo.finite(g["x"]) & geo.finite(g["y"]) & geo.finite(g["w"]) & geo.finite(g["h"]))
    placed = _placed(spark, d)
    lines = layout.page_lines(layout.group_lines(placed.select("result_id", fit.alias("regions")), "result_id"), ["result_id"])
    sized = lines.join(placed.select("result_id", "width"), "result_id").withColumn("page_median", layout.page_median(["result_id"]))
    kinds = layout.validate_tables(layout.classify(sized, F.col("width"), F.col("page_median")), ["result_id"])
    medians = kinds.groupBy("result_id").agg(F.max("page_median").alias("median"), F.max("width").alias("width"))
    return layout.merge_body(kinds, ["result_id"]).join(medians, "result_id")


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every page's blocks."""
    return _blocks(spark, d).select("result_id", "block_no", "kind", "text", "n_lines")


@query()
def docx_files(spark: SparkSession, d: str) -> DataFrame:
    """A document of each job's results, by volumes, and its size."""
    of = _results(spark, d, "job_id", "page_number")
    blocks = _blocks(spark, d).join(of, "result_id").select("job_id", "page_number", "block_no", "kind", "text", F.col("median_height").alias("height"), "cells", "median", "width")
    return exports.documents(blocks).select("job_id", "volume", F.octet_length("docx").alias("size"))


@query()
def searchable_files(spark: SparkSession, d: str) -> DataFrame:
    """A searchable PDF of each job's pages, by volumes, and its size."""
    p = _t(spark, d, "stored_pages").groupBy("job_id", "page_number").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("bytes").alias("image"))
    last = _results(spark, d, "job_id", "page_number", "regions").groupBy("job_id", "page_number").agg(F.max_by("regions", "result_id").alias("regions"))
    return exports.searchable(p.join(last, ["job_id", "page_number"], "left")).select("job_id", "volume", F.octet_length("pdf").alias("size"))


# --- images

_PX = "px AS (SELECT vec_id AS img, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, floor((embedding[i]::DOUBLE + 1) * 127.5::DOUBLE + 0.5::DOUBLE)))::INT AS g FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_NEAR = "(SELECT a.img, a.y, a.x, a.g, b.g AS v FROM px a JOIN px b ON a.img = b.img AND abs(a.y - b.y) <= {0} AND abs(a.x - b.x) <= {0})"
_BOX = f"bx AS (SELECT img, y, x, g, sum(v)::DOUBLE / count(*) AS mean, sum(v * v)::DOUBLE / count(*) AS sq FROM {_NEAR.format(2)} GROUP BY ALL)"


def _filtered(spark: SparkSession, d: str, step: Callable) -> DataFrame:
    return pixels_numpy.filtered(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, step)


def _px(spark: SparkSession, d: str) -> DataFrame:
    return pixels.from_values(_t(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query(f"WITH {_PX} SELECT a.img, a.y::INT AS y, a.x::INT AS x, sum(b.g)::BIGINT AS s FROM px a JOIN px b ON a.img = b.img AND b.y <= a.y AND b.x <= a.x GROUP BY ALL")
def integral_images(spark: SparkSession, d: str) -> DataFrame:
    """W01."""
    return pixels.integral(_px(spark, d)).select("img", "y", "x", "s")


@query(f"WITH {_PX} SELECT img, g, n, sum(n) OVER (PARTITION BY img ORDER BY g)::BIGINT AS cumulative FROM (SELECT img, g, count(*) AS n FROM px GROUP BY ALL)")
def image_histograms(spark: SparkSession, d: str) -> DataFrame:
    """A09, W12."""
    return pixels.histogram(_px(spark, d))


@query(f"WITH {_PX}, n9 AS (SELECT a.img, a.y, a.x, b.g AS v FROM px a, (SELECT unnest([-1, 0, 1]) AS dy) dy, (SELECT unnest([-1, 0, 1]) AS dx) dx, px b WHERE b.img = a.img AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx))) SELECT img, y::INT AS y, x::INT AS x, list_sort(list(v))[5] AS g FROM n9 GROUP BY ALL")
def median_filtered(spark: SparkSession, d: str) -> DataFrame:
    """W03, I04."""
    return _filtered(spark, d, pixels_numpy.median3)


@query(f"WITH {_PX}, e AS (SELECT img, y, x, min(v) AS g FROM {_NEAR.format(1)} GROUP BY ALL), o AS (SELECT a.img, a.y, a.x, max(b.g) AS g FROM e a JOIN e b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT img, y::INT AS y, x::INT AS x, g FROM o")
def opened_images(spark: SparkSession, d: str) -> DataFrame:
    """W04, W05, I10."""
    return _filtered(spark, d, lambda g: pixels_numpy.dilate(pixels_numpy.erode(g)))


@query(f"WITH {_PX} SELECT img, avg(g)::DOUBLE AS mean FROM px GROUP BY img")
def mean_intensities(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return _px(spark, d).groupBy("img").agg(F.avg("g").alias("mean"))


@query(f"WITH {_PX}, {_BOX} SELECT img, y::INT AS y, x::INT AS x, CASE WHEN g > mean - 5 THEN 255 ELSE 0 END AS g FROM bx")
def adaptive_binarised(spark: SparkSession, d: str) -> DataFrame:
    """W02, I07."""
    return _filtered(spark, d, lambda g: pixels_numpy.adaptive(g, 5, 5.0))


@query(f"WITH {_PX}, {_BOX} SELECT img, y::INT AS y, x::INT AS x, CASE WHEN g > mean * (1 + 0.2::DOUBLE * (sqrt(greatest(0::DOUBLE, sq - mean * mean)) / 128 - 1)) THEN 255 ELSE 0 END AS g FROM bx")
def sauvola_binarised(spark: SparkSession, d: str) -> DataFrame:
    """I08, A11."""
    return _filtered(spark, d, lambda g: pixels_numpy.sauvola(g, 5, 0.2))


@query(f"WITH {_PX}, {_BOX} SELECT img, y::INT AS y, x::INT AS x, greatest(0, least(255, floor(g + 0.5::DOUBLE * (g - mean) + 0.5::DOUBLE)))::INT AS g FROM bx")
def sharpened(spark: SparkSession, d: str) -> DataFrame:
    """I03."""
    return _filtered(spark, d, lambda g: pixels_numpy.sharpen(g, 2, 0.5))


@query(
    f"WITH {_PX}, c AS (SELECT img, g, count(*) AS n FROM px GROUP BY ALL), r AS (SELECT img, g, sum(n) OVER w AS w0, sum(n * g) OVER w AS s0, sum(n) OVER a AS w, sum(n * g) OVER a AS s FROM c WINDOW w AS (PARTITION BY img ORDER BY g), a AS (PARTITION BY img)),"
    " v AS (SELECT img, g, CASE WHEN w = w0 THEN 0 ELSE w0::DOUBLE * (w - w0)::DOUBLE * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) END AS v FROM r) SELECT img, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, g) AS k FROM v) WHERE k = 1"
)
def otsu_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """I09, A14."""
    return pixels.otsu_threshold(_px(spark, d))


@query("SELECT l_orderkey AS k, l_linenumber AS n, floor((l_quantity % 256) * 0.299::DOUBLE + (l_partkey % 256) * 0.587::DOUBLE + (l_suppkey % 256) * 0.114::DOUBLE + 0.5::DOUBLE)::BIGINT AS g FROM lineitem")
def gray_values(spark: SparkSession, d: str) -> DataFrame:
    """I01."""
    g = pixels.gray(F.col("l_quantity") % 256, F.col("l_partkey") % 256, F.col("l_suppkey") % 256)
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), g.alias("g"))


@query()
def prepared_images(spark: SparkSession, d: str) -> DataFrame:
    """Every image through contrast, deskewing and binarising, and its skew."""
    return pixels_numpy.prepare_values(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, pixels_numpy.Preparation(contrast=True, deskew=True, sauvola=True, block=5))


@query(f"WITH {_PX} SELECT img, y::INT AS y, x::INT AS x, g FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def cropped_images(spark: SparkSession, d: str) -> DataFrame:
    """I14."""
    return _px(spark, d).where(F.col("y").between(2, 5) & F.col("x").between(1, 6))
