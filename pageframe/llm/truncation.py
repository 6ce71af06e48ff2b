"""Problem 1: texts cut off by field limits or in transfer.

Every text's length is counted under several encodings. Grouped by source and
encoding, lengths at which far more texts end than at the lengths around may be
storage limits; of the encodings under which the same texts stand out, the
likeliest is the limit's. Then the endings are inspected. How often a text that
is cut, and one that is whole, ends in each way is learnt by
expectation-maximization, with the limits as what is known of the cuts, and a
text is truncated if that is likelier than not, by its length, source and ending.
Where the true text is known, as for benchmark fixtures, the ending is looked
up in it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable
from difflib import SequenceMatcher, get_close_matches

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pageframe.llm._common import map_columns, materialise
from pageframe.llm.shape import ShapeModel, shape_of

#: Lengths on either side that tell how many texts to expect at one, the log
#: likelihood ratio from which more than that are a limit (chance passes it at
#: one of a million lengths), and the share of a limit's texts that must be more.
NEAR, LIKELY, MORE = 25, 14.0, 0.5
#: Rounds of expectation-maximization, texts' worth of the belief they start from.
ROUNDS, BELIEF = 60, 50.0


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text under each encoding that a store may count in.

    Null for null. ``html`` counts the entities of ``& < > "``, ``json`` the
    escapes of quotes, strokes, line feeds and tabs, ``crlf`` a line end as two.
    """
    n = F.length(text)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    count = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    json = count('"') + count("\\") + count("\n") + count("\r") + count("\t")
    html = 4 * count("&") + 3 * count("<") + 3 * count(">") + 5 * count('"')
    utf8 = F.octet_length(text)
    return {
        "characters": n,
        "utf8_bytes": utf8,
        "utf16_units": (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"),
        "characters_crlf": n + breaks,
        "utf8_bytes_crlf": utf8 + breaks,
        "characters_json": n + json,
        "utf8_bytes_json": utf8 + json,
        "characters_html": n + html,
        "utf8_bytes_html": utf8 + html,
    }


ENCODINGS = ("characters", "utf8_bytes", "utf16_units", "characters_crlf", "utf8_bytes_crlf", "characters_json", "utf8_bytes_json", "characters_html", "utf8_bytes_html")


def length_counts(df: DataFrame, source_column: str, text_column: str) -> DataFrame:
    """Texts by source, encoding and length; blank and null texts are left out."""
    kinds = F.array(*(F.struct(F.lit(k).alias("encoding"), c.alias("length")) for k, c in lengths(F.col(text_column)).items()))
    every = df.where(F.length(F.trim(F.col(text_column))) > 0).select(F.coalesce(F.col(source_column), F.lit("")).alias("origin"), F.explode(kinds).alias("e"))
    return every.groupBy("origin", "e.encoding", "e.length").agg(F.count("*").alias("n"))


def _sizes(text: Column) -> Column:
    """The lengths in the order of ``ENCODINGS``."""
    by = lengths(text)
    return F.array(*(by[k] for k in ENCODINGS))


def _evidence(n: Column | float, expected: Column | float) -> Column:
    """Log likelihood ratio of a count above the expected one, of Poisson counts."""
    return n * F.log(n / expected) - (n - expected)


def _candidates(sized: DataFrame) -> list[Row]:
    """origin, encoding, length, n, expected of the lengths that stand out, of distinct texts' ``sizes``.

    Rows on the driver are those of lengths that pass ``LIKELY`` only.
    """
    # distinct texts count, as one that is delivered often is no limit
    counts = sized.select("origin", F.posexplode("sizes").alias("encoding", "length")).groupBy("origin", "encoding", "length").agg(F.count("*").alias("n"))
    # the lengths around, without a self-join: each count is spread over the lengths it bears on
    spread = counts.select("origin", "encoding", F.explode(F.sequence(F.col("length") - NEAR, F.col("length") + NEAR)).alias("at"), "length", "n")
    around = spread.groupBy("origin", "encoding", F.col("at").alias("length")).agg(
        F.sum(F.when(F.col("at") == F.col("length"), F.col("n"))).alias("n"), (F.sum(F.when(F.col("at") != F.col("length"), F.col("n")).otherwise(0)) / (2 * NEAR)).alias("around")
    )
    expected = around.where("n is not null").withColumn("expected", F.greatest("around", F.lit(1 / (2 * NEAR))))
    return expected.where((F.col("n") * MORE > F.col("expected")) & (_evidence(F.col("n"), F.col("expected")) > LIKELY)).select("origin", "encoding", "length", "n", "expected").collect()


Limit = tuple[str, int, int]


def _resolve(candidates: list[Row], patterns: dict[tuple[Limit, ...], int]) -> dict[Limit, tuple[int, float]]:
    """The limits, as (origin, encoding, length), with their texts and the expected ones.

    ``patterns`` has how many texts stand at each set of candidates. The
    likeliest candidate is a limit; its texts are taken away before the next is
    looked for, so that one limit isn't seen again under encodings that count
    some of its texts alike. Where all its texts are, the first of
    ``ENCODINGS`` is taken.
    """
    expected = {(r["origin"], r["encoding"], r["length"]): r["expected"] for r in candidates}
    left, out = dict(patterns), {}
    while left:
        n: dict[Limit, int] = defaultdict(int)
        for at, k in left.items():
            for c in at:
                n[c] += k
        ratio = {c: k * math.log(k / expected[c]) - (k - expected[c]) for c, k in n.items() if k * MORE > expected[c]}
        best = max(ratio, key=lambda c: (ratio[c], -c[1], c), default=None)
        if best is None or ratio[best] < LIKELY:
            break
        # of those at which all of its texts stand, the first encoding
        best = min(set.intersection(*(set(at) for at in left if best in at)) & ratio.keys(), key=lambda c: c[1:])
        out[best] = n[best], expected[best]
        left = {at: k for at, k in left.items() if best not in at}
    return out


def _limits(sized: DataFrame) -> dict[Limit, tuple[int, float]]:
    """The hidden limits of ``sized``: origin and ``sizes`` of distinct texts."""
    candidates = _candidates(sized)
    if not candidates:
        return {}
    at: dict[str, list[Limit]] = defaultdict(list)
    for r in candidates:
        at[r["origin"]].append((r["origin"], r["encoding"], r["length"]))
    spark = sized.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k, v) for k, v in at.items()], "origin string, wanted array<struct<origin:string,encoding:int,length:int>>"))
    here = F.filter("wanted", lambda c: F.col("sizes")[c["encoding"]] == c["length"])
    patterns = sized.join(wanted, "origin").select(here.alias("here")).where(F.size("here") > 0).groupBy("here").agg(F.count("*").alias("n"))
    return _resolve(candidates, {tuple((c["origin"], c["encoding"], c["length"]) for c in r["here"]): r["n"] for r in patterns.toLocalIterator()})


def hidden_limits(df: DataFrame, source_column: str, text_column: str) -> DataFrame:
    """origin, encoding, length, n and expected: the lengths at which a source's texts are cut, a row a limit.

    Distinct texts count; null and blank ones, of white space of any kind, are
    left out. The lengths are worked out once and kept in the shared folder. The
    driver gets the lengths that stand out, and how many texts stand at each set
    of them. An empty table has no limits.
    """
    origin = F.coalesce(F.col(source_column), F.lit("")).alias("origin")
    text = F.col(text_column)
    sized = df.where(F.regexp_like(text, F.lit(r"\S"))).select(origin, F.xxhash64(text).alias("text"), _sizes(text).alias("sizes"))
    return _as_table(df.sparkSession, _limits(materialise(sized.dropDuplicates(["origin", "text"])).select("origin", "sizes")))


def _as_table(spark: SparkSession, found: dict[Limit, tuple[int, float]]) -> DataFrame:
    rows = [(o, ENCODINGS[e], length, n, expected) for (o, e, length), (n, expected) in sorted(found.items())]
    return spark.createDataFrame(rows, "origin string, encoding string, length int, n bigint, expected double")


# --- endings

_SPACE = re.compile(r"\s+")
# Months of the six languages, which stand in the date of a sign-off.
MONTHS = frozenset(
    """
    january february march april may june july august september october november december
    ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie
    januar februar märz april mai juni juli august september oktober november dezember
    janvier février mars avril mai juin juillet août septembre octobre novembre décembre
    enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
    gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
    """.split()
)
_PAGE = re.compile(
    r"[\W_]*(?:(?:page|seite|pagina|página|pag|pág|p|s|blatt|folio|fol)[.\s]*)?\d{1,6}(?:\s*(?:/|of|von|de|din|di|sur|aus)\s*\d{1,6})?[^\w.,;:!?%]*", re.I
)
_FULL = re.compile(r"(?:[^\W\d_][^\s.]{0,40}[^\s.]|[^\s.]{1,40}[^\W\d_]|\d{3,}|[)\]%\"»”’])[.!?…][\"»”’)\]]*$")
_CUT_MARK = re.compile(r"[^\W_](?:\.{3}|…)$")
_CITES = re.compile(r"\W*(?:\d+[.)]\s*)?(?:see|voir|siehe|véase|si veda|a se vedea|compare|comparer|vergleiche|compárese|si confronti|a se compara)\b", re.I)
_MARKED = re.compile(r"\s*(?:[-*+•‣◦▪·☐☑✓–—]\s|[(\[]?(?:[a-z]|[ivx]{1,4})[.)\]]\s)")
_CASE = re.compile(r"\d+[-–/]\d+|\w+_\d+/\d{4}|\bC-\d+/\d+")
_COURT = re.compile(r"court|tribunal|judec|gericht|audiencia|juzgado|corte|cour\b|pretura|registry", re.I)
_SHORT = re.compile(r"\b(?:no|nr|nos|art|arts|sec|para|cf|dr|mr|mrs|ms|v|vs|p|pp|s|st|abs|bzw|num|núm|al|lit|vol|ch|z|d|h|e)\.$", re.I)


def is_header(line: str) -> bool:
    """A running header: a court's or a case's name, perhaps with a number, and no sentence."""
    line = line.strip()
    if not line or len(line) > 90 or line[-1] in ".;:,!?" or len(line.split()) > 14:
        return False
    if _CITES.match(line) or re.match(r"\d+[.)]\s", line):
        return False
    bare = re.sub(r"^\W*\d{1,6}\W+|\W+\d{1,6}\W*$|[|·•]", " ", line).strip()
    named = [w for w in re.findall(r"[^\W\d_]+", bare) if len(w) > 2]
    capital = sum(w[0].isupper() for w in named)
    if named and named[0][0].isupper() and capital >= len(named) - 1 and any(w[0].isupper() and _COURT.search(w) for w in named):
        return True
    return bool(re.search(r"\S\s+(?:[vV]|\./\.)\.?\s+\S", bare)) and capital == len(named) and bool(named)


def is_furniture(line: str) -> bool:
    """A page number or a running header."""
    return bool(_PAGE.fullmatch(line.strip())) or is_header(line)


def is_sign_off(line: str, before: str) -> bool:
    """A short line of its own that ends in a date and starts a sentence with a place in it."""
    words = line.split()
    if not 3 <= len(words) <= 10 or not words[0][0].isupper() or not re.fullmatch(r"\d{4}\W?", words[-1]):
        return False
    if before and not _FULL.search(before) and not is_furniture(before):
        return False
    month = any(get_close_matches(w.strip(".,").lower(), MONTHS, 1, 0.7) for w in words[-4:-1] if len(w) > 2)
    capital = sum(w[:1].isupper() for w in words[1:4])
    return month and capital >= 1 and len(words[1]) <= 3


def is_item(line: str) -> bool:
    """An item of a list within prose, or a row of cells."""
    return bool(_MARKED.match(line)) or "\t" in line or line.count("|") > 1 or line.rstrip().endswith(";")


#: How a text may end: with a sentence; with furniture, a sign-off or an item, after
#: a line that is finished or open; with an abbreviation's stop; with cut marks; or
#: inside a word or sentence. What a text that ends so is first taken for: the share
#: of such endings among cut texts, and among whole ones.
ENDINGS = {"sentence": (0.03, 0.7), "number": (0.01, 0.1), "header": (0.01, 0.05), "sign-off": (0.01, 0.05), "item": (0.02, 0.05), "open, number": (0.01, 0.02), "open, header": (0.01, 0.01), "open, sign-off": (0.01, 0.01), "open, item": (0.02, 0.01), "abbreviation": (0.05, 0.001), "marks": (0.05, 0.001), "open": (0.8, 0.001)}
_SHORT_OF = ("abbreviation", "marks", "open")
#: What a complete text ends with, whatever its length: these endings count for the shares, and are no cases.
COMPLETE = ("sentence", "number", "header", "sign-off", "item", "open, number")


def ending(text: str | None) -> str | None:
    """How a text of prose ends, one of ``ENDINGS``; None for a null or blank text.

    A last mark that may be an abbreviation's or an ordinal's does not end a
    sentence.
    """
    if not text or not (body := text.rstrip()):
        return None
    lines = [x for x in body.split("\n") if x.strip()]
    last = lines[-1].strip()
    if _CUT_MARK.search(last):
        return "marks"
    short = bool(_SHORT.search(last))
    if _FULL.search(last) and not short:
        return "sentence"
    before = lines[-2].strip() if len(lines) > 1 else ""
    number = bool(_PAGE.fullmatch(last))
    kind = "number" if number else "header" if is_header(last) else "sign-off" if is_sign_off(last, before) else "item" if is_item(last) else None
    if kind is None:
        return "abbreviation" if short else "open"
    return f"open, {kind}" if before and not _FULL.search(before) and not is_furniture(before) else kind


def stops_short(text: str | None, limited: bool = False) -> str | None:
    """What a text stops inside of (word or sentence), None if it is complete or blank, by its ending alone.

    Text of prose is meant. A full sentence, a sign-off, a list item, a table
    row or page furniture ends a complete text. In a text that is ``limited``,
    as it ends at a sure limit of its source, a last line after an unfinished
    one goes on with it, whatever it looks like; a page number does not.
    """
    end = ending(text)
    if end is None or end not in _SHORT_OF and not (limited and end.startswith("open, ") and end != "open, number"):
        return None
    return _inside(text, end)


def _inside(text: str, end: str) -> str:
    last = text.rstrip()[-1]
    return "word or sentence" if end == "marks" or not text[-1].isspace() and last.isalpha() else "sentence"


class EndingModel:
    """Shares of the endings among whole texts, texts cut at a limit, and texts cut elsewhere, and of the latter in each source.

    Of a text at a limit the share of texts above the expected number says how
    likely it is cut before its ending is seen; of others, the source's share.
    That a whole text hardly ever stops inside a word or sentence is given, as
    such texts are what is looked for; all else is learnt.
    """

    def __init__(self) -> None:
        self.names = list(ENDINGS)
        cut, whole = np.array([ENDINGS[k] for k in self.names]).T
        self.start = np.array([whole / whole.sum(), cut / cut.sum(), cut / cut.sum()])
        self.share = self.start
        self.given = np.isin(self.names, _SHORT_OF)
        self.prior: dict[str, float] = {}

    def fit(self, counts: dict[tuple[str, float | None, str], float]) -> EndingModel:
        """Expectation-maximization over texts by source, chance by limit (None away from limits) and ending."""
        origins = {o for o, _, _ in counts}
        self.prior = dict.fromkeys(origins, 0.1)
        for _ in range(ROUNDS):
            mass = BELIEF * self.start
            cut: dict[str, float] = defaultdict(float)
            every: dict[str, float] = defaultdict(float)
            for (o, chance, end), n in counts.items():
                p = self.posterior(o, chance, end)
                k = self.names.index(end)
                mass[0, k] += n * (1 - p)
                mass[1 if chance is not None else 2, k] += n * p
                if chance is None:
                    cut[o] += n * p
                    every[o] += n
            mass[0] *= np.where(self.given, 0, (1 - self.start[0, self.given].sum()) / mass[0, ~self.given].sum())
            self.share = mass / mass.sum(1, keepdims=True)
            self.share[0] = np.where(self.given, self.start[0], mass[0])
            self.prior = {o: (cut[o] + 1) / (every[o] + 10) for o in origins}
        return self

    def posterior(self, origin: str, chance: float | None, end: str) -> float:
        """How likely a text is cut."""
        prior = min(self.prior.get(origin, 0.1) if chance is None else chance, 1 - 1e-6)
        k = self.names.index(end)
        cut = prior * self.share[2 if chance is None else 1, k]
        return float(cut / (cut + (1 - prior) * self.share[0, k]))


def _fold(text: str) -> str:
    return _SPACE.sub("", text).casefold()


def _prefix_end(a: str, b: str) -> int:
    """The place in ``b`` up to which ``a`` reaches: of the prefixes of ``b``, the shortest with the fewest edits."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (codes != ord(x)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.argmin())


def lost_end(text: str | None, truth: str | None, slack: int = 3) -> int:
    """Characters of the true text behind the place where a recognised text stops; 0 if it is whole.

    Recognition errors are allowed for: the last characters of the text are
    looked up near their place in the truth, and what is left is counted; where
    half of them aren't there, the whole text is aligned with the truth. A last
    mark is no loss.
    """
    if not text or not truth or not (a := _fold(text)):
        return 0
    b = _fold(truth)
    if len(a) >= len(b) - slack and a[-8:] == b[-8:]:
        return 0
    tail = a[-40:]
    lo = max(0, len(a) - 60)
    window = b[lo : len(a) + 20]
    m = SequenceMatcher(None, tail, window, autojunk=False)
    blocks = [x for x in m.get_matching_blocks() if x.size >= 3]
    if 2 * sum(x.size for x in blocks) >= len(tail):
        end = lo + blocks[-1].b + blocks[-1].size + (len(tail) - blocks[-1].a - blocks[-1].size)
    else:
        end = _prefix_end(a, b)
    left = b[end:]
    if a[-1] in ".!?" and b[end - 1 : end] == a[-1]:
        return 0  # stops with a sentence, not inside one
    return len(left) if sum(c.isalnum() for c in left) > slack - 1 else 0


def _inspected(df: DataFrame, id_column: str, source_column: str, text_column: str, shapes: ShapeModel, truth_column: str | None) -> DataFrame:
    """A narrow row a text: record_id, origin, a hash of the text, ``sizes``, ``ends`` (its ending), ``inside``, ``fit`` (it counts for limits).

    Texts that are null, blank or of a failed run, and, unless they end with a
    sentence, those that are no prose have no row.
    """
    known = truth_column is not None
    text = F.col(text_column)
    truth = F.col(truth_column) if known else F.lit(None).cast("string")
    # whole texts of a fixture are all of one length, which is no limit
    short = F.coalesce(F.length(text) < F.length(truth) - 3, F.lit(True)) if known else F.lit(True)
    sized = df.where(F.regexp_like(text, F.lit(r"\S")) & ~text.startswith("ERROR")).select(
        F.col(id_column).alias("record_id"), F.coalesce(F.col(source_column), F.lit("")).alias("origin"), F.xxhash64(text).alias("hash"), short.alias("fit"), _sizes(text).alias("sizes"), text.alias("text"), truth.alias("truth")
    )

    def make() -> Callable[..., dict]:
        truths: dict[str, bool] = {}

        def end_of(t: str, truth: str | None) -> str | None:
            if not known:
                end = ending(t)
                return end if end == "sentence" or end and shape_of(t, shapes) == "prose" else None
            if truth not in truths:
                truths[truth] = shape_of(truth, shapes) == "prose"
            return None if not truths[truth] else "open" if lost_end(t, truth) else "sentence"

        def step(ids: list, origins: list, hashes: list, fit: list, sizes: list, texts: list, all_truths: list) -> dict:
            ends = [end_of(t, x) for t, x in zip(texts, all_truths)]
            inside = [_inside(t, e) if e and e != "sentence" else None for t, e in zip(texts, ends)]
            return dict(zip(("record_id", "origin", "hash", "fit", "sizes", "ends", "inside"), (ids, origins, hashes, fit, sizes, ends, inside)))

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(sized, make, f"record_id {kind}, origin string, hash bigint, fit boolean, sizes array<int>, ends string, inside string").dropDuplicates(["record_id"])


def _limits_of(seen: DataFrame) -> dict[Limit, tuple[int, float]]:
    """The limits that inspected texts show: lists, tables and junk are left out, as their make-up gives them lengths of their own."""
    return _limits(seen.where("fit and ends is not null").dropDuplicates(["origin", "hash"]).select("origin", "sizes"))


def text_limits(df: DataFrame, id_column: str, source_column: str, text_column: str, shapes: ShapeModel, truth_column: str | None = None) -> DataFrame:
    """As :func:`hidden_limits`, of the texts that :func:`truncated_texts` asks, whose limits decide there."""
    seen = materialise(_inspected(df, id_column, source_column, text_column, shapes, truth_column))
    return _as_table(df.sparkSession, _limits_of(seen))


def truncated_texts(df: DataFrame, id_column: str, source_column: str, text_column: str, shapes: ShapeModel, truth_column: str | None = None) -> DataFrame:
    """One row a truncated text: ``record_id``, ``origin``, ``stops_in``, ``at_limit``, ``chance``.

    Texts that are null, blank, of a failed run (starting ``ERROR``), lists,
    tables or junk are no cases, nor is one that ends as a complete text does
    (``COMPLETE``), as it isn't known to go on; with ``truth_column`` the text's
    own shape is not asked, and the truth tells whether the end is there.
    ``chance`` is how likely the text is cut by its length, source and ending.
    Repeated ids give one row.

    The texts are read once: lengths and endings, a narrow row a text, are kept
    in the shared folder. The driver gets lengths that stand out, and numbers of
    texts by source, limit and ending.
    """
    seen = materialise(_inspected(df, id_column, source_column, text_column, shapes, truth_column))
    found = _limits_of(seen)
    chances: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
    for (o, e, length), (n, expected) in found.items():
        chances[o].append((e, length, 1 - expected / n))
    spark = df.sparkSession
    limits = F.broadcast(spark.createDataFrame(list(chances.items()), "origin string, limits array<struct<encoding:int,length:int,chance:double>>"))
    here = F.filter(F.coalesce("limits", F.array()), lambda c: F.col("sizes")[c["encoding"]] == c["length"])
    placed = seen.where("ends is not null").join(limits, "origin", "left").select("record_id", "origin", "ends", "inside", F.array_max(F.transform(here, lambda c: c["chance"])).alias("by_limit"))
    counts = {(r["origin"], r["by_limit"], r["ends"]): r["count"] for r in placed.groupBy("origin", "by_limit", "ends").count().toLocalIterator()}
    model = EndingModel().fit(counts)
    judged = [(o, c, e, model.posterior(o, c, e)) for o, c, e in counts if e not in COMPLETE]
    chance = F.broadcast(spark.createDataFrame(judged, "o string, c double, e string, chance double"))
    decided = placed.join(chance, (F.col("origin") == F.col("o")) & (F.col("ends") == F.col("e")) & F.col("by_limit").eqNullSafe(F.col("c"))).where("chance > 0.5")
    return decided.select("record_id", "origin", F.col("inside").alias("stops_in"), F.col("by_limit").isNotNull().alias("at_limit"), "chance")


def truncation_shares(cases: DataFrame, df: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """origin, texts, truncated and share: how often each source truncates.

    Distinct ids with a text that is not blank count.
    """
    all_texts = df.where(F.length(F.trim(F.col(text_column))) > 0).groupBy(F.coalesce(F.col(source_column), F.lit("")).alias("origin")).agg(F.countDistinct(id_column).alias("texts"))
    cut = cases.groupBy("origin").agg(F.count("*").alias("truncated"))
    return all_texts.join(cut, "origin", "left").select("origin", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("texts")).alias("share"))
