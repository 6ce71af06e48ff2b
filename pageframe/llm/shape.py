"""Problem 3: text statistics of each page and whether it is prose, list, table or junk.

The thresholds on the statistics are labelling functions that each vote for one
shape or abstain. Nobody labelled the pages; the functions' accuracies come from
their agreements, by expectation-maximization over the counts of vote patterns,
and a page's shape is the one of largest posterior probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm._common import map_columns, materialise

SHAPES = ("prose", "list", "table", "junk")
#: A function's vote where it doesn't know, and where what it looks at is missing.
ABSTAIN, MISSING = -1, -2

# Function words of the six languages, for where no words are counted.
COMMON = frozenset(
    """
    the of that and to in is was be by for on which this with as at had been not it are or from no may has have an
    de la le les et des du que dans en est une un il qui ne pas sur par au aux se ce à été sont avec plus
    der die das und ist von zu den dem des nicht mit ein eine im auf für dass sei wird werden war über wurde worden
    el los las y del por con una se lo su al no ha sido para más como sobre entre queda había
    il di che è per non della dei nel sono stato alla con gli ha dal le si una anche questa era
    și în a nu care cu din este pe la au fost să de o al ale despre prin între că
    """.split()
)

MARK = re.compile(r"\s*(?:[-*+•‣◦▪·☐☑✓–—]\s|[(\[]?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)\]]\s)")
CELL = re.compile(r"\t|\||;(?=\S)|\s{2,}|\.{4,}")
CELL_HINT = re.compile(r"\t|\||;|  |\.{4}")
DIGIT = re.compile(r"\d")
VALUE = re.compile(r"[-–+]?[\d.,/:]*\d[\d.,/:]*\s?%?|[-–]|")
SENTENCE = re.compile(r"[.!?](?:(?<=[^\W\d_]{2}.)|(?<=[^\W\d_]{2}[\")»”’\]].)|(?<=\d{4}.)|(?<=,\d{3}.))(?=[\s\"»”’)]|$)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
VOWEL = re.compile(r"[aeiouyàâäáãăæèéêëìíîïòóôöõœùúûüÿ]", re.I)

STATISTICS = ("n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "end_mark_share", "mark_share", "cell_share", "common_share", "readable_share", "sentence_share", "mean_line_words")
STATISTICS_DDL = "n_words int, n_lines int, " + ", ".join(f"{k} double" for k in STATISTICS[2:])


class _Words(dict):
    """Remembers of each word whether it is common and how many readable letters it has."""

    LIMIT = 1_000_000

    def __init__(self, common: frozenset[str] = COMMON) -> None:
        super().__init__()
        self.common = common

    def __missing__(self, w: str) -> tuple[bool, int]:
        varied = len(set(w)) > len(w) // 6
        cased = w.islower() or w[1:].islower() or w[:1].isupper() or "'" in w or "’" in w or "-" in w
        out = w.lower() in self.common, len(w) if varied and cased and VOWEL.search(w) else 0
        if len(self) < self.LIMIT:
            self[w] = out
        return out


_WORDS = _Words()


def _is_row(x: str) -> bool:
    """Whether a line consists of cells or of values only."""
    if CELL_HINT.search(x):
        cells = [c for y in CELL.split(x) if (c := y.strip())]
        if len(cells) > 2 or len(cells) == 2 and VALUE.fullmatch(cells[1]):
            return True
    tokens = x.split()
    return len(tokens) > 2 and all(map(VALUE.fullmatch, tokens))


def statistics(text: str | None, seen: _Words = _WORDS) -> tuple[float, ...] | None:
    """The numbers named in ``STATISTICS``; None for a null or blank text. ``seen`` knows which words are common."""
    if not text or not (lines := [y for x in text.split("\n") if (y := x.strip())]):
        return None
    words = WORD.findall(text)
    n_words, n_lines = len(words), len(lines)
    solid = len("".join(text.split()))
    letters = sum(map(len, words))
    digits = len(DIGIT.findall(text))
    symbols = max(0, solid - letters - digits)
    ends = marked = celled = 0
    for x in lines:
        ends += x[-1] in ".!?" or x[-2:-1] in ".!?" and not x[-1].isalnum()
        if m := MARK.match(x):
            marked += 1
            x = x[m.end() :].lstrip()
        celled += _is_row(x)
    known = [seen[w] for w in words]
    common = sum([k[0] for k in known])
    readable = sum([k[1] for k in known])
    sentences = len(SENTENCE.findall(text))
    return (
        n_words, n_lines, letters / n_words if n_words else 0.0, symbols / solid, digits / solid, ends / n_lines, marked / n_lines, celled / n_lines,
        common / n_words if n_words else 0.0, readable / solid, min(1.0, sentences * 12 / max(1, n_words)), n_words / n_lines,
    )


# Labelling functions: each gives the index of a shape in SHAPES or ABSTAIN.


def _by_sentences(s: dict[str, float]) -> int:
    return 0 if s["sentence_share"] > 0.25 and s["common_share"] > 0.1 else ABSTAIN


def _by_common_words(s: dict[str, float]) -> int:
    return 0 if s["common_share"] > 0.25 and s["mean_line_words"] > 6 else 3 if s["common_share"] < 0.02 and s["readable_share"] < 0.6 and s["cell_share"] < 0.3 and s["mark_share"] < 0.5 and s["n_words"] > 3 else ABSTAIN


def _by_line_ends(s: dict[str, float]) -> int:
    return 0 if s["end_mark_share"] > 0.15 and s["mean_line_words"] > 5 else ABSTAIN


def _by_marks(s: dict[str, float]) -> int:
    return 1 if s["mark_share"] > 0.55 and s["sentence_share"] < 0.25 and s["cell_share"] < 0.5 else ABSTAIN


def _by_short_lines(s: dict[str, float]) -> int:
    return 1 if 1 <= s["mean_line_words"] < 6.5 and s["sentence_share"] < 0.25 and s["cell_share"] < 0.4 and s["readable_share"] > 0.6 and s["n_lines"] > 1 else ABSTAIN


def _by_cells(s: dict[str, float]) -> int:
    return 2 if s["cell_share"] > 0.55 and (s["mean_word_length"] > 1.6 or s["digit_ratio"] > 0.15) else ABSTAIN


def _by_digits(s: dict[str, float]) -> int:
    return 2 if 0.15 < s["digit_ratio"] and s["cell_share"] > 0.4 else 1 if s["cell_share"] < 0.2 and s["mark_share"] > 0.55 and s["sentence_share"] < 0.2 else ABSTAIN


def _by_symbols(s: dict[str, float]) -> int:
    return 3 if s["symbol_ratio"] > 0.4 and s["cell_share"] < 0.5 else ABSTAIN


def _by_readable(s: dict[str, float]) -> int:
    return 3 if s["mean_word_length"] < 1.6 and s["n_words"] > 10 and s["digit_ratio"] < 0.15 or s["readable_share"] < 0.45 and s["cell_share"] < 0.5 or s["common_share"] < 0.01 and s["readable_share"] < 0.62 and s["cell_share"] < 0.5 and s["mark_share"] < 0.5 else ABSTAIN


def _by_word_length(s: dict[str, float]) -> int:
    return 0 if 3.3 < s["mean_word_length"] < 8 and s["mean_line_words"] > 4.5 and s["readable_share"] > 0.6 and s["symbol_ratio"] < 0.15 and s["sentence_share"] > 0.15 else ABSTAIN


FUNCTIONS: tuple[Callable[[dict[str, float]], int], ...] = (_by_sentences, _by_common_words, _by_line_ends, _by_marks, _by_short_lines, _by_cells, _by_digits, _by_symbols, _by_readable, _by_word_length)


# Two more look at what is stored beside the text.


def _by_stored_score(score: float | None) -> int:
    """A score that is null, NaN or on another scale is missing."""
    return MISSING if score is None or not 0 <= score <= 1 else 3 if score < 0.5 else ABSTAIN


def _by_stored_flags(flags: list[str | None] | None) -> int:
    return MISSING if flags is None else 3 if "symbol-noise" in flags else ABSTAIN


STORED = (_by_stored_score, _by_stored_flags)
NAMES = tuple(f.__name__.removeprefix("_by_") for f in (*FUNCTIONS, *STORED))


def votes(values: tuple[float, ...], score: float | None = None, flags: list[str | None] | None = None) -> tuple[int, ...]:
    """Every labelling function's vote on one page's statistics and what is stored of it."""
    s = dict(zip(STATISTICS, values))
    return (*(f(s) for f in FUNCTIONS), _by_stored_score(score), _by_stored_flags(flags))


def _pattern(v: tuple[int, ...]) -> str:
    return ",".join(map(str, v))


class ShapeModel:
    """Labelling functions' accuracies and the shapes' shares.

    A vote of function ``j`` on a page of shape ``y`` is a draw from
    ``confusion[j, y]`` over the shapes and abstention. Without a fit, every
    function is taken to be right when it votes with ``START`` probability.
    """

    START = 0.85

    def __init__(self) -> None:
        k = len(SHAPES)
        self.prior = np.full(k, 1 / k)
        self.confusion = np.empty((len(NAMES), k, k + 1))
        own = {"sentences": (0,), "common_words": (0, 3), "line_ends": (0,), "marks": (1,), "short_lines": (1,), "cells": (2,), "digits": (1, 2), "symbols": (3,), "readable": (3,), "word_length": (0,), "stored_score": (3,), "stored_flags": (3,)}
        for j, name in enumerate(NAMES):
            for y in range(k):
                row = np.full(k + 1, 0.01)
                row[y if y in own[name] else k] = self.START
                row[k] += 0.1
                self.confusion[j, y] = row / row.sum()

    def fit(self, patterns: dict[tuple[int, ...], int], rounds: int = 50) -> ShapeModel:
        """Expectation-maximization over distinct vote patterns and their counts."""
        if not patterns:
            return self
        v = np.array(list(patterns))
        n = np.array(list(patterns.values()), float)
        start = self.confusion.copy()
        for _ in range(rounds):
            p = self.posterior_of(v)
            mass = p * n[:, None]
            self.prior = (mass.sum(0) + 1) / (mass.sum() + len(SHAPES))
            for j in range(len(NAMES)):
                for a in (*range(len(SHAPES)), ABSTAIN):
                    self.confusion[j, :, a] = mass[v[:, j] == a].sum(0)
            # a few pages' worth of the starting belief keeps a shape that no page has
            self.confusion += 5 * start
            self.confusion /= self.confusion.sum(2, keepdims=True)
        return self

    def posterior_of(self, v: np.ndarray) -> np.ndarray:
        """The shapes' probabilities of each vote pattern; what is missing tells nothing."""
        logs = np.log(self.prior)[None, :] + sum(np.where(v[:, j, None] == MISSING, 0.0, np.log(self.confusion[j][:, v[:, j] % (len(SHAPES) + 1)]).T) for j in range(v.shape[1]))
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, v: tuple[int, ...]) -> np.ndarray:
        return self.posterior_of(np.array([v]))[0]

    def accuracies(self) -> dict[str, float]:
        """Share of a function's votes that fall on the page's shape."""
        out = {}
        for j, name in enumerate(NAMES):
            cast = (self.confusion[j, :, :-1] * self.prior[:, None]).sum()
            right = sum(self.confusion[j, y, y] * self.prior[y] for y in range(len(SHAPES)))
            out[name] = float(right / cast) if cast else math.nan
        return out


def page_statistics(df: DataFrame, id_column: str, text_column: str, score_column: str | None = None, flags_column: str | None = None, common: frozenset[str] = COMMON) -> DataFrame:
    """One row a non-blank text: ``record_id``, the statistics, the vote pattern ``votes``, and ``quality_score`` and ``quality_flags`` as stored.

    Null, empty and white-space texts give no row. Very long texts are read
    whole. Without columns for what is stored that is null, and its functions'
    votes are missing.
    """
    stored = F.col(score_column) if score_column else F.lit(None).cast("double"), F.col(flags_column) if flags_column else F.lit(None).cast("array<string>")

    def make() -> Callable[..., dict]:
        seen = _Words(common)

        def step(ids: list, texts: list, scores: list, flags: list) -> dict:
            rows = [(i, *s, _pattern(votes(s, q, f)), q, f) for i, t, q, f in zip(ids, texts, scores, flags) if (s := statistics(t, seen))]
            columns = list(zip(*rows)) if rows else [()] * (len(STATISTICS) + 4)
            return dict(zip(("record_id", *STATISTICS, "votes", "quality_score", "quality_flags"), map(list, columns)))

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(df.select(id_column, text_column, *stored), make, f"record_id {kind}, {STATISTICS_DDL}, votes string, quality_score double, quality_flags array<string>")


def _patterns(stats: DataFrame) -> dict[tuple[int, ...], int]:
    """How many pages have each vote pattern: at most as many as the product of the functions' possible votes (20,736), whatever the number of pages."""
    return {tuple(map(int, r["votes"].split(","))): r["n"] for r in stats.groupBy("votes").agg(F.count("*").alias("n")).collect()}


def fit_shapes(stats: DataFrame) -> ShapeModel:
    """Learn the functions' accuracies from all pages."""
    return ShapeModel().fit(_patterns(stats))


def with_shapes(stats: DataFrame) -> DataFrame:
    """Add ``shape`` and ``posterior``, by accuracies learnt from all rows, to rows of :func:`page_statistics`; ``stats`` is read twice."""
    patterns = _patterns(stats)
    model = ShapeModel().fit(patterns)
    rows = [(_pattern(v), SHAPES[int(p.argmax())], float(p.max())) for v in patterns for p in [model.posterior(v)]]
    # one row a vote pattern, which are bounded as above
    shapes = stats.sparkSession.createDataFrame(rows, "votes string, shape string, posterior double")
    return stats.join(F.broadcast(shapes), "votes").drop("votes")


def shape_of(text: str | None, model: ShapeModel) -> str | None:
    """The shape of one text, None if it is blank; for operators that need it on the way."""
    s = statistics(text)
    return None if s is None else SHAPES[int(model.posterior(votes(s)).argmax())]


def classify_shapes(df: DataFrame, id_column: str, text_column: str, score_column: str | None = None, flags_column: str | None = None, common: frozenset[str] = COMMON) -> DataFrame:
    """One row a distinct id with a non-blank text: ``record_id``, ``shape``, ``posterior``.

    Rows that are delivered twice give one row. Ties between shapes go to the
    first of ``SHAPES``. An empty table gives no rows. The texts are read once:
    the vote patterns are kept in the shared folder.
    """
    stats = materialise(page_statistics(df, id_column, text_column, score_column, flags_column, common).select("record_id", "votes"))
    return with_shapes(stats).dropDuplicates(["record_id"])
