"""Problem 5: the language of each page and of its passages.

Words first: a word that the corpus knows is scored by its log frequency in
each language; an unseen one backs off to character n-grams, from the longest
down to the first that is known. The frequencies come from the pages' own
labels, over all pages; wrong labels are outweighed by right ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm._common import count_keys, map_columns
from pageframe.llm.shape import ShapeModel, shape_of

LANGUAGES = ("en", "ro", "de", "fr", "es", "it")

# Usual spellings of a language's name, by code.
LABELS = {
    "en": "en eng english anglais englisch engleza inglese ingles",
    "ro": "ro ron rum romanian română romana roumain rumänisch rumano rumeno",
    "de": "de deu ger german deutsch allemand aleman alemán tedesco germana germană",
    "fr": "fr fra fre french français francais französisch francés frances francese franceza franceză",
    "es": "es spa esl spanish español espanol castellano espagnol spanisch spagnolo spaniola spaniolă",
    "it": "it ita italian italiano italien italienisch italiana italiană",
}
_CODES = {name: code for code, names in LABELS.items() for name in names.split()}

#: Words kept of the counts: those of at least this share of a language's words,
#: so at most its inverse in number, whatever the corpus' size.
SHARE = 5e-6
#: Share of a language's words from which a word is a common one, as function words are.
COMMON_SHARE = 5e-3
#: Longest and shortest character n-gram of the backoff.
LONG, SHORT = 4, 1
#: A sentence decides with this many scored words and this margin in log odds.
MIN_WORDS, MARGIN = 2, 4.0

_WORD = re.compile(r"[^\W\d_]{2,}|[àèéaeiouyșî](?=\s)")
_END = re.compile(r"(?<=[^\W\d_]{2}[.!?;:])[\"»”’)]*\s+|(?<=\d{3}[.!?;:])[\"»”’)]*\s+|(?<=[^\W\d_]{2}[.!?][\"»”])\s+|\n\s*\n")


def label_code(label: str | None) -> str | None:
    """The code of a label in any usual spelling; None if it names no language."""
    if not label or not (name := re.split(r"[-_@. (]", label.strip().lower(), maxsplit=1)[0]):
        return None
    return _CODES.get(name)


class Rows:
    """A table of numbers by key, one matrix: it is sent to the workers as the keys' text and the matrix' bytes."""

    def __init__(self, rows: dict[str, np.ndarray]) -> None:
        self._at = {k: i for i, k in enumerate(rows)}
        self._rows = np.array(list(rows.values()), np.float32).reshape(-1, len(LANGUAGES))

    def get(self, key: str) -> np.ndarray | None:
        i = self._at.get(key)
        return None if i is None else self._rows[i]

    def __getstate__(self) -> tuple[str, np.ndarray]:
        return "\n".join(self._at), self._rows

    def __setstate__(self, state: tuple[str, np.ndarray]) -> None:
        self._at = {k: i for i, k in enumerate(state[0].split("\n"))} if len(state[1]) else {}
        self._rows = state[1]


class LanguageModel:
    """Log frequencies of words and character n-grams in each language."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        size = len(LANGUAGES)
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        for (lang, word), n in counts.items():
            words[word][LANGUAGES.index(lang)] += n
        totals = sum(words.values(), np.zeros(size)) + 1
        logs: dict[str, np.ndarray] = {}
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        for word, n in words.items():
            logs[word] = self._logs(n / totals, 1 / totals.sum())
            for g in self._grams(word):
                # by words, not by their uses: an unseen word is a rare one
                grams[g] += (n > 0.2 * n.max()) * 1.0
        kinds = {k: sum((n for g, n in grams.items() if len(g) == k), np.zeros(size)) + 1 for k in range(SHORT, LONG + 1)}
        self.words = Rows(logs)
        self.grams = Rows({g: self._logs(n / kinds[len(g)], 1 / kinds[len(g)].sum()) for g, n in grams.items() if n.sum() > 1})
        self._seen: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def _logs(share: np.ndarray, least: float) -> np.ndarray:
        logs = np.log(share + least)
        return logs - logs.mean()

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + k] for k in range(SHORT, LONG + 1) for i in range(len(w) - k + 1)]

    def score(self, word: str) -> tuple[float, ...]:
        """Log score by language, centred, so that a word that tells nothing adds nothing."""
        word = word.lower()
        found = self._seen.get(word)
        if found is None:
            logs = self.words.get(word)
            if logs is None:
                logs = self._back_off(word)
            # one word must not decide alone
            found = tuple(np.clip(logs, -4, 4).tolist())
            if len(self._seen) < 1_000_000:
                self._seen[word] = found
        return found

    def _back_off(self, word: str) -> np.ndarray:
        """Mean of the longest known n-grams of an unseen word, at half the weight of a word."""
        w = f" {word} "
        for k in range(LONG, SHORT - 1, -1):
            known = [g for i in range(len(w) - k + 1) if (g := self.grams.get(w[i : i + k])) is not None]
            if len(known) * 2 >= max(1, len(w) - k + 1):
                return np.mean(known, axis=0) / 2
        return np.zeros(len(LANGUAGES))

    def total(self, words: list[str]) -> list[float]:
        return [sum(c) for c in zip(*map(self.score, words))] if words else [0.0] * len(LANGUAGES)

    @staticmethod
    def best(scores: list[float]) -> tuple[int, float, float]:
        """Index of the language, its margin over the next, and its posterior."""
        k = max(range(len(scores)), key=scores.__getitem__)
        top = scores[k]
        margin = top - max(s for j, s in enumerate(scores) if j != k)
        return k, margin, 1 / sum(math.exp(max(s - top, -700)) for s in scores)

    def passages(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Start, end, language and confidence of each run of sentences in one language.

        Sentences that tell nothing go with the sentence before them.
        """
        if not text or not text.strip():
            return []
        spans, at = [], 0
        for m in _END.finditer(text):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, len(text)))
        whole = self.total(_words(text))
        page, margin, p = self.best(whole)
        runs: list[list] = []
        for a, b in spans:
            words = _words(text[a:b])
            scores = self.total(words)
            k, m, _ = self.best(scores)
            if len(words) < MIN_WORDS or m < MARGIN:
                k = runs[-1][2] if runs else page
            if runs and runs[-1][2] == k:
                runs[-1][1] = b
                runs[-1][3] = [x + y for x, y in zip(runs[-1][3], scores)]
            else:
                runs.append([a, b, k, scores])
        return [(a, b, LANGUAGES[k], self.best([*s])[2] if any(s) else 0.0) for a, b, k, s in runs]

    def languages(self, text: str | None) -> dict[str, float]:
        """The languages that the text is written in, with their confidence."""
        out: dict[str, float] = {}
        for _, _, lang, p in self.passages(text):
            out[lang] = max(p, out.get(lang, 0.0))
        return out




def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def word_counts(df: DataFrame, label_column: str, text_column: str) -> DataFrame:
    """How often each word stands in pages of each labelled language: ``lang``, ``word``, ``n``."""

    def make() -> Callable[..., dict]:
        def step(labels: list, texts: list) -> dict:
            by: dict[str, list[str]] = defaultdict(list)
            codes = {x: label_code(x) for x in set(labels)}
            for label, t in zip(labels, texts):
                if t and codes[label]:
                    by[codes[label]].append(t)
            return {(lang, w): n for lang, ts in by.items() for w, n in Counter(_WORD.findall(" \n".join(ts).lower())).items()}

        return step

    return count_keys(df.select(label_column, text_column), make, "lang string, word string, n bigint", lambda k: k)


def fit_languages(df: DataFrame, label_column: str, text_column: str) -> LanguageModel:
    """Learn the model from all labelled pages.

    The driver gets the words that make up at least ``SHARE`` of a language's
    words: at most 1 / ``SHARE`` for each language.
    """
    counts = word_counts(df, label_column, text_column)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * SHARE))
    return LanguageModel({(r["lang"], r["word"]): r["n"] for r in kept.collect()})


def common_words(df: DataFrame, label_column: str, text_column: str) -> frozenset[str]:
    """The words that make up ``COMMON_SHARE`` of a labelled language's words, so its inverse for each language at most, by all pages."""
    counts = word_counts(df, label_column, text_column)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return frozenset(r["word"] for r in counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * COMMON_SHARE).select("word").collect())


def label_problems(df: DataFrame, id_column: str, label_column: str, text_column: str, model: LanguageModel, shapes: ShapeModel) -> DataFrame:
    """One row for each page of prose and language, where its label is missing or wrong or it has several.

    Gives the id as ``record_id``, ``lang``, ``confidence`` and ``problem``
    (missing, wrong, mixed). Blank texts, lists, tables and junk give no rows;
    repeated ids give one row a language.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, shapes))

    def make() -> Callable[..., dict]:
        local, local_shapes = shared.value

        def step(ids: list, labels: list, texts: list) -> dict:
            out: list[tuple] = []
            for i, label, t in zip(ids, labels, texts):
                if not t or not (found := local.languages(t)):
                    continue
                code = label_code(label)
                problem = "mixed" if len(found) > 1 else "missing" if code is None else "wrong" if code not in found else None
                if problem and shape_of(t, local_shapes) == "prose":
                    out += [(i, lang, p, problem) for lang, p in found.items()]
            columns = zip(*out) if out else ([], [], [], [])
            return dict(zip(("record_id", "lang", "confidence", "problem"), map(list, columns)))

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(df.select(id_column, label_column, text_column), make, f"record_id {kind}, lang string, confidence double, problem string").dropDuplicates(["record_id", "lang"])


def page_passages(df: DataFrame, id_column: str, text_column: str, model: LanguageModel) -> DataFrame:
    """``record_id``, ``passage_no``, ``start``, ``end`` (characters), ``lang``, ``confidence`` of every passage."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[..., dict]:
        local = shared.value

        def step(ids: list, texts: list) -> dict:
            out = [(i, k, *p) for i, t in zip(ids, texts) for k, p in enumerate(local.passages(t))]
            columns = zip(*out) if out else ([],) * 6
            return dict(zip(("record_id", "passage_no", "start", "end", "lang", "confidence"), map(list, columns)))

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(df.select(id_column, text_column), make, f"record_id {kind}, passage_no int, start int, end int, lang string, confidence double")
