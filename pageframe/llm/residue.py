"""Problem 8: template residue, filler text and error pages.

Labelled exemplars of residue (``exemplars``) are kept under an inverted index
from their terms. A text's passages retrieve the exemplars that share a rare term
with them, and TF-IDF containment says how much of the exemplar, and of the
passage, the match covers. Marks of template languages are terms like others, so
fields are retrieved the same way; patterns only propose where a field may stand.
Term frequencies come from the whole corpus, and so do the words of pseudo-Latin.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import groupby
from typing import Any

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm import exemplars
from pageframe.llm._common import count_keys, map_columns

TERM = re.compile(r"[^\W\d_]+|\d+|[|©]")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_VALUE = re.compile(r':\s*"([^"\n]*)"')
_PASSAGE = re.compile(r"\n|</?\w+>|(?<=[.!?;])\s+")
# where a field may begin: a mark, a word that programs write, or the middle of a date without figures
_MARK_HINT = re.compile(r"[{<$«@%#\[][^\s]")
_WORD_HINTS = ("undefined", "NaN", "(null)", "__")
_DATE_HINT = re.compile(r"[./-](?:XX|xx|MM|mm|DD|dd|LL|ll|00)[./-]")
_DATE_START = re.compile(r"[A-Za-z0]{2,4}$")
# what may be a field, by the kind of its marks; what stands between is the last group that is there
_FIELD = re.compile(
    r"(?P<braces>\{\{([^{}]*)\}\})|(?P<block>\{%([^{}%]*)%\})|(?P<code><%=?([^<>%]*)%>)|(?P<dollar>\$\{([^{}\n]*)\})|(?P<number>\{(\d{1,3})\})|(?P<upper>\{([A-Z][A-Z_]+)\})|(?P<path>\{([a-z][a-z\d]*(?:[_.][a-z\d]+)+)\})"
    r"|(?P<squares>\[\[([^\W\d_][^\[\]\n]+)\]\])|(?P<angles>«(\w+_\w+)»)|(?P<twice><<([A-Z_]{2,})>>)|(?P<at>@@(\w+)@@)|(?P<percent>%([A-Z][A-Z_]+)%)|(?P<hash>\#([A-Z][A-Z_]+)\#)|(?P<price>\$([A-Z][A-Z_]+)\$)|(?P<under>__([A-Z][A-Z_]+?)__(?!\w))"
    r"|(?P<value>undefined(?![\w'\"-])|\[object Object\]|NaN(?!\w)|\(null\)|%[sd](?!\w)|(?:[A-Za-z]{2,4}|0{2,4})(?P<sep>[./-])(?:[A-Za-z]{2}|00)(?P=sep)(?:[A-Za-z]{2,4}|\d\d[A-Za-z]{2}|0{2,4})(?!\w))"
    r"|(?P<plain>\[([^\[\]\n]+)\]|\{([a-z]+)\}|<([A-Z][A-Z_]+)>)"
)

#: Share of an exemplar's weight that a passage must hold, and that it must hold for
#: its words to count as covered; share of a passage's weight that exemplars must
#: cover, or ALL where none is held but HALF of one; share of a text's for an error page.
HELD, HALF, PART, COVERED, ALL, PAGE = 0.65, 0.5, 0.4, 0.7, 0.8, 0.5
#: Different terms that a passage may have beside what exemplars cover, where they cover HALF.
BESIDE = 3
#: Lines that a window joins at most.
LINES = 3
#: A term is one of pseudo-Latin if this share of its occurrences in the corpus, and so
#: many, stand in passages of it, and if it is this share of all their terms, so that
#: at most the inverse are; a passage of it has so many different ones.
INSIDE, TIMES, SHARE, VARIED = 0.5, 2, 1e-3, 3
#: Terms that a bracketed field has at most, and share of its weight that marks of a
#: template language, or words that ask for it to be filled, must cover.
FIELD_TERMS, FIELD_SHARE = 10, 0.25

PAGES = ("error", "notice", "furniture")


def terms(text: str) -> list[str]:
    return ["0" if t[0].isdigit() else t for t in TERM.findall(text.casefold())]


def _mark(kind: str) -> str:
    """The term that stands for a template language's marks; no word of a text is written so."""
    return f"<{kind}>"


def field_at(text: str, at: int) -> tuple[str, str, str] | None:
    """Kind, whole and inside of what may be a field at a place of a text."""
    m = _FIELD.match(text, at)
    if not m:
        return None
    if m.lastgroup == "value":
        return "value", m.group(), re.sub(r"[.-]", "/", m.group()).lower() if m.group()[:1] not in "[(%uN" else m.group()
    return m.lastgroup, m.group(), next(g for g in reversed(m.groups()) if g is not None)


def _hints(text: str) -> list[int]:
    """Places of a text where a field may begin, in their order."""
    out = [m.start() for m in _MARK_HINT.finditer(text)]
    for word in _WORD_HINTS:
        at = text.find(word)
        while at >= 0:
            if not text[at - 1 : at].isalnum() and text[at - 1 : at] not in "_'\"-" or not at:
                out.append(at)
            at = text.find(word, at + len(word))
    for m in _DATE_HINT.finditer(text):
        if first := _DATE_START.search(text, max(0, m.start() - 4), m.start()):
            if not text[first.start() - 1 : first.start()].isalnum() or not first.start():
                out.append(first.start())
    return sorted(out)


def fields_of(text: str) -> list[tuple[str, str, str]]:
    """All places of a text that may be a field."""
    out, end = [], 0
    for at in _hints(text):
        if at >= end and (f := field_at(text, at)):
            out.append(f)
            end = at + len(f[1])
    return out


def _strings(value: Any) -> list[str]:
    """The strings of a parsed object, in their order."""
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in inner for s in _strings(v)]


def _passages(text: str) -> tuple[list[int], list[str], list[bool]]:
    """Starts and texts of the lines and sentences, without tags, and whether each goes on in the next, over a line feed; of an object's text, its values."""
    if text.lstrip()[:1] == "{":
        try:
            values = _strings(json.loads(text))
        except (ValueError, RecursionError):
            values = _VALUE.findall(text)
        if values:
            return [0], [" ".join(v for v in values if " " in v or not re.search(r"\d", v))], [False]
    starts, out, on, at = [], [], [], 0
    for m in _PASSAGE.finditer(text):
        starts.append(at)
        out.append(_TAG.sub(" ", text[at : m.start()]))
        on.append(m.group() == "\n" and bool(out[-1].strip()) and out[-1].rstrip()[-1] not in ".!?;")
        at = m.end()
    last = _TAG.sub(" ", text[at:])
    if on and not last.strip():
        on[-1] = False
    on = [a and bool(b.strip()) for a, b in zip(on, [*out[1:], last])]
    return [*starts, at], [*out, last], [*on, False]


def _windows(on: list[bool], k: int) -> list[tuple[int, int]]:
    """First and last passage of the windows of up to ``LINES`` joined lines that hold a passage, the shortest first."""
    return [(lo, lo + n) for n in range(LINES) for lo in range(max(0, k - n), k + 1) if lo + n < len(on) and all(on[lo : lo + n])]


class ResidueIndex:
    """Exemplars by term, with the terms' inverse frequencies in the corpus.

    ``counts`` has the exemplar terms' frequencies, marks among them, ``total``
    the number of terms in the corpus, and ``latin`` the terms of pseudo-Latin.
    """

    def __init__(self, counts: dict[str, int], total: int, latin: frozenset[str] = frozenset()) -> None:
        self.total = max(total, 1)
        self.counts = {t: counts.get(t, 0) for t in self.vocabulary()} | {t: counts.get(t, 0) for t in latin}
        self.latin = latin
        self._idf = {t: math.log(1 + self.total / (1 + n)) for t, n in self.counts.items()} | {"0": math.log(21)}
        self._unseen = math.log(1 + self.total / (1 + self.total / 1000))
        self.exemplars: list[tuple[str, Counter, float]] = []
        self.postings: dict[str, list[int]] = defaultdict(list)
        self.anchors = ahocorasick.Automaton()
        for kind, bag in self.bags():
            k = len(self.exemplars)
            full = sum(self.idf(t) * n for t, n in bag.items())
            self.exemplars.append((kind, bag, full))
            for t in bag:
                self.postings[t].append(k)
            if kind in ("error", "notice", "filler"):
                for a in self._anchors_of(bag, full):
                    self.anchors.add_word(a, a)
        for a in latin:
            self.anchors.add_word(a, a)
        self.anchors.make_automaton()
        self._unfilled: dict[tuple[str, str], bool] = {}

    @staticmethod
    def bags() -> list[tuple[str, Counter]]:
        """The exemplars' kinds and terms."""
        out = [(kind, Counter(terms(x))) for kind, texts in exemplars.by_kind().items() for text in texts for x in _PASSAGE.split(text) if x.strip()]
        out += [("ask", Counter(terms(x))) for x in exemplars.ASKS] + [("name", Counter(terms(x))) for x in exemplars.NAMES]
        out += [("mark", Counter([_mark(field_at(x, 0)[0])])) for x in exemplars.TEMPLATES]
        return out + [("value", Counter([x])) for x in exemplars.VALUES]

    @classmethod
    def vocabulary(cls) -> set[str]:
        """The terms whose corpus frequency is needed."""
        return {t for _, bag in cls.bags() for t in bag}

    def _anchors_of(self, bag: Counter, full: float) -> list[str]:
        """Terms of an exemplar, rare ones first and the shortest last, such that a passage without any of them can't hold ``HALF`` of it."""
        out, left = [], full
        for t in sorted(bag, key=lambda t: (len(t) > 2, self.idf(t)), reverse=True):
            if left < HALF * full:
                break
            if t != "0":
                out.append(t)
            left -= self.idf(t) * bag[t]
        return out

    def idf(self, term: str) -> float:
        """Terms outside every exemplar count as much as a term of one in a thousand, numbers as one in twenty."""
        return self._idf.get(term, self._unseen)

    def _retrieve(self, bag: Counter) -> dict[int, float]:
        """Containment of every exemplar that shares a term."""
        shared: dict[int, float] = defaultdict(float)
        for t, n in bag.items():
            if t in self.postings:
                idf = self._idf[t]
                for k in self.postings[t]:
                    shared[k] += idf * min(n, self.exemplars[k][1][t])
        return {k: s / self.exemplars[k][2] for k, s in shared.items()}

    def _share(self, bag: Counter, inside: set[str]) -> float:
        weight = sum(self.idf(t) * n for t, n in bag.items())
        return sum(self.idf(t) * n for t, n in bag.items() if t in inside) / weight if weight else 0.0

    def match(self, passage: str) -> tuple[str | None, set[str]]:
        """Kind of residue that a passage is, and the terms that exemplars of pages explain."""
        bag = Counter(terms(passage))
        held = self._retrieve(bag)
        best = {}
        explained: dict[bool, set[str]] = {True: set(), False: set()}
        for k, share in held.items():
            kind, e, _ = self.exemplars[k]
            if kind == "filler" or kind in PAGES:
                if share >= PART:
                    explained[kind in PAGES] |= e.keys()
                if share >= HALF and share > best.get(kind, 0.0):
                    best[kind] = share
        if len(bag.keys() & self.latin) >= VARIED and self._share(bag, self.latin) >= COVERED:
            return "filler", explained[True]
        if self._is_held(best.pop("filler", 0.0), bag, explained[False]):
            return "filler", explained[True]
        if best and self._is_held(max(best.values()), bag, explained[True]):
            return max(best, key=lambda k: (k != "furniture", best[k])), explained[True]
        return None, explained[True]

    def _is_held(self, held: float, bag: Counter, explained: set[str]) -> bool:
        """Whether an exemplar of this containment, and the terms that it and others explain, make up a passage."""
        covered = self._share(bag, explained) if held >= HALF else 0.0
        return held >= HELD and (covered >= COVERED or covered >= HALF and len(bag.keys() - explained) <= BESIDE) or covered >= ALL

    def unfilled(self, kind: str, inside: str) -> bool:
        """Whether a marked span is an unfilled field or an empty value: by TF-IDF containment of the exemplars that share a term with it.

        Marks of a template language, or an exemplar that asks for the field to
        be filled, must be held, and cover ``FIELD_SHARE`` of the span; in plain
        brackets the names of fields must cover ``HELD`` of it, so that a
        redaction such as 'name withheld' is none.
        """
        if (kind, inside) not in self._unfilled:
            if len(self._unfilled) > 100_000:
                self._unfilled.clear()
            self._unfilled[kind, inside] = self._is_field(kind, inside)
        return self._unfilled[kind, inside]

    def _is_field(self, kind: str, inside: str) -> bool:
        if kind == "value":
            return any(self.exemplars[k][0] == "value" for k in self._retrieve(Counter([re.sub(r"/(?:\d\d|xx)xx$", "/xxxx", inside)])))
        words = Counter(terms(inside.replace("_", " ")))
        if words.total() > FIELD_TERMS:
            return False
        bag = words + Counter([_mark(kind)] if kind != "plain" else [])
        named: set[str] = set()
        for k, share in self._retrieve(bag).items():
            own, e, _ = self.exemplars[k]
            if share >= HELD and (own == "mark" or own == "ask") and self._share(bag, set(e)) >= FIELD_SHARE:
                return True
            if share >= HELD and own == "name":
                named |= e.keys()
        return bool(bag) and self._share(bag, named) >= HELD

    def judge(self, text: str | None) -> tuple[str, str] | None:
        """Kind of residue and evidence, or None for a text without any."""
        if not text or not text.strip():
            return None
        for kind, whole, inside in fields_of(text):
            if self.unfilled(kind, inside):
                return "field", whole
        low = text.lower()
        hits = [end for end, a in self.anchors.iter(low) if not low[end + 1 : end + 2].isalpha() and not low[end - len(a) : end - len(a) + 1].isalpha()]
        if not hits:
            return None
        starts, passages, on = _passages(text)
        error = evidence = None
        matches: dict[tuple[int, int], tuple[str | None, set[str]]] = {}

        def match(lo: int, hi: int) -> tuple[str | None, set[str]]:
            if (lo, hi) not in matches:
                matches[lo, hi] = self.match(" ".join(passages[lo : hi + 1]))
            return matches[lo, hi]

        for k, _ in groupby(hits, lambda at: bisect_right(starts, at) - 1):
            for lo, hi in _windows(on, k):
                kind = match(lo, hi)[0]
                if kind == "filler":
                    return "filler", " ".join(passages[lo : hi + 1]).strip()
                if kind in ("error", "notice"):
                    error, evidence = kind, evidence or " ".join(passages[lo : hi + 1]).strip()
                    break
        if not error:
            return None
        covered = weight = 0.0
        for k, passage in enumerate(passages):
            bag = Counter(terms(passage))
            inside = set().union(*(match(lo, hi)[1] for lo, hi in _windows(on, k)))
            weight += sum(self.idf(t) * n for t, n in bag.items())
            covered += sum(self.idf(t) * n for t, n in bag.items() if t in inside)
        return (error, evidence) if covered >= PAGE * weight else None


def _term_counts(docs: DataFrame) -> DataFrame:
    """How often each term, and each mark, stands in all texts, and (``inside``) in passages that hold the first words of pseudo-Latin."""
    first = set(terms(exemplars.PSEUDO_LATIN[0])[:2])

    def make() -> Callable[..., dict]:
        def step(texts: list) -> dict:
            kept = [t for t in texts if t]
            out: Counter = Counter()
            for t, n in Counter(TERM.findall("\n".join(kept).casefold())).items():
                out["0" if t[0].isdigit() else t, False] += n
            for (kind, _, inside), n in Counter(f for t in kept for f in fields_of(t)).items():
                out[inside if kind == "value" else _mark(kind), False] += n
            for t in kept:
                if all(w in (low := t.casefold()) for w in first):
                    for passage in _PASSAGE.split(low):
                        bag = Counter(terms(passage))
                        if first <= bag.keys():
                            for w, n in bag.items():
                                out[w, True] += n
            return out

        return step

    return count_keys(docs, make, "term string, inside boolean, n bigint", lambda k: k)


def fit_residue(df: DataFrame, text_column: str) -> tuple[dict[str, int], int, frozenset[str]]:
    """The frequencies of the exemplars' terms, of all terms, and the terms of pseudo-Latin, from all texts.

    The driver gets the exemplars' terms and, of pseudo-Latin, at most the
    inverse of ``SHARE``.
    """
    counts = _term_counts(df.select(text_column)).groupBy("term").agg(F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"))
    # the totals are one row of the same counts, so that the plan reads the texts once
    totals = counts.agg(F.sum("n").alias("total"), F.sum("inside").alias("all_inside")).hint("broadcast")
    latin = (F.col("inside") >= TIMES) & (F.col("inside") >= INSIDE * F.col("n")) & (F.col("inside") >= SHARE * F.col("all_inside"))
    wanted = F.col("term").isin(sorted(ResidueIndex.vocabulary()))
    rows = counts.join(totals, latin | wanted | (F.col("term") == "0")).select("term", "n", latin.alias("latin"), "total").collect()
    return {r["term"]: r["n"] for r in rows}, max((r["total"] for r in rows), default=0), frozenset(r["term"] for r in rows if r["latin"])


def find_residue(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row a text with residue: the id, ``kind`` (field, filler, error, notice) and ``evidence``.

    Null and blank texts have none. Texts are read whole; repeated ids give one
    row. The driver gets the corpus frequencies of the exemplars' terms and the
    terms of pseudo-Latin, and nothing but term counts and the result's ids is
    shuffled. A passage of which the exemplars cover less than ``COVERED``, such
    as a sentence that quotes an error message, is no residue.
    """
    counts, total, latin = fit_residue(df, text_column)

    def make() -> Callable[..., dict]:
        index = ResidueIndex(counts, total, latin)

        def step(ids: list, texts: list) -> dict:
            out = [(i, *found) for i, t in zip(ids, texts) if (found := index.judge(t))]
            columns = zip(*out) if out else ([], [], [])
            return dict(zip((id_column, "kind", "evidence"), map(list, columns)))

        return step

    kind = df.schema[id_column].dataType.simpleString()
    found = map_columns(df.select(id_column, text_column), make, f"{id_column} {kind}, kind string, evidence string")
    return found.groupBy(id_column).agg(F.min(F.struct("kind", "evidence")).alias("first")).select(id_column, "first.kind", "first.evidence")
