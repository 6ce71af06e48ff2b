"""Problem 7: evaluation passages inside a training corpus.

Word n-grams of the test items are the seeds: where one stands in a document,
that place is joined to the item. Seeds that follow each other give the longest
exact run of words, and a Smith-Waterman alignment of the words around every such
place a score for edited copies. How rare a pair's rarest seed is in the corpus
tells passages of the item from turns of phrase; seeds that are not rare join
too, as edited copies were lost without them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageframe.llm._common import map_columns, materialise

#: Words of a seed and of a leak.
SEED, RUN = 8, 13
#: Test items that every task may hold; more are handled in blocks of this size.
BLOCK = 20_000
#: What a pair of equal words, one of other words, and a word in one text only add to an alignment's score.
MATCH, MISS, GAP = 2, -1, -1
#: Cells of the alignments' tables that are filled at once.
CELLS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_JOIN = re.compile(r"[-‐­¬][ \t ]*\r?\n\s*")
_ODD = re.compile(r"[^\x00-\x7fÀ-ſȘ-ț‐-…€]")


def leak_words(text: str, join: bool = True) -> list[str]:
    """Runs of letters and digits, without regard to case, width or invisible characters.

    ``join`` removes a hyphen at a line end with the line break; else it parts
    the words, as a compound's own hyphen does.
    """
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf" or c == "­")
    if join:
        text = _JOIN.sub("", text)
    return _WORD.findall(text.replace("­", "").casefold())


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman over word ids: the best local score of each pair of a passage and an item.

    Words of id -1 match nothing. A row of every pair's table is filled at a
    time; the gaps along a row are a running maximum. The pairs with the longest
    passages come first, so that those that are done fall off the end.
    """
    out = np.zeros(len(pairs), np.int64)
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: -len(pairs[k][0]))
    at = 0
    while at < len(order):
        wide = len(pairs[order[at]][1])
        end = at
        while end < len(order) and max(wide, len(pairs[order[end]][1])) * (end - at + 1) <= max(CELLS, wide):
            wide = max(wide, len(pairs[order[end]][1]))
            end += 1
        some = order[at : max(end, at + 1)]
        at += len(some)
        size = np.array([len(pairs[k][0]) for k in some])
        passages = np.full((len(some), size[0]), -1, np.int32)
        items = np.full((len(some), wide), -2, np.int32)
        for n, k in enumerate(some):
            passages[n, : size[n]], items[n, : len(pairs[k][1])] = pairs[k]
        kind = np.int16 if MATCH * wide < 30_000 else np.int32
        steps = (np.arange(wide + 1) * -GAP).astype(kind)
        row = np.zeros((len(some), wide + 1), kind)
        best = np.zeros(len(some), kind)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        for j in range(size[0]):
            n = alive[j]
            old, new = row[:n], np.zeros((n, wide + 1), kind)
            np.maximum(old[:, :-1] + np.where(items[:n] == passages[:n, j, None], kind(MATCH), kind(MISS)), old[:, 1:] + kind(GAP), out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new += steps
            np.maximum.accumulate(new, axis=1, out=new)
            new -= steps
            row[:n] = new
            np.maximum(best[:n], new.max(1), out=best[:n])
        out[some] = best
    return out


class ItemIndex:
    """Word ids and seeds of one block of test items."""

    MOD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.words: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.texts: list[np.ndarray] = []
        hashes, owners, places = [], [], []
        for k, (_, text) in enumerate(items):
            w = np.array([self.words.setdefault(x, len(self.words)) for x in leak_words(text or "")], np.int64)
            self.texts.append(w)
            h = self.seeds(w)
            hashes.append(h)
            owners.append(np.full(len(h), k))
            places.append(np.arange(len(h)))
        self.hashes, self.owners, self.places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owners, places))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners, self.places = self.hashes[order], self.owners[order], self.places[order]

    def seeds(self, w: np.ndarray) -> np.ndarray:
        """A hash of the word n-gram at each place."""
        if len(w) < SEED:
            return np.zeros(0, np.uint64)
        h = np.zeros(len(w) - SEED + 1, np.uint64)
        for k in range(SEED):
            h = (h ^ w[k : k + len(h)].astype(np.uint64)) * self.MOD
            h ^= h >> np.uint64(29)
        return h

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document whose seed is one of the items', and the seed's hash."""
        known = w >= 0
        if len(w) < SEED or not known.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        count = np.concatenate([[0], np.cumsum(known)])
        full = np.flatnonzero(count[SEED:] - count[:-SEED] == SEED)
        if not len(full):
            return full, np.zeros(0, np.uint64)
        h = self.seeds(w)[full]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        here = self.hashes[at] == h
        return full[here], h[here]


def _ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    get = known.get
    return np.array([get(x, -1) for x in words], np.int64)


def _blocks(items: DataFrame) -> Iterator[ItemIndex]:
    """The items, which are the stated query set, a block of ``BLOCK`` at a time, so that the driver holds no more."""
    block = []
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield ItemIndex(block)
            block = []
    if block:
        yield ItemIndex(block)


def _places(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """doc_id, the words' ids and the seeds of every document that has a seed of an item."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make() -> Callable[..., dict]:
        items = shared.value

        def step(ids: list, texts: list) -> dict:
            out: list[tuple] = []
            for i, text in zip(ids, texts):
                if not text:
                    continue
                w = _ids(leak_words(text), items.words)
                at, h = items.hits(w)
                ways = [(w, at, h)]
                if _JOIN.search(text):
                    w = _ids(leak_words(text, join=False), items.words)
                    at, other = items.hits(w)
                    if not np.array_equal(other, h):  # else nothing but words outside of every seed is parted
                        ways.append((w, at, other))
                out += [(i, w.astype(np.int32).tolist(), at.tolist(), h.view(np.int64).tolist()) for w, at, h in ways if len(at)]
            columns = zip(*out) if out else ([], [], [], [])
            return dict(zip(("doc_id", "words", "places", "seeds"), map(list, columns)))

        return step

    return map_columns(docs, make, "doc_id bigint, words array<int>, places array<int>, seeds array<bigint>")


#: Words, place in the document, place in the item.
Run = tuple[int, int, int]


def exact_runs(at: np.ndarray, h: np.ndarray, index: ItemIndex) -> dict[int, list[Run]]:
    """Of each item that a document's seeds lead to, all exact runs of words.

    Seeds that follow each other on one diagonal of document and item are one run.
    """
    lo, hi = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    n = hi - lo
    k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place, owner = np.repeat(at, n), index.owners[k]
    diagonal = place - index.places[k]
    order = np.lexsort((place, diagonal, owner))
    place, owner, diagonal = place[order], owner[order], diagonal[order]
    begins = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(diagonal) != 0) | (np.diff(place) != 1)])
    first = np.flatnonzero(begins)
    length = np.diff(np.concatenate([first, [len(place)]])) + SEED - 1
    out: dict[int, list[Run]] = {}
    for k, n, p, q in zip(owner[first].tolist(), length.tolist(), place[first].tolist(), (place - diagonal)[first].tolist()):
        out.setdefault(k, []).append((n, p, q))
    return out


def passages(runs: list[Run], item_words: int, words: int) -> list[tuple[int, int]]:
    """Where an alignment through any of the runs can lie, overlapping places as one.

    What stands before a run in an alignment adds nothing less than zero to its
    score, so it spans ``1 - MATCH / GAP`` times the item's words before the run
    at most; the same holds behind it.
    """
    times = 1 - MATCH // GAP
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, p - times * q), min(words, p + n + times * (item_words - q - n))) for n, p, q in runs):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _aligned(found: DataFrame, index: ItemIndex, rarity: np.ndarray) -> DataFrame:
    """doc_id, item_id, longest_run, score, item_words and rarest of each document and item joined by a seed.

    ``rarity`` has the documents that hold each of the index' seeds, in the
    order of ``hashes``.
    """
    shared = found.sparkSession.sparkContext.broadcast((index, rarity))

    def make() -> Callable[..., dict]:
        items, per_seed = shared.value

        def step(ids: list, words: list, places: list, seeds: list) -> dict:
            out, pairs, of = [], [], []
            for i, w, at, hs in zip(ids, words, places, seeds):
                w, at, h = np.array(w, np.int32), np.array(at, np.int64), np.array(hs, np.int64).view(np.uint64)
                n_docs = dict(zip(at.tolist(), per_seed[np.searchsorted(items.hashes, h)].tolist()))
                for k, runs in exact_runs(at, h, items).items():
                    item = items.texts[k]
                    for lo, hi in passages(runs, len(item), len(w)):
                        pairs.append((w[lo:hi], item))
                        of.append(len(out))
                    rarest = min(n_docs[x] for n, p, _ in runs for x in range(p, p + n - SEED + 1))
                    out.append([i, items.ids[k], max(r[0] for r in runs), 0, len(item), rarest])
            for k, score in zip(of, align(pairs).tolist()):
                out[k][3] = max(out[k][3], score)
            columns = zip(*out) if out else ([],) * 6
            return dict(zip(("doc_id", "item_id", "longest_run", "score", "item_words", "rarest"), map(list, columns)))

        return step

    return map_columns(found, make, LEAKS)


LEAKS = "doc_id bigint, item_id bigint, longest_run int, score int, item_words int, rarest bigint"


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and a test item that share a passage.

    ``docs`` has doc_id and text, ``items`` item_id and text, as their first two
    columns; what they have beside is left alone.
    Gives doc_id, item_id, longest_run (exact words), score (Smith-Waterman, 2 a
    word of the item at most), item_words, and rarest: how many documents hold
    that of the pair's seeds which the fewest do. Every pair that shares
    ``SEED`` words in a row is there, and is aligned at each such place.
    Documents with null or empty text, and items of fewer than ``SEED`` words,
    are in no pair. Repeated rows give one pair, that of the longest run.
    Documents stay where they are: only those with a seed are kept in the shared
    folder, and only the counts of seeds and the pairs are shuffled.
    """
    spark = docs.sparkSession
    docs, items = (df.select(*(F.col(c).alias(n) for c, n in zip(df.columns, (of, "text")))) for df, of in ((docs, "doc_id"), (items, "item_id")))
    out = None
    for index in _blocks(items.dropDuplicates()):
        found = materialise(_places(docs, index))
        # one number a seed of the block, whatever the number of documents
        rarity = np.zeros(len(index.hashes), np.int64)
        for seed, n in found.select("doc_id", F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").agg(F.countDistinct("doc_id")).toLocalIterator():
            h = np.int64(seed).view(np.uint64)
            rarity[np.searchsorted(index.hashes, h, "left") : np.searchsorted(index.hashes, h, "right")] = n
        part = _aligned(found.select("doc_id", "words", "places", "seeds"), index, rarity)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType.fromDDL(LEAKS))
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("longest_run", "score", "item_words")), F.min("rarest").alias("rarest"))
