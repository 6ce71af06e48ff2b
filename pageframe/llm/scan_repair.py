"""Problem 2: continuous paragraphs from the text of scanned pages.

The lines of a page, without running headers and page numbers, are one stream
of characters. The stream is decoded into words: known words stand as they are,
and around anything else the cheapest way through a lattice of known words is
taken, in which a word may have confused characters, be parted by a space or by
a hyphen at a line end, or run into the next. Word frequencies come from all
pages. Paragraph boundaries are then chosen by dynamic programming over lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm._common import count_keys, map_columns
from pageframe.llm.truncation import is_furniture

# What a scan makes of a character (left) and what stood there (right).
CONFUSIONS: dict[str, tuple[str, ...]] = {
    "0": ("o", "O"), "1": ("i", "l", "I"), "3": ("e", "B"), "4": ("A",), "5": ("s", "S"), "6": ("b", "G"), "8": ("B",), "9": ("g", "q"),
    "+": ("t",), "|": ("l", "I", "i"), "!": ("l", "i"), "$": ("s", "S"), "€": ("e",), "(": ("c",), "¢": ("c",),
    "a": ("o",), "b": ("h",), "c": ("e", "o"), "e": ("c",), "f": ("t",), "h": ("b",), "i": ("l",), "I": ("l",), "l": ("i", "I"), "n": ("u",), "o": ("a", "e", "c"), "q": ("g",), "t": ("f",), "u": ("n",), "v": ("y",), "y": ("v",), "O": ("Q", "C"),
    "cl": ("d",), "ci": ("a",), "ii": ("u", "n"), "iii": ("m",), "in": ("m",), "li": ("h", "u"), "nn": ("m",), "ri": ("n",), "rn": ("m",), "rri": ("m",), "vv": ("w",), "VV": ("W",), "m": ("rn",), "d": ("cl",), "w": ("vv",), "h": ("li",), "lc": ("k",), "tl": ("d",),
}
# Marks that can stand for a break at a line end. The first two may be a word's own.
OWN_MARKS, BREAK_MARKS = "-‐", "¬­"

#: A word is known if it is at least this share of all words: so at most its
#: inverse are, whatever the size of the corpus.
SHARE = 2e-6
#: How much more frequent than a written form the word must be that it is taken for.
RATIO = 20
#: The cost of each kind of repair, in nats.
CONFUSED, PARTED, JOINED = 6.0, 7.0, 5.0
#: The cost of leaving a form as it stands: once, and for each character.
UNSEEN, LETTER = 13.0, 2.2
#: Sound neighbours on either side that enter the lattice of a stretch.
NEIGHBOURS = 2
#: Share of known words under which a page is no text.
READABLE = 0.3

_STRIP = ".,;:!?()[]{}\"'»«”“„’‘…*•"
_HALVES = re.compile(r"(?<!\S)\S+[-‐¬­] ?\n\s*\S+")
_PARTS = re.compile(r"['’‐-]")
_FOREIGN = re.compile(r"[^\x00-ſȘ-țˆ-˜‐-⁄€™☐]")


def bare(token: str) -> str:
    return token.strip(_STRIP)


def _is_wordish(w: str) -> bool:
    """Letters, perhaps with characters that a scan puts for letters; no number or code."""
    letters = sum(map(str.isalpha, w))
    return letters * 2 > len(w) and letters > 1 and "_" not in w and "/" not in w


#: A word of a decoded stretch: start, end, word, places of confused characters.
Edge = tuple[int, int, str, tuple[int, ...]]


def differing(form: str, word: str) -> range:
    """The places of a form between the start and the end that it shares with the word it is taken for; at least one."""
    first, most = 0, min(len(form), len(word))
    while first < most and form[first] == word[first]:
        first += 1
    last = 0
    while last < most - first and form[-1 - last] == word[-1 - last]:
        last += 1
    return range(min(first, len(form) - 1), max(first + 1, len(form) - last))


class Words(dict):
    """Counts of known words, and what unknown forms are taken for.

    ``counts`` has the words of at least ``SHARE``; ``least`` is the count that
    others are below.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(counts)
        self.total = max(1, sum(counts.values()))
        self.least = max(2, math.ceil(self.total * SHARE))
        self._taken: dict[str, tuple[str, float] | None] = {}
        self._looks: dict[str, tuple[str, str, str, bool, bool, bool]] = {}
        self._ways: dict[tuple[str, ...], list[Edge]] = {}
        # in order, so that the words that start with a prefix are found by halving: a trie without nodes
        self._keys = sorted(w for w, n in counts.items() if n >= RATIO * self.least)
        self._longest = 2 * max(map(len, self._keys), default=0)

    def cost(self, word: str) -> float:
        n = max(self.get(word, 0), self.get(word[:1].lower() + word[1:], 0) if word[:1].isupper() else 0)
        return math.log(self.total / n) if n else math.inf

    def count(self, word: str) -> int:
        n = self.get(word, 0)
        if word[:1].isupper():
            n = max(n, self.get(word[:1].lower() + word[1:], 0))
        return n

    def known(self, word: str) -> bool:
        return self.count(word) >= self.least

    def sound(self, word: str) -> bool:
        """Known, and no frequent misreading of a word that is ``RATIO`` times as frequent."""
        return self.known(word) and self.taken_for(word) is None

    def look(self, token: str) -> tuple[str, str, str, bool, bool, bool]:
        """Of a token: its form, the marks before and behind, and whether the form is wordish, sound, and to be decoded."""
        if token not in self._looks:
            if len(self._looks) > 500_000:
                self._looks.clear()
            form = bare(token)
            at = token.find(form) if form else len(token)
            wordish = len(form) > 1 and _is_wordish(form)
            sound = wordish and self.sound(form) and (form.isalpha() or _PARTS.search(form) is not None)
            self._looks[token] = form, token[:at], token[at + len(form) :], wordish, sound, wordish and not sound and not _FOREIGN.search(form)
        return self._looks[token]

    def taken_for(self, form: str) -> tuple[str, float] | None:
        """The known word that a form with confused characters stands for, and its cost; None if there is none."""
        if form not in self._taken:
            if len(self._taken) > 500_000:
                self._taken.clear()
            self._taken[form] = self._decode(form)
        return self._taken[form]

    def _decode(self, form: str) -> tuple[str, float] | None:
        if len(form) < 3 or not _is_wordish(form):
            return None
        own = max(self.count(form), self.least)
        best: tuple[str, float] | None = None
        fewest = len(form)
        # one letter for another makes most short words
        for end, word, edits in self.readings(form, 0, 2 if len(form) < 4 and form.isalpha() else 1):
            if end == len(form) and edits and len(edits) <= fewest and self.count(word) >= RATIO * own:
                cost = len(edits) * CONFUSED + self.cost(word)
                if best is None or len(edits) < fewest or cost < best[1] or cost == best[1] and word > best[0]:  # small letters on a tie
                    best, fewest = (word, cost), len(edits)
        if best is None and _PARTS.search(form):
            # a compound or an elided article: each part by itself
            out, cost = [], 0.0
            for part in re.split(r"(['’‐-])", form):
                if (word := self.taken_for(part)) is not None:
                    out.append(word[0])
                    cost += word[1]
                elif len(part) < 2 or self.known(part):
                    out.append(part)
                else:
                    return None
            return ("".join(out), cost) if cost else None
        return best

    def readings(self, s: str, start: int, width: int = 1) -> list[tuple[int, str, tuple[int, ...]]]:
        """Frequent words that can begin at a place of a stretch: end, word and the places of its confused characters.

        A word may have any number of confused characters, and of spaces inside,
        by which it is still cheaper than what it stands for, left as it is; the
        walk goes only where a word goes on. What is confused is written with
        ``width`` characters at least.
        """
        keys, out = self._keys, []
        for lowered in (False, True):  # a capital may begin a word that is known in small letters
            todo: list[tuple[int, str, int, tuple[int, ...], int]] = [(start, "", 0, (), 0)]
            while todo:
                at, key, lo, edits, spaces = todo.pop()
                if key and keys[lo] == key and s[at - 1] != " ":
                    out.append((at, key[0].upper() + key[1:] if lowered else key, edits))
                if at == len(s):
                    continue
                if s[at] == " ":
                    if key:
                        todo.append((at + 1, key, lo, edits, spaces + 1))
                    continue
                steps = [(1, s[at], edits)]
                # what is left of the word can't be longer than the longest known one
                if CONFUSED * (len(edits) + 1) + PARTED * spaces < UNSEEN * (spaces + 1) + LETTER * min(len(s) - start, self._longest):
                    steps += [(len(k), r, (*edits, at)) for k in dict.fromkeys((s[at : at + 3], s[at : at + 2], s[at])) if len(k) >= width for r in CONFUSIONS.get(k, ())]
                for n, r, e in steps:
                    if lowered and not key:
                        if not r[0].isupper():
                            continue
                        r = r[0].lower() + r[1:]
                    p = key + r
                    i = bisect_left(keys, p, lo)
                    if i < len(keys) and keys[i].startswith(p):
                        todo.append((at + n, p, i, e, spaces))
        return out

    def decode(self, forms: tuple[str, ...]) -> list[Edge]:
        """The cheapest way through the lattice of a stretch of forms.

        An edge is a word, as (start, end, word, places of confused characters)
        in the stretch with single spaces. A form may stay as it is; else words
        may have confused characters or spaces inside, or run together. Sound
        words, the neighbours, are left as they are unless a part of one belongs
        to a form that is not.
        """
        if forms not in self._ways:
            if len(self._ways) > 200_000:
                self._ways.clear()
            self._ways[forms] = self._decode_stretch(forms)
        return self._ways[forms]

    def _decode_stretch(self, forms: tuple[str, ...]) -> list[Edge]:
        s = " ".join(forms)
        first: dict[int, int] = {}  # the form that begins at a place
        of: list[int] = []
        for k, f in enumerate(forms):
            first[len(of)] = k
            of += [k] * (len(f) + 1)
        ends = {at + len(forms[k]): k for at, k in first.items()}
        sound = [self.sound(f) for f in forms]
        best: dict[int, tuple[float, Edge | None]] = {0: (0.0, None)}
        for at in range(len(s)):
            if at not in best:
                continue
            so_far = best[at][0]
            edges: list[tuple[float, Edge]] = []
            if at in first:
                k = first[at]
                f = forms[k]
                better = None if sound[k] else self.taken_for(f)
                edges.append((self.cost(f) if sound[k] else UNSEEN + LETTER * len(f), (at, at + len(f), f, ())))
                if better:
                    edges.append((min(better[1], UNSEEN + LETTER * len(f) - 0.1), (at, at + len(f), better[0], tuple(at + x for x in differing(f, better[0])))))
            if not all(sound[of[at] : of[at] + 1 + NEIGHBOURS]):
                for end, word, edits in self.readings(s, at):
                    parts = forms[of[at] : of[end - 1] + 1]
                    whole = at in first and end in ends
                    if whole and len(parts) == 1:
                        continue  # given above
                    if all(sound[of[at] : of[end - 1] + 1]) or (end not in ends or at not in first) and (sound[of[at]] or sound[of[end - 1]]):
                        continue
                    written = s[at:end].replace(" ", "")
                    if len(word) < (3 if edits else 2) or edits and (not _is_wordish(written) or self.count(word) < RATIO * max(self.least, self.count(written))):
                        continue
                    if not whole and (edits and parts[0][:1].isupper() or self.count(word) <= (1000 if edits else 50) * self.least and len(word) < 4):
                        continue  # a capital may begin a name; chance finds short words in anything
                    cost = self.cost(word) + CONFUSED * len(edits) + PARTED * (len(parts) - 1) + (0.0 if at in first else JOINED)
                    edges.append((cost, (at, end, word, edits)))
            for cost, edge in edges:
                to = edge[1] + (edge[1] in ends and edge[1] < len(s))
                if to not in best or so_far + cost < best[to][0]:
                    best[to] = so_far + cost, edge
        out: list[Edge] = []
        at = len(s)
        while at and (edge := best[at][1]) is not None:
            out.append(edge)
            at = edge[0]
        return out[::-1]

    def across(self, left: str, right: str, mark: str) -> str | None:
        """What two halves at a line end are: ``break``, ``compound`` or None (no word goes on).

        The cheaper of the whole word, itself or with confused characters, and
        of the two words with their own hyphen is taken; halves of an unknown
        word, such as a name, are a break.
        """
        if not left or not right or not left[-1].isalpha() or not right[0].isalpha() and not (right[0] in "01+|5" and len(right) > 1):
            return None
        whole, own = left + right, f"{left}-{right}"
        joined = self.count(whole)
        hyphened = max(self.count(own), self.count(own.lower()) if left.isupper() else 0)
        if hyphened and hyphened >= joined:
            return "compound" if mark in OWN_MARKS else "break"
        if joined or self.taken_for(whole):
            return "break"
        if mark in OWN_MARKS and (self.taken_for(own) is not None and self.taken_for(whole) is None):
            return "compound"
        return "break"


class Page:
    """The lines of a page with what was found on each."""

    __slots__ = ("furniture", "lines", "misread", "readable", "repaired", "split")

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.furniture = [bool(x.strip()) and is_furniture(x) for x in lines]
        self.split = [False] * len(lines)
        self.misread = [False] * len(lines)
        self.repaired = list(lines)
        self.readable = True


class _Token:
    """A token of the stream: where it stands, its form without marks, and, if it goes on after a line end, where its second half begins."""

    __slots__ = ("after", "before", "cut", "end", "form", "line", "next_line", "odd", "sound", "wordish")

    def __init__(self, token: str, line: int, words: Words) -> None:
        self.form, self.before, self.after, self.wordish, self.sound, self.odd = words.look(token)
        self.line = self.next_line = line
        self.cut = len(self.form)
        self.end = False


def _linked(a: _Token, b: _Token) -> bool:
    """No mark stands between two neighbours, and both are words."""
    return not (a.after or b.before or a.end or b.end) and a.wordish and b.wordish


def _stream(page: Page, words: Words) -> list[_Token]:
    """The tokens of all lines but furniture, halves at line ends joined."""
    body = [k for k, x in enumerate(page.lines) if x.strip() and not page.furniture[k]]
    split = {k: page.lines[k].split() for k in body}
    out: list[_Token] = []
    for n, k in enumerate(body):
        tokens = split[k]
        out += [_Token(x, k, words) for x in tokens]
        if not tokens:
            continue
        last = tokens[-1]
        if len(last) < 2 or last[-1] not in OWN_MARKS + BREAK_MARKS:
            continue
        after = split[body[n + 1]] if n + 1 < len(body) else []
        left, mark = last[:-1].lstrip(_STRIP), last[-1]
        right = bare(after[0]) if after else ""
        kind = words.across(left, right, mark) if right else None
        if kind == "break" or not right and mark in BREAK_MARKS and left.isalpha():
            page.split[k] = True
        if kind:
            # the first token of the next line moves up
            second = after.pop(0)
            whole = _Token(left + right if kind == "break" else f"{left}-{right}", k, words)
            whole.before, whole.after = last[: len(last) - 1 - len(left)], second[second.find(right) + len(right) :]
            whole.next_line, whole.cut = body[n + 1], len(whole.form) - len(right)
            out[-1] = whole
        else:
            out[-1].end = True  # half of something unknown
    if out and body and out[-1].line == body[-1] and out[-1].form and (out[-1].after or out[-1].form)[-1].isalnum():
        out[-1].end = True  # a text that was cut off
    return out


def decode_page(text: str, words: Words) -> Page:
    """Find and repair the defects of one page's lines."""
    page = Page(text.split("\n"))
    stream = _stream(page, words)
    seen = known = 0
    for x in stream:
        if x.line == x.next_line and x.wordish and not x.end:
            seen += 1
            known += x.sound
    odd = [x.odd and not x.end for x in stream]
    new = [x.before + x.form + x.after for x in stream]
    at, done = 0, 0
    while at < len(stream):
        if not odd[at]:
            at += 1
            continue
        lo = hi = at
        # a neighbour belongs to the stretch; two of them on either side, as a word may be in three parts
        while lo > done and at - lo < NEIGHBOURS and _linked(stream[lo - 1], stream[lo]):
            lo -= 1
        last = at
        while hi + 1 < len(stream) and hi - last < NEIGHBOURS and _linked(stream[hi], stream[hi + 1]):
            hi += 1
            if odd[hi]:
                last = hi
        run = stream[lo : hi + 1]
        starts, length = [], 0
        for x in run:
            starts.append(length)
            length += len(x.form) + 1
        made: list[list[str]] = [[] for _ in run]
        for start, end, word, edits in words.decode(tuple(x.form for x in run)):
            k = max(i for i, b in enumerate(starts) if b <= start)
            made[k].append(word)
            for e in edits:
                i = max(i for i, b in enumerate(starts) if b <= e)
                page.misread[run[i].line if e - starts[i] < run[i].cut else run[i].next_line] = True
            if edits:
                known += run[k].line == run[k].next_line
        for k, (x, w) in enumerate(zip(run, made)):
            new[lo + k] = x.before + " ".join(w) + x.after if w else ""
        at = done = hi + 1
    by_line: dict[int, list[str]] = {}
    for x, w in zip(stream, new):
        by_line.setdefault(x.line, []).append(w)
    for k, x in enumerate(page.lines):
        if x.strip() and not page.furniture[k]:
            page.repaired[k] = " ".join(w for w in by_line.get(k, ()) if w)
    page.readable = known >= READABLE * seen
    return page


# --- paragraphs

_STARTS = re.compile(r"\s*(?:[-*+•‣▪☐–—]\s|[(\[]?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.)\]]\s)")
_ENDS = re.compile(r"[.!?:;…][\"»”’)\]]*$")


def paragraphs(lines: list[str]) -> list[list[int]]:
    """Indices of the lines of each paragraph, by dynamic programming.

    A break between two lines has a cost from what stands there: a blank line,
    the mark that a line ends in, its length against the page's, a number or an
    item mark, a small letter. A paragraph costs something itself, more if it is
    one line that is no sentence. The cheapest way to part the page is taken.
    """
    kept = [k for k, x in enumerate(lines) if x.strip()]
    if not kept:
        return []
    width = sorted(len(lines[k]) for k in kept)[(len(kept) * 3) // 4]

    def apart(a: int, b: int) -> float:
        """What parting lines a and b costs, against keeping them together."""
        x, y = lines[a].strip(), lines[b].strip()
        cost = 0.0
        if b - a > 1:
            cost -= 4.0
        cost += -1.0 if _ENDS.search(x) else 2.5
        cost -= 2.0 if len(x) < 0.75 * width else 0.0
        cost -= 2.5 if _STARTS.match(y) else 0.0
        cost += 3.0 if y[:1].islower() else -0.5
        # the next line's first word would have had room
        cost -= 1.5 if len(x) + 1 + len(y.split()[0]) < width - 1 else 0.0
        return cost

    best = [0.0] + [math.inf] * len(kept)
    via = [0] * (len(kept) + 1)
    for end in range(1, len(kept) + 1):
        inside = 0.0
        for start in range(end - 1, -1, -1):
            if start < end - 1:
                inside += max(0.0, -apart(kept[start], kept[start + 1]))
                if inside > best[end]:
                    break
            one = end - start == 1 and not _ENDS.search(lines[kept[start]].strip())
            cost = best[start] + inside + (max(0.0, apart(kept[start - 1], kept[start])) if start else 0.0) + 0.3 + 0.2 * one
            if cost < best[end]:
                best[end], via[end] = cost, start
    out, at = [], len(kept)
    while at:
        out.append(kept[via[at] : at])
        at = via[at]
    return out[::-1]


def repair_text(text: str | None, words: Words) -> str | None:
    """The page as continuous paragraphs, parted by blank lines; None for null, "" for a blank text."""
    if text is None:
        return None
    page = decode_page(text, words)
    lines = ["" if f else x for f, x in zip(page.furniture, page.repaired)]
    # a header inside a paragraph leaves no blank line behind
    kept = [x for x, f in zip(lines, page.furniture) if not f]
    return "\n\n".join(" ".join(kept[k].strip() for k in p if kept[k].strip()) for p in paragraphs(kept))


# --- on tables


def word_counts(df: DataFrame, text_column: str) -> DataFrame:
    """How often each word and each part of a compound stands in all texts.

    Halves at line ends are left out, as they would make words of their own.
    """

    def make() -> Callable[..., dict]:
        def step(texts: list) -> dict:
            out: Counter = Counter()
            for token, n in Counter(_HALVES.sub(" ", "\n\n\n".join(t for t in texts if t)).split()).items():
                w = bare(token)
                if len(w) > 1 and w[0].isalpha() and not any(map(str.isdigit, w)):
                    out[w] += n
                    if _PARTS.search(w):
                        for part in _PARTS.split(w):
                            if len(part) > 1:
                                out[part] += n
            return out

        return step

    return count_keys(df.select(text_column), make, "word string, n bigint", lambda k: (k,))


def fit_words(df: DataFrame, text_column: str) -> Words:
    """The known words: those of at least ``SHARE`` of all, so at most 1 / ``SHARE`` on the driver."""
    counts = word_counts(df, text_column)
    # the total is one row of the same counts, so that the plan reads the texts once and reuses their exchange
    total = counts.agg(F.sum("n").alias("total")).hint("broadcast")
    kept = counts.join(total, F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("total") * SHARE)))
    return Words({r["word"]: r["n"] for r in kept.collect()})


def line_defects(df: DataFrame, id_column: str, text_column: str, words: Words) -> DataFrame:
    """One row a line and defect: ``record_id``, ``line_no`` (from 0), ``defect``.

    Defects are ``split_word``, ``misread`` and ``furniture``. Null and blank
    texts, and texts of which hardly a word is known, have none. Repeated ids
    give each defect once.
    """
    shared = df.sparkSession.sparkContext.broadcast(dict(words))

    def make() -> Callable[..., dict]:
        local = Words(shared.value)

        def step(ids: list, texts: list) -> dict:
            out: list[tuple] = []
            for i, t in zip(ids, texts):
                if not t or not t.strip():
                    continue
                page = decode_page(t, local)
                if not page.readable:
                    continue
                for name, flags in (("split_word", page.split), ("misread", page.misread), ("furniture", page.furniture)):
                    out += [(i, k, name) for k, f in enumerate(flags) if f]
            columns = zip(*out) if out else ([], [], [])
            return dict(zip(("record_id", "line_no", "defect"), map(list, columns)))

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(df.select(id_column, text_column), make, f"record_id {kind}, line_no int, defect string").distinct()


def repair_pages(df: DataFrame, id_column: str, text_column: str, words: Words) -> DataFrame:
    """The id and ``repaired`` text of every row."""
    shared = df.sparkSession.sparkContext.broadcast(dict(words))

    def make() -> Callable[..., dict]:
        local = Words(shared.value)
        return lambda ids, texts: {id_column: ids, "repaired": [repair_text(t, local) for t in texts]}

    return map_columns(df.select(id_column, text_column), make, f"{id_column} {df.schema[id_column].dataType.simpleString()}, repaired string")
