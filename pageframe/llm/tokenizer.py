"""Problem 6: encode a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's published pattern. Within a piece
the encoder takes the longest token that matches at each place, and steps back
to a shorter one where a pair-compatibility table says that the merges would
not have left the pair of neighbours as they are. That gives exactly the tokens
of the merge procedure, in time linear in the piece. Distinct pieces are encoded
once a worker process. Decoding reads token bytes through an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from pageframe.llm._common import map_columns

#: Where the public vocabulary files lie.
TOKENIZERS = os.environ.get("PAGEFRAME_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BacktrackingEncoder:
    """Exact BPE of byte strings by longest matches and a compatibility table.

    ``ranks`` maps each token's bytes to its id; ids are in merge order behind
    those of the single bytes.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        # one letter a byte, so that the automaton's positions are byte positions
        self._matcher = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in ranks:
            self._matcher.add_word(token.decode("latin-1"))
        self._matcher.make_automaton()
        self._longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int | None] = {}
        lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self._offsets = np.concatenate([[0], np.cumsum(lengths)])
        self._bytes = b"".join(self.tokens)

    @classmethod
    def from_file(cls, path: str) -> BacktrackingEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _halves_of(self, token: int) -> tuple[int, int] | None:
        """The pair that merging makes the token of; None for a single byte."""
        if token not in self._halves:
            b = self.tokens[token]
            found = None
            if len(b) > 1:
                # merge the token's own bytes until two parts are left
                parts = [self.ranks[b[i : i + 1]] for i in range(len(b))]
                while len(parts) > 2:
                    ranked = [(self.ranks.get(self.tokens[x] + self.tokens[y], token), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))]
                    rank, k = min(ranked)
                    if rank >= token:
                        raise ValueError(f"token {token} is not reached by merges")
                    parts[k : k + 2] = [rank]
                found = parts[0], parts[1]
            self._halves[token] = found
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, both survive the merges.

        They don't if, at some stage of their making, the parts that meet at the
        border merge before the next step inside either token.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            x, y, due = left, right, len(self.tokens)
            known = True
            while True:
                across = self.ranks.get(self.tokens[x] + self.tokens[y])
                if across is not None and across < due:
                    # the parts at the border meet before ``due`` is made
                    known = False
                    break
                hx, hy = self._halves_of(x), self._halves_of(y)
                if hx is None and hy is None:
                    break
                # take apart the one made last; of equal parts the left is made first
                if hy is None or hx is not None and x > y:
                    due, x = x, hx[1]
                else:
                    due, y = y + 1, hy[0]
            self._fits[key] = known
        return known

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self._shorter:
            b = self.tokens[token]
            self._shorter[token] = next((r for k in range(len(b) - 1, 0, -1) if (r := self.ranks.get(b[:k])) is not None), None)
        return self._shorter[token]

    def _matches(self, piece: bytes) -> list[int]:
        """The length of the longest token at each place of the piece."""
        longest = [1] * len(piece)
        for end, n in self._matcher.iter(piece.decode("latin-1")):
            start = end - n + 1
            if n > longest[start]:
                longest[start] = n
        return longest

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece; () for an empty one."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if not piece:
            return ()
        longest = self._matches(piece)
        barred = bytearray(len(piece) + 1)  # places from which no way leads on
        out: list[int] = []
        at = 0
        token: int | None = self.ranks[piece[: longest[0]]]
        while True:
            while token is not None:
                end = at + len(self.tokens[token])
                if not barred[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self._next_shorter(token)
            if token is None:
                # no token fits behind the last one: take that one back
                barred[at] = 1
                last = out.pop()
                at -= len(self.tokens[last])
                token = self._next_shorter(last)
                continue
            out.append(token)
            at = end
            if at == len(piece):
                return tuple(out)
            token = self.ranks[piece[at : at + longest[at]]]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for."""
        o, b = self._offsets, self._bytes
        return b"".join(b[o[i] : o[i + 1]] for i in ids)


class PieceCache(dict):
    """Ids of text pieces; a worker process encodes each distinct piece once.

    It starts anew at ``LIMIT`` pieces, so its memory is bounded whatever
    the corpus holds.
    """

    LIMIT = 500_000

    def __init__(self, encoder: BacktrackingEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = self[piece] = self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return ids


#: A worker process' encoders by vocabulary file: tasks that follow each other in it share one.
_ENCODERS: dict[str, PieceCache] = {}


def _encoder(name: str) -> PieceCache:
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceCache(BacktrackingEncoder.from_file(SparkFiles.get(name)))
    return _ENCODERS[name]


def encode_corpus(df: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """The id and ``ids array<int>`` of every row.

    A null or empty text gives an empty list. Strings that look like special
    tokens are ordinary text. Texts are encoded whole, however long; repeated
    rows stay. Nothing is shuffled. The driver reads the vocabulary file and
    Spark hands it out; a worker process builds its encoder once.
    """
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make() -> Callable[..., dict]:
        cut = regex.compile(PATTERN).findall
        ids_of = _encoder(name)

        def step(ids: list, texts: list) -> dict:
            flat: list[int] = []
            offsets = [0]
            for text in texts:
                if text:
                    for piece in cut(text):
                        flat += ids_of[piece]
                offsets.append(len(flat))
            values = pa.array(np.array(flat, np.int32))
            return {"id": ids, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(df.select(id_column, text_column), make, f"{id_column} {kind}, ids array<int>")
