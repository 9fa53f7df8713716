"""Encoding a corpus with a byte-level BPE vocabulary, in time linear in the text.

Bytes are mapped to the characters 0-255 (Latin-1), so that an Aho-Corasick
automaton over the vocabulary finds the longest token at every place. The encoder takes longest matches from left to right and goes
back wherever a token may not follow its neighbour: two adjacent tokens are compatible if undoing their merges in rank
order never meets a merge across their border. The only sequence all of whose neighbours are compatible is the one the merges give.
Compatibility is memoised by pair, dead positions by bit, so no position is tried twice in vain.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of at most this many characters are remembered, and how many; both bound a worker's memory only.
MEMO_CHARS, MEMO_PIECES, MEMO_PAIRS = 40, 150_000, 2_000_000


class BytePairEncoder:
    """Vocabulary file of (base64 token, rank) lines; ranks are the ids and the order of merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.length = [len(t) for t in self.bytes]
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * size  # longest token that is a proper prefix
        self.machine = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.machine.add_word(token.decode("latin-1"), i)
            if len(token) > 1:
                self.left[i], self.right[i] = self._halves(ranks, token, i)
                self.merged[self.left[i], self.right[i]] = i
                for k in range(len(token) - 1, 0, -1):
                    if (p := ranks.get(token[:k])) is not None:
                        self.shorter[i] = p
                        break
        self.machine.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    @staticmethod
    def _halves(ranks: dict[bytes, int], token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1], rank)) < rank]
            if not options:
                raise ValueError(f"token {rank} is not made by merges")
            k = min(options)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a | b as two tokens: undo the later merge of both sides until one is a byte."""
        left, right, merged = self.left, self.right, self.merged
        bound = 1 << 60
        while True:
            across = merged.get((a, b))
            if across is not None and across < bound:
                return False
            for undo_left in (True, False) if a > b else (False, True):
                if undo_left and self.length[a] > 1:
                    bound, a = a, right[a]
                    break
                if not undo_left and self.length[b] > 1:
                    bound, b = b + 1, left[b]
                    break
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._fits(a, b)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the text."""
        size = len(data)
        longest = [-1] * (size + 1)
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, token in self.machine.iter(data.decode("latin-1")):
            longest[end - length[token] + 1] = token  # matches come by their end: the last of a start is its longest
        if longest[0] >= 0 and length[longest[0]] == size:
            return [longest[0]]
        alive = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
            else:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                alive[at] = 0
                out.pop()
                at, token = at - length[last], last
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts give []."""
        out: list[int] = []
        if not text:
            return out
        memo = self._pieces
        for piece in self.pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_made: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder a process: Python workers live on from task to task."""
    if (path, pattern) not in _made:
        _made[path, pattern] = BytePairEncoder(path, pattern)
    return _made[path, pattern]


def encode_corpus(df: DataFrame, key: str, text: str, path: str, pattern: str, *, ids: str = "ids", counts_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, ids) with the number of ids where ``counts_only``.

    ``path`` is a vocabulary file that every executor can read. Null and empty texts give the empty list (or 0).
    Every row is kept, repeated ones too; texts are encoded whole; no shuffle; only two columns are read.
    """
    if ids == key:
        raise ValueError("ids may not have the key's name")
    kept = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = kept.schema[0].dataType.simpleString()
    out_type = "int" if counts_only else "array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            if counts_only:
                values = pa.array([len(enc.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            else:
                flat, ends = array("i"), array("i", [0])
                for t in batch.column(1).to_pylist():
                    flat.extend(enc.encode(t))
                    ends.append(len(flat))
                values = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, ids])

    return kept.mapInArrow(run, f"`{key}` {kind}, `{ids}` {out_type}")
