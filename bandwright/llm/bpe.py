"""Token ids of a corpus by a public byte-level BPE vocabulary.

Text is cut into pre-tokens by the vocabulary's pattern. In a pre-token, the pairs that can merge wait in buckets, one per
merge rank, holding positions in a linked list of tokens; a bitmap of the filled buckets on two levels gives the lowest
rank by find-first-set. A bucket's positions are merged from left to right, and entries whose pair is no longer there are
skipped. Each merge costs constant time, so a pre-token of a million letters takes time in proportion to its length.
A worker process keeps the ids of pre-tokens it has met, up to ``MEMO`` (then it starts anew): a memo, not a limit.

Cases: null and empty texts have no ids (an empty list) and 0 tokens; strings that look like special tokens are ordinary
text; texts of any length are encoded whole; null ids of documents and repeated rows pass through as they are; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 500_000


class Encoder:
    """Ids of a pre-token by one vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """The id of two tokens as one, which is the pair's rank; -1 if they don't merge."""
        key = a << 32 | b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.text[a] + self.text[b], -1)
        return r

    def encode(self, piece: bytes) -> list[int]:
        n = len(piece)
        tok = [self.single[b] for b in piece]
        if n < 2:
            return tok
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}  # 256 buckets a word; bit r & 255 of word r >> 8
        high = 0  # bit w is set if word w isn't 0
        rank = self.rank
        for i in range(n - 1):
            if (r := rank(tok[i], tok[i + 1])) >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    low[w] = low.get(w, 0) | 1 << (r & 255)
                    high |= 1 << w
        while high:
            w = (high & -high).bit_length() - 1
            word = low[w]
            bit = word & -word
            r = w << 8 | bit.bit_length() - 1
            if word == bit:
                high ^= 1 << w
                low[w] = 0
            else:
                low[w] = word ^ bit
            for i in sorted(buckets.pop(r)):
                j = nxt[i]
                if tok[i] < 0 or j >= n or rank(tok[i], tok[j]) != r:
                    continue  # stale
                tok[i], tok[j] = r, -1
                k = nxt[i] = nxt[j]
                if k < n:
                    prv[k] = i
                h = prv[i]
                for p, q in ((h, i), (i, k)):
                    if p >= 0 and q < n and (s := rank(tok[p], tok[q])) >= 0:
                        if s in buckets:
                            buckets[s].append(p)
                        else:
                            buckets[s] = [p]
                            v = s >> 8
                            low[v] = low.get(v, 0) | 1 << (s & 255)
                            high |= 1 << v
        return [t for t in tok if t >= 0]


class _Memo(dict):
    """Pre-token -> what ``make`` gives of its ids."""

    def __init__(self, encoder: Encoder, make) -> None:
        super().__init__()
        self.encoder, self.make = encoder, make

    def __missing__(self, piece: str):
        if len(self) > MEMO:
            self.clear()
        x = self[piece] = self.make(self.encoder.encode(piece.encode()))
        return x


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file (base64 bytes and rank a line), read once a process."""
    kept = sys.modules.setdefault("_bandwright_kept", types.ModuleType("_bandwright_kept"))
    name = f"encoder:{path}"
    if not hasattr(kept, name):
        with open(path, "rb") as f:
            setattr(kept, name, Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))
    return getattr(kept, name)


def memo(path: str, kind: str) -> _Memo:
    """The process's memo of ids (kind "ids") or their number ("count")."""
    kept = sys.modules.setdefault("_bandwright_kept", types.ModuleType("_bandwright_kept"))
    name = f"{kind}:{path}"
    if not hasattr(kept, name):
        setattr(kept, name, _Memo(encoder(path), len if kind == "count" else tuple))
    return getattr(kept, name)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids) of every row."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = memo(path, "ids").__getitem__, regex.compile(PATTERN).findall
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                flat, ends = array("i"), [0]
                for text in part.column(1):
                    if (t := text.as_py()) is not None:
                        flat.extend(chain.from_iterable(map(known, find(t))))
                    ends.append(len(flat))
                values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(ids, f"`{id_col}` {kind}, ids array<int>")


def count(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """(keep, tokens) of every row: the number of ids ``encode`` gives."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = memo(path, "count").__getitem__, regex.compile(PATTERN).findall
        for batch in batches:
            n = [sum(map(known, find(t))) if (t := x.as_py()) else 0 for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, text_col).mapInArrow(counts, f"{kinds}, tokens bigint")
