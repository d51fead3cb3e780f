"""Byte-level BPE encoding and decoding by monoid tree reduction.

Each match of the split pattern is encoded by halves down to single bytes; two encoded halves are joined by encoding
again the tokens around the boundary, in a window of one token on either side that doubles until the tokens beside it
stay. That they stay is provable: a sequence of tokens is the encoding of its bytes if and only if every two neighbours
are the encoding of theirs (van Antwerpen and Neubeck, "So many tokens, so little time", 2024), and inside a half and
inside the window that holds already, so only the window's two ends are to be tried. Nodes of the tree and pairs of tokens
recur, so a worker remembers them. A match that is a token as a whole is that token, as in tiktoken, whatever the merges
say. Decoding concatenates up a tree of FAN children to a node.

Null and empty texts: no ids, empty bytes. Rows and other columns stay as they are; ids and decoded replace columns of
these names. Repeated rows are encoded each; an empty table gives none. A match of any length, a text of many megabytes
without a space too, goes through the same tree; its depth grows with the logarithm of the length.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import only, pieces, table

RANKS = "byte_bpe_multi_50k.tiktoken"
FAN = 64  # children of a node when decoding
PIECES_KEPT = 300_000  # encoded matches, nodes and pairs of tokens that a worker remembers, each
NODE_BYTES = 8  # nodes of more bytes are not remembered
HEAP_FROM = 64  # bytes from which a window is merged with a heap
_NONE = 1 << 60


class ByteBPE:
    """The ranks of a tiktoken file, and what was encoded by them so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # kept before the last time that there were too many
        self.nodes: dict[bytes, tuple[int, ...]] = {}
        self.fits_kept: dict[int, bool] = {}
        self.edges_kept: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}  # of tokens
        self.joins = 0  # how often two halves were joined

    def merge(self, data: bytes, below: int = _NONE) -> tuple[int, ...]:
        """The encoding of a window, with tokens of rank less than below: repeatedly merge the adjacent pair of least
        rank, the leftmost of equals."""
        if len(data) >= HEAP_FROM and below == _NONE:
            return self._merge_long(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while order and (least := min(order)) < below:
            i = order.index(least)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], _NONE)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """merge() with a heap over a linked list."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def edges(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The tokens that stand at the left and at the right edge while the token is made, from a byte up to itself."""
        got = self.edges_kept.get(token)
        if got is None:
            data = self.tokens[token]
            if len(data) == 1:
                got = ((token,), (token,))
            else:
                two = self.merge(data, token)
                got = ((*self.edges(two[0])[0], token), (*self.edges(two[-1])[1], token))
            self.edges_kept[token] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes: no pair across the boundary is merged before the edges
        grow past it. Tokens are made in the order of their ranks, equal ones from left to right."""
        key = a * len(self.tokens) + b
        known = self.fits_kept.get(key)
        if known is None:
            if len(self.fits_kept) >= PIECES_KEPT:
                self.fits_kept.clear()
            left, right, get, tokens, i, j = self.edges(a)[1], self.edges(b)[0], self.ranks.get, self.tokens, 0, 0
            known = True
            while True:
                own = left[i + 1] if i + 1 < len(left) else _NONE
                other = right[j + 1] if j + 1 < len(right) else _NONE
                across = get(tokens[left[i]] + tokens[right[j]], _NONE)
                if across < own and across <= other:
                    known = False
                    break
                if own <= other:
                    i += 1
                    if own == _NONE:
                        break
                else:
                    j += 1
            self.fits_kept[key] = known
        return known

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encoded neighbours."""
        self.joins += 1
        if self.fits(a[-1], b[0]):  # the halves may stand side by side as they are
            return a + b
        width = 1
        while True:
            low, high = max(0, len(a) - width), min(len(b), width)
            window = self.window(a[low:] + b[:high])
            if (not low or self.fits(a[low - 1], window[0])) and (high == len(b) or self.fits(window[-1], b[high])):
                return a[:low] + window + b[high:]
            width *= 2

    def window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of some neighbours, remembered like a node: bytes have one encoding."""
        data = self.decode(ids)
        got = self.nodes.get(data)
        if got is None:
            got = self.merge(data)
            self.keep(data, got)
        return got

    def keep(self, data: bytes, ids: tuple[int, ...]) -> None:
        if len(data) <= NODE_BYTES:
            if len(self.nodes) >= PIECES_KEPT:
                self.nodes.clear()
            self.nodes[data] = ids

    def tree(self, data: bytes) -> tuple[int, ...]:
        nodes = self.nodes
        got = nodes.get(data)
        if got is None:
            half = len(data) >> 1
            if half:
                a, b = data[:half], data[half:]
                got = self.join(nodes.get(a) or self.tree(a), nodes.get(b) or self.tree(b))
            else:
                got = (self.ranks[data],)
            self.keep(data, got)
        return got

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.concatenated(list(map(self.tokens.__getitem__, ids)))

    @staticmethod
    def concatenated(parts: list[bytes]) -> bytes:
        """The parts joined up a tree."""
        while len(parts) > FAN:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return b"".join(parts)

    def learn(self, matches: set[str], kept: dict[str, bytes]) -> None:
        """Keep the ids of matches; those of the last generation are taken from there."""
        for m in matches:
            ids = self.older.get(m)
            if ids is None:
                data = m.encode()
                own, whole = self.tree(data), self.ranks.get(data)
                ids = array("i", own if whole is None else (whole,)).tobytes()
            kept[m] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        found = [self.find(t) for t in texts]
        matches = set().union(*found)
        new = matches.difference(self.kept)
        if new and len(self.kept) + len(new) > PIECES_KEPT:
            self.older, self.kept, new = self.kept, {}, matches
        self.learn(new, self.kept)
        get = self.kept.__getitem__
        return [b"".join(map(get, f)) for f in found]


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker process."""
    only(_LOADED)
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def lists_of(raw: list[bytes]) -> pa.Array:
    """An array of int32 lists from their bytes."""
    ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.record_batch([batch.column(i) for i in keep] + [column], [batch.schema.names[i] for i in keep] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """df with the column ids (array<int>) of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in pieces(batches, column, size=2 << 20):
            yield with_column(batch, "ids", lists_of(coder.encode([t or "" for t in batch.column(column).to_pylist()])))

    return df.mapInArrow(run, _schema(df, "ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """df with the column decoded (binary) of its lists of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in pieces(batches, column):
            lists = batch.column(column)
            token = list(map(coder.tokens.__getitem__, np.asarray(lists.flatten()).tolist()))
            ends = np.cumsum([0] + [x or 0 for x in lists.value_lengths().to_pylist()])
            out = [coder.concatenated(token[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield with_column(batch, "decoded", pa.array(out, pa.binary()))

    return df.mapInArrow(run, _schema(df, "decoded", T.BinaryType()))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    both = decode(ids, path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
