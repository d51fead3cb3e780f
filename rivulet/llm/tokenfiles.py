"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on the document id.

Rows are written in ascending doc_id order, one file for each range of ids. A row holds the id, the number of its range,
how many ids of the range stand before it, and its ids. Readers can take stripes in parallel; a reader that looks for
some doc_ids skips files and stripes by their minima and maxima, and row groups by index and Bloom filter.

Null and empty texts: only the end id. Null doc_ids sort first. Repeated rows are written each; rows of one doc_id are
ordered by a hash of their texts and may lie in several ranges, so no task gets all of them. An empty table gives files without rows. Very long
texts are one row each. Other columns are not written.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from string import punctuation
from unicodedata import category, normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from rivulet.llm.common import only, pieces, scratch, shuffle_parts, table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
CHUNKS_KEPT = 150_000  # encoded parts of chunks that a worker remembers
ROW_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Separates chunks that are encoded together; a chunk that holds it is encoded alone.
MARK = "\x01"
#: Latin letters that are one letter in every normal form and in lower case.
_LETTERS = [c for c in map(chr, range(0x250)) if category(c)[0] == "L" and len(c.lower()) == 1 and normalize("NFC", c) == c]
_WORD = re.compile(f"[{''.join(_LETTERS)}]+").fullmatch
#: A core that marks may leave: its last letter or number is one in every normal form, so that no mark joins it.
_ENDS = f"[{''.join(c for c in map(chr, range(0x250)) if category(c)[0] in 'LN' and len(c.lower()) == 1)}]$"
_MARKS_AT_END = r"(?s)^.*[^!-/:-@\[-`{-~]"  # what stands before them


class ChunkEncoder:
    """Encodes texts by chunks between spaces and line ends, which the tokenizer drops and never merges across."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(MARK)
        assert len(self.mark) == 1
        assert all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = str.maketrans({c: level.pre_tokenize_str(c.lower())[0][0] for c in _LETTERS})
        self.kept: dict[str, bytes] = {"": b""}  # ids of what stands before a chunk's last marks, and of these

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self, cores: list[str]) -> None:
        """Keep the ids of new parts. Plain words need no normalisation but lower case and go to the merges straight."""
        merge, table, rest = self.tokenizer.model.tokenize, self.bytes_of, []
        for c in cores:
            if _WORD(c):
                self.kept[c] = array("i", [t.id for t in merge(c if c.isascii() else c.translate(table))]).tobytes()
            elif MARK in c:
                self.kept[c] = self._ids(c).tobytes()
            else:
                rest.append(c)
        joined = [f" {MARK} ".join(rest[i : i + 256]) for i in range(0, len(rest), 256)]
        for at, got in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(got.ids, np.int32)
            raw, own, start = ids.tobytes(), rest[at * 256 : at * 256 + 256], 0
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            assert len(ends) == len(own)
            for c, end in zip(own, ends, strict=True):
                self.kept[c] = raw[4 * start : 4 * end]
                start = end + 1

    def parts(self, chunks: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Cores and last marks of the chunks, in lower case. Marks at the end are tokens of their own unless they belong
        to a special token; those chunks stay whole and as they are."""
        special = pc.match_substring(chunks, "<|")
        low = pc.if_else(special, chunks, pc.ascii_lower(chunks))
        core = pc.utf8_rtrim(low, characters=punctuation)
        cut = pc.and_not(pc.match_substring_regex(core, _ENDS), special)
        tail = pc.if_else(cut, pc.replace_substring_regex(low, _MARKS_AT_END, ""), "")
        return pc.if_else(cut, core, low).dictionary_encode(), tail.dictionary_encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many are each text's; null is empty."""
        texts = texts.fill_null("")
        for end in "\n\t\r":
            texts = pc.replace_substring(texts, end, " ")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten().dictionary_encode()
        cores, tails = self.parts(chunks.dictionary)
        names = cores.dictionary.to_pylist() + tails.dictionary.to_pylist()
        if new := [x for x in names if x not in self.kept]:
            if len(self.kept) + len(new) > CHUNKS_KEPT:
                self.kept = {"": b""}
                new = names
            self.learn(list(dict.fromkeys(new)))
        raw = list(map(self.kept.__getitem__, names))
        both = np.column_stack((np.asarray(cores.indices), len(cores.dictionary) + np.asarray(tails.indices))).ravel()
        ids, size = _gathered(np.frombuffer(b"".join(raw), np.int32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4, both)
        ids, size = _gathered(ids, size[0::2] + size[1::2], np.asarray(chunks.indices))
        rows = np.cumsum(pc.list_value_length(lists).to_numpy())
        return ids, np.diff(np.cumsum(size)[rows - 1], prepend=0)


def _gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs at the places at of runs that lie one after the other in flat, and their sizes."""
    each, start = size[at], (np.cumsum(size) - size)[at]
    place = np.repeat(start - np.cumsum(each) + each, each)
    place += np.arange(len(place))
    return flat[place], each


_LOADED: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    only(_LOADED)
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of ROW_SCHEMA, in ranges of doc_id, sorted within each."""
    n = shuffle_parts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for batch in pieces(batches, rows=2048):
            ids, sizes = own.encode(batch.column("text"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            before = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(sizes), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(n, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    return rows.mapInArrow(run, ROW_SCHEMA)


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = END_ID, stripe_mb: int = 64, index_stride: int = 1000) -> None:
    """Write the ids of docs (doc_id, text) under the path out."""
    options = {"orc.compress": "ZSTD", "orc.stripe.size": str(stripe_mb << 20), "orc.create.index": "true", "orc.row.index.stride": str(index_stride), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    encoded(docs, path, end_id).write.options(**options).orc(out)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(ROW_SCHEMA).orc(out)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each file
    before, total = {}, 0
    for part, n in sorted(sums):
        before[part], total = total, total + n
    offsets = spark.createDataFrame([*before.items()] or [], "part int, offset long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, out: str, doc_ids: Sequence[int]) -> DataFrame:
    """Rows (doc_id, part, part_start, n_tokens, ids) of a few documents: the filter goes to the reader, which leaves out
    files and stripes by their minima and maxima, and row groups by row index and Bloom filter."""
    return spark.read.schema(ROW_SCHEMA).orc(out).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(int) * 4
        crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
        yield pa.record_batch([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path(TOKENIZER))
    return read_token_files(spark, out).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
