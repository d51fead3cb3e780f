"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and a rest. Pieces are dealt by row number
into shards of about SHARD_ROWS and packed there in descending length: a piece goes into the open bin that it fills best.
If none has room a bin is opened, of the permitted length whose cost for each token is least when it is filled with the
pieces still to come (always the longest that fits): so the mix of lengths follows the lengths of the pieces, and the
choice for one bin sees what is left for the others. At the end each bin shrinks to the least permitted length that holds
its contents.

A document's length is its tokens in op3's encoding and the end mark; null and empty texts have length 1. Every row is
packed, repeated rows too, each on its own; rows with a null doc_id are packed under null. Ties of length are packed by
doc_id and piece; of bins with equal room the last changed is taken, of lengths that cost alike the shorter. Very long texts
are many pieces. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import pieces, staged, table
from rivulet.llm.tokenfiles import TOKENIZER, encoder

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
#: Tokens that a bin costs besides its own, and the length at which attention doubles the cost of a token.
PER_BIN, ATTENTION = 128, 65_536
PACKED = "doc_id long, piece int, piece_start long, n_tokens int, bin_id long, capacity int, bin_start int"


def bin_cost(length: int) -> float:
    return PER_BIN + length * (1 + length / ATTENTION)


def fill(room: int, count: dict[int, int], sizes: int) -> int:
    """Tokens that the pieces still to come (count by size; bit s of sizes: there are any) bring into the room, always
    the longest that fits."""
    used = 0
    while fits := sizes & ((2 << (room - used)) - 1) & ~1:
        size = fits.bit_length() - 1
        used += size * min(count[size], (room - used) // size)
        sizes &= (1 << size) - 1
    return used


def pack(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and start in the bin of each item, and the final length of each bin; sizes descend."""
    lengths = sorted(lengths)
    bins, starts = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used: list[int] = []
    open_: dict[int, list[int]] = {}  # bins by room
    rooms = 0  # bit r: a bin with room r is open
    values, counts = np.unique(sizes, return_counts=True)
    count = dict(zip(values.tolist(), counts.tolist(), strict=True))
    to_come = sum(1 << s for s in count)
    for i, size in enumerate(sizes.tolist()):
        count[size] -= 1
        if not count[size]:
            to_come ^= 1 << size
        fits = rooms >> size
        if fits:
            r = (fits & -fits).bit_length() - 1 + size
            b = open_[r].pop()
            if not open_[r]:
                rooms ^= 1 << r
        else:
            r = min((c for c in lengths if c >= size), key=lambda c: (bin_cost(c) / (size + fill(c - size, count, to_come)), c))
            b = len(used)
            used.append(0)
        bins[i], starts[i] = b, used[b]
        used[b] += size
        r -= size
        if r:
            open_.setdefault(r, []).append(b)
            rooms |= 1 << r
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return bins, starts, final


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words between ASCII white space, and the end mark."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("n_tokens"))


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): tokens of op3's tokenizer, and the end mark."""
    path = public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in pieces(batches, rows=2048):
            _, sizes = own.encode(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(sizes + 1, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def packed(lengths_of: DataFrame, lengths: Sequence[int] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """PACKED for each piece of the rows (doc_id, n_tokens)."""
    most = max(lengths)
    rows = lengths_of.select("doc_id", F.greatest("n_tokens", F.lit(1).cast("long")).alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "packing")  # lengths are taken once, and row numbers stay
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / most)))
    pieces = rows.select("row", "doc_id", "n_tokens", cut.alias("piece"))
    size = F.least(F.lit(most).cast("long"), F.col("n_tokens") - F.col("piece") * most)
    pieces = pieces.select("row", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("piece_start"), size.cast("int").alias("n_tokens"))
    total = rows.agg(F.sum(F.floor((F.col("n_tokens") - 1) / most) + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True])
        bins, starts, final = pack(pdf["n_tokens"].to_numpy(), lengths)
        shard = int(pdf["shard"].iloc[0])
        return pdf.drop(columns=["shard", "row"]).assign(bin_id=(shard << 32) + bins, capacity=final[bins].astype("int32"), bin_start=starts.astype("int32"))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(token_lengths(table(spark, sf_dir, "documents")))
