"""Operator 1: packing token sequences by first-fit decreasing in randomised groups.

Each document is tokenised where it lies and cut into pieces of `length` ids and a rest. Only the description of a piece
(a few numbers) is shuffled: pieces are dealt at random to groups of about GROUP pieces, whatever their document or source,
and each group is packed alone, so no task grows with the input. (All pieces of a document but its rest are full and have a
sequence of their own, so what is packed in a group is one rest for each of its documents.) In a group, pieces go from long to short to the first
sequence with room; a tournament tree over the capacities finds it in logarithmic time.

Defined results: null texts are empty (the end id alone); repeated rows are packed as often as they occur; a null doc_id
stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import read, tidy, written

#: Pieces that are packed together.
GROUP = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


class Tournament:
    """A tree whose inner nodes hold the most room of the bins below; finds the first bin with enough."""

    def __init__(self, bins: int, capacity: int):
        self.base = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        room, k = self.room, 1
        while k < self.base:
            k *= 2
            if room[k] < size:
                k += 1
        at, left = k - self.base, room[k] - size
        room[k] = left
        while k > 1:
            other, k = room[k ^ 1], k >> 1
            left = left if left > other else other
            if room[k] == left:
                break
            room[k] = left
        return at


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its offset in the bin. Ties keep their order."""
    tree, used = Tournament(len(lengths), capacity), {}
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        b = tree.place(size)
        bins[k], offsets[k] = b, used.get(b, 0)
        used[b] = offsets[k] + size
    return bins, offsets


def cut(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """The pieces of each document: at most `length` ids each, all of them in one piece each."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            names = batch.column(0)
            for at, ids, counts in bpe.encode(batch.column(1)):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                first = np.cumsum(counts) - counts
                n = -(-counts // length)
                row = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, counts[row] - start)
                raw, begin = memoryview(ids).cast("B"), (first[row] + start) * 4
                crc = [zlib.crc32(raw[b : b + 4 * s]) for b, s in zip(begin.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row + at)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(counts[row])], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(pieces), PIECES)


def pack(pieces: DataFrame, length: int, group: int = GROUP, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    groups = max(1, -(-pieces.count() // group))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        return table.drop(["_g"]).append_column("sequence_id", pa.array(key[0].as_py() * (1 << 24) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).cast("long"))
    return dealt.groupBy("_g").applyInArrow(one, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    return pack(written(cut(docs, path, length, end_id), "pieces"), length)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
