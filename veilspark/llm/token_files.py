"""Operator 6: token ids in files of independent zstandard frames with a trailing seek table.

File: frames of ids (little-endian, unsigned, 32 bits; whole documents, about FRAME_BYTES each, a longer document alone), a
frame with the index of documents, then a skippable frame: for each frame its compressed and full size and a checksum of
its content, 32 bits each, and a footer with the number of frames. A plain zstandard decoder reads the file too. A reader
takes the footer, the index, and only the frames that hold the documents it wants.

Documents are dealt by ranges of doc_id, a file for about FILE_BYTES of text, so each file is sorted and the files follow
each other. A task writes under a name
of its own; the written manifest says which files count, so a task that runs again does no harm.

Defined results: null texts are empty (the end id alone); null ids come first; repeated ids keep an order by text hash; an
empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import new_path, read, tidy, written

FRAME_BYTES = 1 << 17
#: Bytes of text (and DOC_BYTES for each document) in a file: what a writer keeps of its documents is bounded by this, not by the table.
FILE_BYTES, DOC_BYTES = 1 << 26, 64
#: Documents in a batch of those read back.
READ_ROWS = 1 << 13
_SKIP, _MAGIC = 0x184D2A5E, 0x8F92EAB1


def _check(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    def __init__(self, sink, level: int = 1):
        import zstandard

        self.sink, self.zip, self.table, self.held, self.size = sink, zstandard.ZstdCompressor(level=level), [], [], 0
        self.names: list = []
        self.counts: list[int] = []
        self.frames: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.counts.append(len(ids))
        self.frames.append(len(self.table))
        self.held.append(ids.astype("<u4", copy=False).tobytes())
        self.size += 4 * len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _frame(self, raw: bytes) -> None:
        packed = self.zip.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), _check(raw)))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        known = np.array([x is not None for x in self.names], "<u1")
        parts = (np.array([x or 0 for x in self.names], "<i8"), known, np.array(self.counts, "<i8"), np.array(self.frames, "<i8"))
        self._frame(struct.pack("<Q", len(self.names)) + b"".join(x.tobytes() for x in parts))
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, _MAGIC)
        self.sink.write(struct.pack("<II", _SKIP, len(body)) + body)


class Reader:
    """source: a seekable file. Frames are read and checked when a document in them is asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        source.seek(end := source.tell() - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _MAGIC:
            raise ValueError("no seek table")
        source.seek(end - 12 * n)
        self.table = list(struct.iter_unpack("<III", source.read(12 * n)))
        self.begin = np.concatenate([[0], np.cumsum([x[0] for x in self.table])])
        raw = self.frame(n - 1)
        (m,) = struct.unpack_from("<Q", raw)
        self.ids = np.frombuffer(raw, "<i8", m, 8)
        self.known = np.frombuffer(raw, "<u1", m, 8 + 8 * m).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", m, 8 + 9 * m)
        self.frames = np.frombuffer(raw, "<i8", m, 8 + 17 * m)

    def frame(self, k: int) -> bytes:
        packed, full, check = self.table[k]
        self.source.seek(int(self.begin[k]))
        raw = self.zip.decompress(self.source.read(packed), max_output_size=full)
        if len(raw) != full or _check(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def tokens(self, row: int) -> np.ndarray:
        """Ids of one document, by its place in the file."""
        k = self.frames[row]
        first = int(np.searchsorted(self.frames, k))
        return np.frombuffer(self.frame(k), "<u4", int(self.counts[row]), 4 * int(self.counts[first:row].sum()))

    def find(self, doc_id: int) -> np.ndarray:
        return np.flatnonzero(self.known & (self.ids == doc_id))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        row = 0
        for k in range(len(self.table) - 1):
            raw, at = np.frombuffer(self.frame(k), "<u4"), 0
            while row < len(self.ids) and self.frames[row] == k:
                n = int(self.counts[row])
                yield int(self.ids[row]) if self.known[row] else None, raw[at : at + n]
                at, row = at + n, row + 1


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Writes the files; the manifest: file, part (their order), docs, tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, out, name, tokens = tokenizer(path), None, f"{uuid.uuid4().hex}.ids.zst", 0
        store, base = _open(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, ids, counts in bpe.encode(batch.column(1)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    out = Writer(sink)
                end = np.cumsum(counts)
                for k, (b, e) in enumerate(zip((end - counts).tolist(), end.tolist())):
                    out.add(names[at + k], np.append(ids[b:e], end_id))
                tokens += int(end[-1]) + len(counts)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "part": TaskContext.get().partitionId(), "docs": len(out.names), "tokens": tokens}])

    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + DOC_BYTES)).first()[0]
    n = max(1, -(-(size or 0) // FILE_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(tidy(write), "file string, part long, docs long, tokens long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files, with its place in the whole sequence of ids."""
    # one row for each file: as many as tasks, whatever the number of documents
    placed = manifest.withColumn("base", F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    files = placed.select("file", F.coalesce("base", F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "file")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                store, name = _open(x["file"])
                with store.open_input_file(name) as source:
                    at, rows = x["base"], []
                    for doc_id, ids in Reader(source):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == READ_ROWS:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return files.mapInArrow(tidy(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return read_files(write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "ids"), 2))
