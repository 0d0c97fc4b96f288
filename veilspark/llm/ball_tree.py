"""Operator 10: exact top-k inner products by ball trees.

Vectors are dealt to shards of at most SHARD rows as they are read, each with a ball tree (centre and radius of every
node), and written to the shared folder, a file for each shard; centres and radii of the roots form one small table beside
them. Queries form blocks. One task takes a block through the shards, best upper bound first, and keeps each query's kth
score: a shard or node whose bound q.c + |q|r is below it is skipped, and a shard below it for the whole block is not
opened. Memory is one shard, one block and the block's bounds, whatever the dimension of the vectors.

Bounds are doubles with a margin above their rounding; scores are exact integers: doubles where all sums stay below 2^53,
64-bit integers below 2^63, Python's integers beyond.

Defined results: vectors that are null, empty, or hold a null or a component that isn't finite (also once multiplied by
SCALE) take no part, nor do rows without an id; only vectors of the query's dimension are candidates; rows that repeat a
vector are candidates each; rows with the query's own id count as its own; a score beyond 64 bits is ranked by its exact
value and returned as the nearest long; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, tidy

SHARD, LEAF, BLOCK = 16_384, 96, 64
SCALE = 256.0
_SHARD = "dim int, center binary, radius double, ids binary, points binary, centers binary, radii binary, nodes binary"
_LONG = 2**63


def quantised(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their vectors, floor(SCALE * x), by row."""
    rows, out = [], []
    for k, v in enumerate(column):
        if v.is_valid and len(v.values) and not v.values.null_count:
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                rows.append(k)
                out.append(x)
    return np.array(rows, np.int64), out


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, centres, radii, and nodes (start, end, left child or -1; the right child follows it)."""
    order, centers, radii, nodes = np.arange(len(points)), [], [], []

    def node(start: int, end: int) -> None:
        own = points[order[start:end]]
        center = own.mean(0)
        centers.append(center)
        radii.append(np.sqrt(((own - center) ** 2).sum(1).max()))
        nodes.append([start, end, -1])

    node(0, len(points))
    k = 0
    while k < len(nodes):
        start, end, _ = nodes[k]
        if end - start > LEAF:
            own = points[order[start:end]]
            a = own[((own - centers[k]) ** 2).sum(1).argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            side, half = own @ (b - a), (end - start) // 2
            cut = np.argpartition(side, half)
            order[start:end] = order[start:end][cut]
            nodes[k][2] = len(nodes)
            node(start, start + half)
            node(start + half, end)
        k += 1
    return order, np.array(centers), np.array(radii), np.array(nodes, np.int64)


def shards(vectors: DataFrame) -> tuple[str, str]:
    """Writes all vectors (vec_id, embedding) as shards, and the table of their roots; returns both folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, points = held.pop(dim)
            x = np.array(points)
            with np.errstate(over="ignore", invalid="ignore"):
                order, centers, radii, nodes = build(x)
            row = {"dim": dim, "center": centers[0].tobytes(), "radius": float(radii[0]), "ids": np.array(ids, np.int64)[order].tobytes(), "points": x[order].tobytes(), "centers": centers.tobytes(), "radii": radii.tobytes(), "nodes": nodes.tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("center", pa.binary()), ("radius", pa.float64()), *((c, pa.binary()) for c in list(row)[3:])]))

        for batch in batches:
            rows, points = quantised(batch.column(1))
            for name, x in zip(batch.column(0).take(pa.array(rows)).to_pylist(), points):
                to = held.setdefault(len(x), ([], []))
                to[0].append(name)
                to[1].append(x)
                if len(to[0]) >= SHARD:
                    yield emit(len(x))
        for dim in list(held):
            yield emit(dim)

    path = new_path(vectors.sparkSession, "shards")
    vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(tidy(run), _SHARD).write.option("maxRecordsPerFile", 1).parquet(path)
    roots = new_path(vectors.sparkSession, "roots")
    own = vectors.sparkSession.read.schema(_SHARD).parquet(path).select(F.col("_metadata.file_name").alias("file"), "dim", "center", "radius")
    own.coalesce(1).write.parquet(roots)  # one row for each SHARD vectors
    return path, roots


class Best:
    """The k highest scores of one query, ties to the smaller id. Scores are integers, of numpy or Python's own."""

    def __init__(self, k: int):
        self.k, self.found, self.floor = k, [], -math.inf

    def offer(self, ids: np.ndarray, scores: np.ndarray, own: int) -> None:
        keep = ids != own
        if scores.dtype == object or self.floor >= _LONG:
            keep &= np.array([s >= self.floor for s in scores.tolist()], bool)
        elif self.floor > -_LONG:
            keep &= scores >= self.floor
        keep = np.flatnonzero(keep)
        if len(keep):
            self.found = sorted(self.found + list(zip((-scores[keep]).tolist(), ids[keep].tolist())))[: self.k]
            if len(self.found) == self.k:
                self.floor = -self.found[-1][0]


def inner_products(points: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integers held as doubles; `most` bounds every partial sum."""
    if most < 2**53:
        return (points @ query).astype(np.int64)
    if most < 2**62:  # a margin of two for the rounding of the bound itself
        return points.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query]
    return np.array([sum(int(x) * y for x, y in zip(p, q)) for p in points], object)


def search(shard: dict, queries: np.ndarray, names: list[int], best: list[Best], rows: np.ndarray) -> None:
    """Takes the queries `rows` through one shard, each node by its bound."""
    dim = queries.shape[1]
    ids, points, centers, radii, nodes = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["points"]).reshape(-1, dim), np.frombuffer(shard["centers"]).reshape(-1, dim), np.frombuffer(shard["radii"]), np.frombuffer(shard["nodes"], np.int64).reshape(-1, 3)
    top = np.abs(points).max(1)
    most = float(top.max())
    bound = _bounds(queries[rows], centers, radii).tolist()  # Python compares its floats with any integer
    for i, q in enumerate(rows):
        mine, heap, size = best[q], [(-bound[i][0], 0)], float(np.abs(queries[q]).max()) * dim
        while heap:
            above, k = heapq.heappop(heap)
            if -above < mine.floor:
                break
            start, end, left = nodes[k]
            if left < 0:
                largest = most if most * size < 2**53 else float(top[start:end].max())  # one huge vector doesn't slow down all nodes
                mine.offer(ids[start:end], inner_products(points[start:end], queries[q], largest * size), names[q])
            else:
                for child in (left, left + 1):
                    if bound[i][child] >= mine.floor:
                        heapq.heappush(heap, (-bound[i][child], child))


def _bounds(queries: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No inner product of a query with a point of the ball is larger. Where doubles overflow, the bound is infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((queries**2).sum(1))[:, None]
        margin = 1e-9 * size * (np.sqrt((centers**2).sum(1)) + radii) + 1e-6
        return np.nan_to_num(queries @ centers.T + size * radii + margin, nan=np.inf, posinf=np.inf, neginf=np.inf)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """queries, vectors: vec_id, embedding. query_id, rank, vec_id, score."""
    folder, roots = shards(vectors)
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        root_store, root_base = fs.FileSystem.from_uri(roots)
        root_files = [f.path for f in root_store.get_file_info(fs.FileSelector(root_base)) if f.path.endswith(".parquet")]

        def bounds(q: np.ndarray) -> tuple[list[str], np.ndarray]:
            """The shards of q's dimension and each query's bound for them; the roots are read in small batches."""
            files, out = [], [np.zeros((len(q), 0))]
            for f in root_files:
                for part in pq.ParquetFile(root_store.open_input_file(f)).iter_batches(1024):
                    part = part.filter(pc.equal(part.column("dim"), q.shape[1]))
                    if len(part):
                        files += part.column("file").to_pylist()
                        center = np.frombuffer(b"".join(part.column("center").to_pylist())).reshape(-1, q.shape[1])
                        out.append(_bounds(q, center, part.column("radius").to_numpy()))
            return files, np.concatenate(out, 1)

        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                rows, points = quantised(batch.column(1))
                names = batch.column(0).take(pa.array(rows)).to_pylist()
                for dim in {len(x) for x in points}:
                    mine = [j for j, x in enumerate(points) if len(x) == dim]
                    q, own, best = np.array([points[j] for j in mine]), [names[j] for j in mine], [Best(k) for _ in mine]
                    files, bound = bounds(q)
                    for j in np.argsort(-bound.max(0), kind="stable") if files else ():
                        open_for = np.array([i for i, b in enumerate(best) if float(bound[i, j]) >= b.floor], np.int64)
                        if len(open_for):
                            search(pq.read_table(store.open_input_file(f"{base}/{files[j]}")).to_pylist()[0], q, own, best, open_for)
                    out = [(name, r + 1, i, max(-_LONG, min(_LONG - 1, -s))) for name, b in zip(own, best) for r, (s, i) in enumerate(b.found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    dealt = queries.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding")
    n = max(1, -(-dealt.count() // BLOCK))
    return dealt.repartition(n, F.xxhash64("vec_id")).mapInArrow(tidy(run), "query_id long, rank int, vec_id long, score long")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
