"""Operator 9: near duplicates by a MinHash LSH forest.

A document is its set of distinct 3-word shingles. Documents with equal sets are one node from the start. A node has TREES
signatures of DEPTH MinHash values; each signature is an order of all nodes, and nodes that stand close in an order share a
long prefix. All orders are sorted in one shuffle (ranges of order, signature and id, so a crowded region is split over
tasks). Within a region (nodes with a common prefix of at least LEAST values) the depth adapts: up to SMALL nodes are all
candidates of each other; a larger region gives each node its next neighbours and the region's hub (the node that agrees
best with the region's most frequent values) as candidates, and splits at the next depth. A sketch that travels along drops
candidates far below the threshold. What is left is confirmed on full sets. Candidates are confirmed in two steps, the best
of each node first, the rest only where both ends are still apart. Then every pair of different groups that share a crowded
region is looked at, block by block: on sketches in the region, and what passes there on full sets. A region that a border between
tasks may cut is taken as crowded. Links become components by repeated contraction; later links join components, not
documents.

Defined results: without words or text a document is alone; equal sets are one group; a null doc_id takes no part (its
component is null, it is kept); rows of one doc_id with different texts are one document with several sets, linked with
whatever one of them is linked with (n_shingles is the row's own); repeated rows get the same result each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import own_columns, read, tidy, written

TREES, DEPTH, LEAST, SMALL, NEXT = 16, 8, 3, 8, 2
SKETCH = 64
#: Shingles in a block of asking nodes, and of the nodes around them.
LONE_BLOCK, BLOCK = 1 << 16, 1 << 18
#: Rows in a block of a crowded region: asking rows, and rows that answer.
ASKING, ANSWERING = 1 << 10, 1 << 12
#: Ids of documents that are broadcast (8 bytes each, counted before); more are joined by a shuffle.
MOST_IDS = 1 << 20
#: Labels of nodes that are broadcast (28 bytes each at most, counted before).
MOST_LABELS = 1 << 17
#: The most keys that count as hot: those with at least 1 / MOST_HOT of the rows. Their rows meet a broadcast.
MOST_HOT = 1 << 14
_A = K.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_NODES = "doc_id long, n_shingles int, f1 long, f2 long, sig binary"


def least_agreement(percent: int) -> int:
    """Equal values of the sketch from which a pair is looked at: 4.7 standard deviations below what the similarity lets expect
    (41 of 64 at 85 %; a pair at the threshold has fewer once in about 10^6)."""
    p = percent / 100
    return int(SKETCH * p - 4.7 * np.sqrt(SKETCH * p * (1 - p)))


def _unique(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    own = np.sort(h[first[k] : first[k + 1]])
    keep = np.ones(len(own), bool)
    keep[1:] = own[1:] != own[:-1]
    return own[keep]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    for at, to, data, offsets in K.blocks(column):
        s, e, first = K.words(data, offsets)
        h, first = K.shingles(K.hashes(data, s, e, True), first, width)
        for k in range(to - at):
            yield _unique(h, first, k)


def signature(shingles: np.ndarray) -> bytes:
    """TREES * DEPTH MinHash values, the 16 low bits of each, big-endian, so that bytes sort as values."""
    low = np.full(TREES * DEPTH, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at : at + 512] * _A[:, None]).min(1), out=low)
    return (K.mix(low) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (null without words), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, sig, seen = [], [], [], [], {}
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                a, b = (int(np.bitwise_xor.reduce(s)), int(s.sum())) if len(s) else (0, 0)
                f1.append(np.uint64(a).astype(np.int64) if len(s) else None)
                f2.append(np.uint64(b).astype(np.int64) if len(s) else None)
                if (a, b) not in seen:
                    seen[a, b] = signature(s) if len(s) else b""
                sig.append(seen[a, b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _NODES)


def region_pairs(keys: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows in the order of their keys: i, j, equal values of their sketches; and which rows are in a crowded region."""
    m = len(keys)
    lcp = (keys[1:] == keys[:-1]).cumprod(1).sum(1) if m > 1 else np.zeros(0, int)
    left, right, crowded = [], [], np.zeros(m, bool)
    inside = np.ones(m, bool)  # rows whose region at the depth above is too large to be done
    for depth in range(LEAST, DEPTH + 1):
        run = np.concatenate([[0], np.cumsum(lcp < depth)])
        size = np.bincount(run)
        small = inside & (size[run] <= SMALL) & (size[run] > 1)
        for off in range(1, SMALL):
            i = np.flatnonzero(small[: m - off] & (run[: m - off] == run[off:])) if m > off else np.zeros(0, int)
            left.append(i), right.append(i + off)
        large = inside & (size[run] > SMALL)
        for r in np.unique(run[large]):
            rows = np.flatnonzero(run == r) if r == 0 else np.arange(np.searchsorted(run, r), np.searchsorted(run, r, "right"))
            own = sketches[rows]
            most = np.array([np.bincount(own[:, c], minlength=256).argmax() for c in range(SKETCH)], np.uint8)
            hub = rows[(own == most).sum(1).argmax()]
            left.append(np.full(len(rows), hub)), right.append(rows)
        if depth == LEAST:
            crowded |= large
            for off in range(1, NEXT + 1):
                i = np.flatnonzero(large[: m - off] & (run[: m - off] == run[off:])) if m > off else np.zeros(0, int)
                left.append(i), right.append(i + off)
        inside &= large
        if not inside.any():
            break
    i, j = np.concatenate(left), np.concatenate(right)
    i, j = np.minimum(i, j), np.maximum(i, j)
    pair = np.unique(i.astype(np.int64) * m + j)
    i, j = pair // m, pair % m
    ok = (i != j) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
    i, j = i[ok], j[ok]
    agree = np.concatenate([np.zeros(0, int), *((sketches[i[k : k + 65536]] == sketches[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536))])
    ok = agree >= least_agreement(percent)
    return i[ok], j[ok], agree[ok], crowded


def forest(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes: doc_id, n_shingles, sig. Candidate pairs a < b with agree; rows with b null name nodes of crowded regions."""
    table = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, len(batch), 1024)):
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), ">u2").reshape(-1, TREES * DEPTH)
                keys = np.ascontiguousarray(sig.reshape(-1, TREES, DEPTH).transpose(1, 0, 2)).reshape(-1, DEPTH)
                sketch = np.tile(np.ascontiguousarray((sig[:, ::2] & 0xFF).astype(np.uint8)), (TREES, 1))
                fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.dtype.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), len(part))), fixed(keys), pa.concat_arrays([part.column(0)] * TREES), pa.concat_arrays([part.column(1)] * TREES), fixed(sketch)], schema=table)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, border = None, None

        def at_border(rows: pa.Table, of: tuple) -> np.ndarray:
            return np.array([(t, k[: 2 * LEAST]) == of for t, k in zip(rows["tree"].to_pylist(), rows["key"].to_pylist())], bool)

        def names(x, y, agree, alone) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.minimum(x, y), alone])), pa.array([*np.maximum(x, y).tolist(), *[None] * len(alone)], pa.int64()), pa.array(np.concatenate([agree, np.zeros(len(alone), int)]).astype(np.int32))], names=["a", "b", "agree"])

        none = np.zeros(0, np.int64)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not len(rows):
                continue
            held = rows.slice(max(0, len(rows) - SMALL)).combine_chunks()
            rows = rows.combine_chunks()
            border = border or (rows["tree"][0].as_py(), rows["key"][0].as_py()[: 2 * LEAST])
            head = rows.slice(0, 2 * SMALL)  # more are crowded anyway
            yield names(none, none, none, head["doc_id"].to_numpy()[at_border(head, border)])
            key = np.frombuffer(b"".join(rows["key"].to_pylist()), ">u2").reshape(-1, DEPTH)
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            ids, n, tree = rows["doc_id"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["tree"].to_numpy()
            cut = np.flatnonzero(np.diff(tree)) + 1
            for a, b in zip([0, *cut], [*cut, len(ids)]):
                i, j, agree, crowded = region_pairs(key[a:b], sketch[a:b], n[a:b], percent)
                yield names(ids[a:b][i], ids[a:b][j], agree, ids[a:b][crowded])
        if held is not None:
            last = held.slice(len(held) - 1)
            yield names(none, none, none, held["doc_id"].to_numpy()[at_border(held, (last["tree"][0].as_py(), last["key"][0].as_py()[: 2 * LEAST]))])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders = nodes.select("doc_id", "n_shingles", "sig").mapInArrow(tidy(grow), "tree int, key binary, doc_id long, n int, sketch binary")
    dealt = orders.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    return dealt.mapInArrow(tidy(pairs), "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The sorted shingles of the documents named by ids.doc_id, as bytes; several rows where their texts differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())], names=["doc_id", "set"])

    ids = written(ids.distinct(), "ids")
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi")
    return own.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h").mapInArrow(tidy(run), "doc_id long, set binary")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """pairs: nodes a, b in the groups x, y. The different (x, y) of which a pair has full sets that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.select("a", "b", "x", "y").join(full.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    return one.join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b").select("x", "y", "sa", "sb").mapInArrow(tidy(run), "x long, y long").distinct()


def _found(left: DataFrame, right: DataFrame, key: list[str], n: int, how: str = "left") -> DataFrame:
    """left with the columns of its row in right, which has each key once; both have at most n rows. Where one key may hold a
    large share of left, its rows meet a broadcast of at most MOST_HOT rows, and only the others are shuffled."""
    if n <= MOST_LABELS:
        return left.join(F.broadcast(right), key, how)
    hot = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2, n // MOST_HOT)).drop("_n").dropna()
    hot = written(right.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True)), "hot")
    marked = left.join(F.broadcast(hot), key, "left")
    of = [c for c in right.columns if c not in key]
    warm = marked.where("_hot").drop("_hot")
    cold = marked.where("_hot IS NULL").drop("_hot", *of)
    lost = cold.where(" OR ".join(f"{k} IS NULL" for k in key)).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in of))
    rest = cold.dropna(subset=key).join(right, key, how).unionByName(warm)
    return rest.unionByName(lost) if how == "left" else rest


def components(links: DataFrame) -> DataFrame:
    """links: x, y. doc_id, component (its smallest member) of every node with a link. In each round nodes take the smallest
    label around, then the label of that label, and links between equal labels vanish: what is left shrinks at least by half."""
    edges = written(links.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while n := edges.count():
        near = written(edges.union(edges.select("b", "a")).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "near")
        up = near.select(F.col("a").alias("l"), F.col("l").alias("up"))
        hop = written(_found(near, up, ["l"], 2 * n, "inner").select("a", F.col("up").alias("l")), "hop")
        if labels is None:
            labels = hop.select(F.col("a").alias("doc_id"), F.col("l").alias("component"))
        else:
            labels = moved(labels, hop.select(F.col("a").alias("doc_id"), F.col("l").alias("component")))
        low = _found(edges, hop, ["a"], 2 * n, "inner").select(F.col("l").alias("x"), "b")
        low = _found(low, hop.select(F.col("a").alias("b"), "l"), ["b"], 2 * n, "inner")
        edges = written(low.where("x <> l").select(F.least("x", "l").alias("a"), F.greatest("x", "l").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("x").alias("doc_id"), F.col("x").alias("component")).limit(0)


def moved(groups: DataFrame, up: DataFrame) -> DataFrame:
    """groups (doc_id, component) after links between components: up says where a component (as its doc_id) now belongs."""
    to = up.select(F.col("doc_id").alias("component"), F.col("component").alias("_to"))
    return written(_found(groups, to, ["component"], max(groups.count(), up.count())).select("doc_id", F.coalesce("_to", "component").alias("component")), "labels")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups after links (x, y) between components; nodes without a row in groups are components of their own."""
    links = written(links, "joined")
    if links.isEmpty():
        return groups
    up = components(links)
    return moved(groups, up).unionByName(up.join(groups, "doc_id", "left_anti"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one group yet, and these groups: x, y."""
    for end, group in (("a", "x"), ("b", "y")):
        pairs = pairs.join(groups.select(F.col("doc_id").alias(end), F.col("component").alias(group)), end, "left").withColumn(group, F.coalesce(group, end))
    return pairs.where("x <> y")


def _several_texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links x, y between the nodes that hold the texts of one doc_id."""
    f = F.struct("f1", "f2", "n_shingles")
    odd = own.groupBy("doc_id").agg(F.min(f).alias("lo"), F.max(f).alias("hi")).where("lo <> hi").select("doc_id")
    of = own.join(odd, "doc_id", "left_semi").select("f1", "f2", "n_shingles", F.col("doc_id").alias("x")).distinct()
    return of.join(nodes, ["f1", "f2", "n_shingles"]).select("x", F.col("doc_id").alias("y")).where("x <> y")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = written(describe(docs, width), "signatures")
    own = rows.where("doc_id IS NOT NULL AND f1 IS NOT NULL")
    nodes = own.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select("f1", "f2", "n_shingles", "m.doc_id", "m.sig")
    nodes = written(nodes, "nodes")
    found = written(forest(nodes, percent), "candidates")
    pairs = found.where("b IS NOT NULL AND a <> b")
    full = written(sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width), "sets")
    best = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "agree", "a", "b").groupBy("doc_id").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    groups = components(confirmed(best.withColumns({"x": F.col("a"), "y": F.col("b")}), full, percent).unionByName(_several_texts(own, nodes)))
    groups = joined(groups, confirmed(_apart(pairs, groups), full, percent))
    groups = joined(groups, the_rest(docs, nodes, found, groups, width, percent))
    of_node = nodes.join(groups, "doc_id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    placed = _found(rows.select("doc_id", "n_shingles", "f1", "f2"), written(of_node, "components"), ["f1", "f2", "n_shingles"], rows.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def crowded_regions(rows: DataFrame) -> DataFrame:
    """rows: doc_id, n_shingles, c, sig. One row for each tree: r (tree and the LEAST first values), doc_id, c, n, sketch."""
    bits = np.arange(LEAST - 1, -1, -1, dtype=np.int64) * 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, len(batch), 1024)):
                sig = np.frombuffer(b"".join(part.column(3).to_pylist()), ">u2").reshape(-1, TREES * DEPTH)
                first = sig.reshape(-1, TREES, DEPTH)[:, :, :LEAST].astype(np.int64)
                r = (first << bits).sum(2) + (np.arange(TREES, dtype=np.int64) << (16 * LEAST))
                sketch = pa.array([x.tobytes() for x in (sig[:, ::2] & 0xFF).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r.T.reshape(-1)), *(pa.concat_arrays([x] * TREES) for x in (part.column(0), part.column(2), part.column(1), sketch))], names=["r", "doc_id", "c", "n", "sketch"])

    return rows.select("doc_id", "n_shingles", "c", "sig").mapInArrow(tidy(run), "r long, doc_id long, c long, n int, sketch binary")


def equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bytes of each row of x with each row of y, both of 8-byte words."""
    low, high = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    out = np.full((len(x), len(y)), 8 * x.shape[1], np.int16)
    for k in range(x.shape[1]):
        z = x[:, k, None] ^ y[None, :, k]
        out -= np.bitwise_count((((z & low) + low) | z) & high)
    return out


def near_groups(ids: np.ndarray, group: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, asks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that may be linked with one of another group (asking rows with all others), their groups, and a group that
    connects these: equal where a chain of such pairs leads from one to the other."""
    names, at = np.unique(group, return_inverse=True)
    label, flagged, least = np.arange(len(names)), np.zeros(len(ids), bool), least_agreement(percent)
    asking, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    words = sketches.view(np.uint64)
    for part in (asking[k : k + 64] for k in range(0, len(asking), 64)):
        ok = (equal_bytes(words[part], words[others]) >= least) & (at[part][:, None] != at[others])
        ok &= 100 * np.minimum(sizes[part][:, None], sizes[others]) >= percent * np.maximum(sizes[part][:, None], sizes[others])
        for k in np.flatnonzero(ok.any(1)):
            near = others[ok[k]]
            flagged[near] = flagged[part[k]] = True
            own = np.unique(np.append(label[at[near]], label[at[part[k]]]))
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    rows = np.flatnonzero(flagged)
    return ids[rows], group[rows], names[label[at[rows]]]


def doubtful(nodes: DataFrame, found: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """doc_id, c, l: nodes of crowded regions that by their sketches may be linked with a node of another group c there, and
    another such group l. Every pair of different groups of a region is looked at: all rows but those of its largest group ask,
    all rows answer, in blocks of bounded size."""
    crowded = found.where("b IS NULL").select(F.col("a").alias("doc_id"))
    rows = nodes.join(crowded, "doc_id", "left_semi").join(groups, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    rows = written(crowded_regions(rows), "regions")
    parts = rows.groupBy("r", "c").agg(F.count(F.lit(1)).alias("v")).groupBy("r").agg(F.sum("v").alias("all"), F.max(F.struct("v", "c")).alias("top"))
    parts = parts.where(F.col("all") > F.col("top.v"))
    parts = parts.select("r", F.col("top.c").alias("top"), F.ceil((F.col("all") - F.col("top.v")) / ASKING).alias("nl"), F.ceil(F.col("all") / ANSWERING).alias("nm"))
    own = F.xxhash64("doc_id")
    all_of = rows.join(parts, "r")
    asking = all_of.where("c <> top").withColumns({"asks": F.lit(True), "x": F.pmod(own, F.col("nl")), "y": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1))})
    member = all_of.withColumns({"asks": F.lit(False), "y": F.pmod(own, F.col("nm")), "x": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1))})
    blocks = asking.unionByName(member).select("r", "x", "y", "doc_id", "c", "n", "asks", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not len(held):
                continue
            r, x, y = (held[name].to_numpy() for name in ("r", "x", "y"))
            cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            ends = [*cut, len(held)] if batch is None else cut.tolist()
            if not len(ends):
                continue
            ids, group, n, asks = held["doc_id"].to_numpy(), held["c"].to_numpy(), held["n"].to_numpy().astype(np.int64), held["asks"].to_numpy()
            sketch = np.frombuffer(b"".join(held["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            for a, b in zip([0, *ends], ends):
                got = near_groups(ids[a:b], group[a:b], n[a:b], sketch[a:b], asks[a:b], percent)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], names=["doc_id", "c", "l"])
            held = held.slice(ends[-1]).combine_chunks()

    dealt = blocks.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r", "x", "y").sortWithinPartitions("r", "x", "y")
    return dealt.mapInArrow(tidy(run), "doc_id long, c long, l long").distinct()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def the_rest(docs: DataFrame, nodes: DataFrame, found: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links x, y between groups that share a crowded region. There the next neighbours and the hubs may not be the ones a node is
    linked with, so all doubtful nodes are held against those of other groups that such pairs connect them to: all but the
    largest group ask. Both sides are cut into blocks of bounded size, and only links leave a task."""
    near = written(doubtful(nodes, found, groups, percent), "doubtful")
    around = components(near.select(F.col("c").alias("x"), F.col("l").alias("y"))).select(F.col("doc_id").alias("c"), F.col("component").alias("k"))
    placed = near.select("doc_id", "c").distinct().join(around, "c").join(nodes.select("doc_id", "n_shingles"), "doc_id")
    placed = written(placed.select("k", "doc_id", "c", "n_shingles"), "crowded")
    full = written(sets(docs, placed.select("doc_id"), width), "sets")
    parts = placed.groupBy("k", "c").agg(F.sum("n_shingles").alias("v")).groupBy("k").agg(F.sum("v").alias("all"), F.max(F.struct("v", "c")).alias("top")).where(F.col("all") > F.col("top.v"))
    parts = parts.select("k", F.col("top.c").alias("top"), F.ceil((F.col("all") - F.col("top.v")) / LONE_BLOCK).alias("nl"), F.ceil(F.col("all") / BLOCK).alias("nm"))
    own = F.xxhash64("doc_id")
    all_of = placed.join(parts, "k").withColumn("lone", F.col("c") != F.col("top"))
    lone = all_of.where("lone").withColumns({"x": F.pmod(own, F.col("nl")), "y": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1))})
    member = all_of.withColumns({"y": F.pmod(own, F.col("nm")), "x": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1))}).withColumn("lone", F.lit(False))
    rows = lone.unionByName(member).join(full, "doc_id").select("k", "x", "y", "c", "lone", "set")

    def block(table: pa.Table) -> pa.Table:
        group, is_lone = table["c"].to_numpy(), table["lone"].to_numpy()
        each = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["set"]]
        others = np.flatnonzero(~is_lone)
        size = np.array([len(each[k]) for k in others], np.int64)
        values, owner = np.concatenate([np.zeros(0, np.uint64), *(each[k] for k in others)]), np.repeat(np.arange(len(others)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(is_lone):
            lo, hi = np.searchsorted(values, each[k]), np.searchsorted(values, each[k], "right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(others))
            near = np.flatnonzero((100 * both >= percent * (len(each[k]) + size - both)) & (group[others] != group[k]))
            _, one = np.unique(group[others[near]], return_index=True)  # one link to each group does
            a += [int(group[k])] * len(one)
            b += group[others[near[one]]].tolist()
        return pa.table({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64())}).group_by(["x", "y"]).aggregate([])

    return rows.groupBy("k", "x", "y").applyInArrow(block, "x long, y long").distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a near duplicate of a smaller doc_id in their component: of each component all rows of the
    smallest doc_id stay, so rows that repeat it stay with it. Rows without a doc_id, text or words stay."""
    gone = written(near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*own_columns(docs))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
