"""Operator 8: a quality classifier: gradient-boosted trees on histograms of document statistics.

statistics() describes each whole text by numbers of fixed length, in one vectorised pass. The trees are fitted on the
driver with numpy from at most FIT_ROWS labelled rows (chosen by a hash of the id, so the choice repeats), then laid out as
full trees in arrays that travel with the task; scoring walks all rows of a batch through all trees at once.

Defined results: null and empty texts have zero statistics and a score like any other; repeated rows are scored each; null
labels and labels without a document are left out; an id with several labels is a row of the training for each; without labels of both kinds the score is their mean, or 0.5 without
any; an empty table gives no rows. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import own_columns, read, tidy, written
from .quality_rules import STOP_WORDS

#: The most labelled rows used for fitting.
FIT_ROWS = 40_000
THRESHOLD = 0.7
NAMES = ("log_bytes", "log_words", "mean_word", "longest_word", "capitals", "digits", "symbols", "bars", "shouts", "stops_commas", "beyond_ascii", "lines_per_word", "duplicate_lines", "distinct_words", "same_as_before", "repeated_threes", "stop_words", "capital_words")


def _hashed(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = K.words(data, np.array([0, len(data)]))
    return np.sort(K.hashes(data, s, e, True))


_STOP = _hashed(sorted(set(STOP_WORDS)))


def _set(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


_BYTES = {"capitals": _set(range(65, 91)), "digits": _set(range(48, 58)), "symbols": _set("#*$%&<>{}[]\\/=@^~_+"), "bars": _set("|"), "shouts": _set("!?"), "stops_commas": _set(".,;:"), "beyond_ascii": _set(range(128, 256))}


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different values each row has."""
    key = np.sort((K.row_of(first).astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(first) - 1)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of float32 for each text."""
    parts = [np.zeros((0, len(NAMES)), np.float32)]
    for at, to, data, offsets in K.blocks(column):
        n_bytes = np.diff(offsets)
        s, e, first = K.words(data, offsets)
        n, h, size = np.diff(first), K.hashes(data, s, e, True), e - s
        row = K.row_of(first)
        w, b = np.maximum(n, 1), np.maximum(n_bytes, 1)
        per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        share = {k: per(v[data]) / b for k, v in _BYTES.items()}
        ls, le, lf = K.spans(data != 10, offsets)
        n_lines, lh = np.diff(lf), K.hashes(data, ls, le)
        three, tf = K.shingles(h, first, 3)
        before = np.zeros(len(h), bool)
        before[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        stop = _STOP[np.minimum(np.searchsorted(_STOP, h), len(_STOP) - 1)] == h
        longest = np.zeros(to - at)
        np.maximum.at(longest, row, size)
        capital = _BYTES["capitals"][data[s]] & _BYTES["capitals"][data[np.minimum(s + 1, e - 1)]]
        count = lambda mask: np.bincount(row[mask], minlength=to - at)
        columns = {
            "log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n), "mean_word": np.bincount(row, size, to - at) / w, "longest_word": np.log1p(longest), **share,
            "lines_per_word": n_lines / w, "duplicate_lines": 1 - _distinct(lh, lf) / np.maximum(n_lines, 1), "distinct_words": _distinct(h, first) / w, "same_as_before": count(before) / w,
            "repeated_threes": 1 - _distinct(three, tf) / np.maximum(np.diff(tf), 1), "stop_words": count(stop) / w, "capital_words": count(capital) / w,
        }
        parts.append(np.stack([columns[k] for k in NAMES], 1).astype(np.float32))
    return np.concatenate(parts)


class BoostedTrees:
    """Binary log-loss; every tree is full to `depth`, node k has the children 2k+1 (up to the threshold) and 2k+2."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, damp: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.damp = trees, depth, rate, bins, least, damp

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = float(y.mean()) if len(y) else 0.5
        self.prior = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        margin = np.full(len(y), self.prior)
        features, cuts, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, leaf, at = self._tree(binned, edges, p - y, p * (1 - p))
            features.append(feature), cuts.append(cut), leaves.append(leaf)
            margin += leaf[at]
        self.feature, self.cut, self.leaf = np.array(features, np.int32), np.array(cuts, np.float32), np.array(leaves)
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        inner, width = (1 << self.depth) - 1, self.bins
        feature, cut, at = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32), np.zeros(len(g), np.int64)
        for level in range(self.depth):
            nodes, base = 1 << level, (1 << level) - 1
            best = np.full(nodes, 1e-6)
            split = np.full(nodes, -1)
            for f in range(binned.shape[1]):
                key = at * width + binned[:, f]
                G, H, N = (np.bincount(key, v, nodes * width).reshape(nodes, width) for v in (g, h, None))
                gl, hl, nl = G.cumsum(1), H.cumsum(1), N.cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + self.damp) + (gt - gl) ** 2 / (ht - hl + self.damp) - gt**2 / (ht + self.damp)
                gain[(nl < self.least) | (nt - nl < self.least)] = -1
                gain[:, len(edges[f]) :] = -1
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best
                best[better] = gain[np.arange(nodes), top][better]
                split[better] = top[better]
                feature[base : base + nodes][better] = f
            for k in np.flatnonzero(split >= 0):
                cut[base + k] = edges[feature[base + k]][split[k]]
            limit = np.where(split >= 0, split, width)
            at = 2 * at + (binned[np.arange(len(at)), feature[base + at]] > limit[at])
        leaf = -np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + self.damp) * self.rate
        return feature, cut, leaf, at

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            margin += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-margin))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int = FIT_ROWS) -> BoostedTrees:
    """Trees from the labelled rows for which `train` (of doc_id) holds; of more than `most`, those with the smallest hashes.
    Which rows these are is decided from ids alone, and only their texts are described."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y"))
    ids = docs.select(F.col("doc_id").cast("long"))
    n = ids.where(train).join(known, "doc_id").count()
    few = F.lit(True) if n <= most else h < int((1 << 20) * most / n * 1.2) + 64  # a few more than `most`, then cut exactly
    chosen = written(known.where(few).join(ids.where(train & few).distinct(), "doc_id", "left_semi"), "chosen")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.join(F.broadcast(chosen) if chosen.count() <= 2 * most else chosen, "doc_id")  # texts stay where they are
    got = describe(rows, "y double").select(h.alias("_h"), "x", "y").orderBy("_h", "x", "y").limit(most).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, len(NAMES))
    return BoostedTrees().fit(x, got["y"].to_numpy())


def describe(docs: DataFrame, also: str) -> DataFrame:
    """doc_id, the column `also` (name and type), and x: the statistics, as the bytes of float32."""
    name = also.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", name, "x"])

    return docs.select("doc_id", "text", name).mapInArrow(tidy(run), f"doc_id long, {also}, x binary")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, label, ~held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects; fitted on all labelled rows up to FIT_ROWS. All columns stay as they are."""
    model = fit(docs, labels, "quality", F.lit(True))
    text = docs.columns.index("text")
    plain = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(own_columns(docs))))  # mapInArrow can't take names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(text))) >= threshold))

    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
