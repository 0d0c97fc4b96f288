"""Operator 3: scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Words (lower-cased A-Z) are counted over all training documents. The most frequent, OWN at most and each seen LEAST times,
are tokens of their own. All others are the token of their ending: the last three bytes, if these are among the most
frequent endings of such words, else RARE. Tokens are in classes of SIZE: the end and the endings, then words by falling
count. The model predicts a token from the two before it: each has a vector, a matrix for each position turns and adds
them, the products with the vectors of classes (plus a bias) give the class, those with the vectors of the class's tokens
the token. Scores are normalised: batched matrix products over the distinct contexts of a block, and a softmax at both
levels. The token of an ending shares its probability out by add-half frequency, with one place for unknown words.

Both levels are trained by noise-contrastive estimation on the counts of all triples of tokens in the training documents.
The triples are counted and stay on the cluster, whatever their number. Trainers (one for each PART triples, TRAINERS at
most) go through them: first one trainer over its part, then, from its model, all others over theirs, and the models of
these are averaged. Every triple counts with its whole count, and only models (about a megabyte each) reach the driver. A
table of fewer triples than STEPS batches is passed as often as that takes, PASSES times at most.

The TOP most frequent words travel with the tasks. Rarer words of a document are joined with the table of counts by hash.

Defined results: null and empty texts are one end token; a null doc_id is training; rows that repeat count and are scored
each; without training documents all words are RARE; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import bound_batches, read, tidy, written

BITS, SIZE, WIDTH = 12, 64, 32
#: Tokens: the end of a text (which also stands before its first word), other endings, endings; from SIZE on words.
END, RARE, OWN = 0, 1, (1 << BITS) - SIZE
LEAST = 3
#: Words whose counts travel with the tasks, 16 bytes each.
TOP = 1 << 19
END_HASH = np.uint64(0x5EED0FE17DE17D)
BATCH, CLASS_NOISE, WORD_NOISE = 4096, 32, 6
#: Triples of a trainer, the most trainers, the batches of a training (of a small table) and the most passes that make them, triples that are shuffled together.
PART, TRAINERS, STEPS, PASSES, HELD = 1 << 22, 32, 1000, 6, 1 << 20


class LogBilinear:
    """Tokens 0 to len(counts) - 1 with their counts, in classes of SIZE; of the first class only `first` are in use. p: the
    parameters, by name."""

    def __init__(self, counts: np.ndarray, first: int = SIZE, width: int = WIDTH, seed: int = 3):
        rng, n = np.random.default_rng(seed), -(-len(counts) // SIZE)
        share = np.zeros(n * SIZE)
        share[: len(counts)] = counts + 0.5
        share[first:SIZE] = 0
        share /= share.sum()
        self.of_class = share.reshape(n, SIZE).sum(1)
        self.inside = share / np.repeat(self.of_class, SIZE)
        with np.errstate(divide="ignore"):  # places without a token: never drawn, probability 0
            self.p = {"r": rng.normal(0, 0.1, (n * SIZE, width)), "q": rng.normal(0, 0.1, (n * SIZE, width)), "k": rng.normal(0, 0.1, (n, width)), "c1": np.eye(width) * 0.5, "c2": np.eye(width), "b": np.log(self.inside), "bk": np.log(self.of_class)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]], mean: float, steps: int, rate: float = 0.02, passes: int = 1, seed: int = 5) -> int:
        """chunks: triples (a row: before last, last, target) and counts, `mean` on average over the whole table; about `steps`
        batches in all. Returns the number of triples. In a pass the weights of a triple sum up to its count / mean; one of
        more than four times the mean is dealt over several places."""
        rng, p, done, seen = np.random.default_rng(seed), self.p, 0, 0
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        noise = self._noise()
        for triples, counts in chunks:
            seen += len(triples)
            times = np.ceil(counts / (4 * mean)).astype(np.int64)
            order, weight = np.repeat(np.arange(len(counts)), times), (counts / times / mean).astype(np.float32)
            for _ in range(passes):
                rng.shuffle(order)
                for part in np.array_split(order, max(1, -(-len(order) // BATCH))):
                    if not len(part):
                        continue
                    done += 1
                    g = self._gradient(triples[part], weight[part] / len(part), noise, rng)
                    now = rate * max(0.0, 1 - done / (steps + 1)) + 1e-4
                    for k in p:
                        m1[k] += 0.1 * (g[k] - m1[k])
                        m2[k] += 0.01 * (g[k] ** 2 - m2[k])
                        p[k] -= (now * (m1[k] / (1 - 0.9**done)) / (np.sqrt(m2[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
        return seen

    def _noise(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cumulated shares of classes, of tokens, and the logarithms of the expected noise of both."""
        with np.errstate(divide="ignore"):
            return np.cumsum(self.of_class), np.cumsum(self.inside), np.log(CLASS_NOISE * self.of_class).astype(np.float32), np.log(WORD_NOISE * self.inside).astype(np.float32)

    def _gradient(self, x: np.ndarray, weight: np.ndarray, noise: tuple, rng: np.random.Generator) -> dict[str, np.ndarray]:
        p, (class_sum, word_sum, class_log, word_log) = self.p, noise
        a, b, w = x[:, 0], x[:, 1], x[:, 2]
        c = w // SIZE
        ra, rb = p["r"][a], p["r"][b]
        h = ra @ p["c1"] + rb @ p["c2"]
        # the class, against classes drawn for the whole batch
        drawn = np.minimum(np.searchsorted(class_sum, rng.random(CLASS_NOISE)), len(class_sum) - 1)
        true = (h * p["k"][c]).sum(1) + p["bk"][c] - class_log[c]
        false = h @ p["k"][drawn].T + p["bk"][drawn] - class_log[drawn]
        dt, df = (_sigmoid(true) - 1) * weight, _sigmoid(false) * weight[:, None]
        dh = dt[:, None] * p["k"][c] + df @ p["k"][drawn]
        g = {"k": self._sum("k", c, dt[:, None] * h) + self._sum("k", drawn, df.T @ h), "bk": (np.bincount(c, dt, len(p["bk"])) + np.bincount(drawn, df.sum(0), len(p["bk"]))).astype(np.float32)}
        # the token, against tokens of its class: each class fills one unit of the cumulated shares
        fake = np.searchsorted(word_sum, c[:, None] + rng.random((len(w), WORD_NOISE)) * (1 - 1e-9))
        fake = np.clip(fake, c[:, None] * SIZE, c[:, None] * SIZE + SIZE - 1)
        empty = self.inside[fake] == 0  # rounding at the end of a class
        fake[empty] = np.broadcast_to(w[:, None], fake.shape)[empty]
        qf = p["q"][fake]
        true = (h * p["q"][w]).sum(1) + p["b"][w] - word_log[w]
        false = np.matmul(qf, h[:, :, None])[:, :, 0] + p["b"][fake] - word_log[fake]
        dt, df = (_sigmoid(true) - 1) * weight, _sigmoid(false) * weight[:, None]
        dh += dt[:, None] * p["q"][w] + np.matmul(df[:, None, :], qf)[:, 0]
        rows, n = np.concatenate([w, fake.reshape(-1)]), len(p["b"])
        each = np.concatenate([dt, df.reshape(-1)])
        g["q"] = self._sum("q", rows, np.concatenate([dt[:, None] * h, (df[:, :, None] * h[:, None, :]).reshape(-1, h.shape[1])]))
        g["b"] = np.bincount(rows, each, n).astype(np.float32)
        g["c1"], g["c2"] = ra.T @ dh, rb.T @ dh
        g["r"] = self._sum("r", np.concatenate([a, b]), np.concatenate([dh @ p["c1"].T, dh @ p["c2"].T]))
        return g

    def _sum(self, name: str, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.uint16)  # sorted by counting
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out = np.zeros_like(self.p[name])
        out[own[at]] = np.add.reduceat(values[order], at)
        return out

    def log10(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token w after the tokens a, b."""
        p = self.p
        context, at = np.unique(a.astype(np.int64) * len(p["r"]) + b, return_inverse=True)
        x, y = context // len(p["r"]), context % len(p["r"])
        h = p["r"][x] @ p["c1"] + p["r"][y] @ p["c2"]
        c = w // SIZE
        out = np.empty(len(w), np.float32)
        classes = np.empty((len(h), len(p["k"])), np.float32)
        for k in range(0, len(h), 8192):
            classes[k : k + 8192] = _log_softmax(h[k : k + 8192] @ p["k"].T + p["bk"])
        order = np.argsort(c.astype(np.uint16), kind="stable")
        ends = np.searchsorted(c[order], np.arange(len(p["k"]) + 1))
        for k in np.flatnonzero(np.diff(ends)):
            q, bias = p["q"][k * SIZE : (k + 1) * SIZE], p["b"][k * SIZE : (k + 1) * SIZE]
            for s in range(ends[k], ends[k + 1], 8192):
                own = order[s : min(s + 8192, ends[k + 1])]
                inside = _log_softmax(h[at[own]] @ q.T + bias)
                out[own] = classes[at[own], k] + inside[np.arange(len(own)), w[own] - k * SIZE]
        return out.astype(float) / math.log(10)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s -= s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


class Words:
    """The most frequent words, by hash; slot order is by falling count. The first `own` are tokens. endings: sorted."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: int, endings: np.ndarray):
        self.index = K.HashIndex(max(4, int(len(hashes)).bit_length() + 1))
        self.index.add(hashes)
        self.counts, self.own, self.endings = np.append(counts, 0), own, endings

    def tokens(self, slot: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.full(len(slot), RARE, np.int64)
        if len(self.endings):
            at = np.minimum(np.searchsorted(self.endings, ending), len(self.endings) - 1)
            out = np.where(self.endings[at] == ending, at + RARE + 1, RARE)
        return np.where((slot >= 0) & (slot < self.own), slot.astype(np.int64) + SIZE, out)


_held: dict[str, Words] = {}


def _words(key: str, sent) -> Words:
    """The sent words, built once in each Python worker."""
    if key not in _held:
        _held.clear()
        _held[key] = Words(*sent.value)
    return _held[key]


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of each word, and the first word of each row."""
    s, e, first = K.words(data, offsets)
    tail = np.zeros(len(s), np.int32)
    for k in (1, 2, 3):
        one = data[np.maximum(e - k, 0)].astype(np.int32)
        one += np.where((one >= 65) & (one <= 90), 32, 0)
        tail = tail * 256 + np.where(e - k >= s, one, 0)
    return K.hashes(data, s, e, True), tail, first


def _with_ends(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tokens with an end after each row, and where these stand."""
    at = first[1:]
    return np.insert(tokens, at, END), at + np.arange(len(at))


def _before(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens two and one before each, END beyond the start of a row."""
    one, two = np.zeros_like(tokens), np.zeros_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    starts = np.concatenate([[0], ends[:-1] + 1])
    two[starts[starts < len(two)]] = END
    two[starts[starts + 1 < len(two)] + 1] = END
    return two, one


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, e (the ending), c over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, endings, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
            for at, to, data, offsets in K.blocks(batch.column(0)):
                h, ending, _ = _hashed(data, offsets)
                own.append(h)
                endings.append(ending)
                rows += to - at
            h, one, c = np.unique(np.concatenate(own), return_index=True, return_counts=True)
            e = np.concatenate(endings)[one]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END_HASH).view(np.int64)), pa.array(np.append(e, np.int32(-1))), pa.array(np.append(c, rows))], names=["h", "e", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "h long, e int, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c")).where("c > 0")


@dataclass
class Learned:
    """What the training documents taught: all counts (a table), the words that travel, the model."""

    vocabulary: DataFrame
    key: str
    words: object  # a broadcast of hashes, counts, the number of own words, and endings
    ends: int
    total: int
    distinct: int
    mass: np.ndarray  # of the tokens before SIZE: counts of their words, and a half for each and for unknown ones
    model: LogBilinear


def count(training: DataFrame) -> Learned:
    vocab = written(word_counts(training), "vocabulary")
    end = int(np.array([END_HASH]).view(np.int64)[0])
    # counts by a bucket of their logarithm: the least count of which at most TOP words have as much
    level = F.floor(F.log2("c") * 8).cast("int")
    at, much, sizes = None, 0, vocab.where(F.col("h") != end).groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).toPandas()
    for x in sorted(sizes["l"], reverse=True):
        much += sizes.loc[sizes["l"] == x, "v"].sum()
        if much > TOP:
            break
        at = int(x)
    often = vocab.where((F.col("h") != end) & (level >= at)) if at is not None else vocab.limit(0)
    got = often.toArrow()
    order = np.lexsort((got["h"].to_numpy(), -got["c"].to_numpy()))
    top_h, top_c = got["h"].to_numpy()[order].view(np.uint64), got["c"].to_numpy()[order]
    own = int((top_c[:OWN] >= LEAST).sum())
    ends = int((vocab.where(F.col("h") == end).agg(F.sum("c")).first()[0]) or 0)
    words, distinct = int(sizes["n"].sum()), int(sizes["v"].sum())
    # endings of words that are no tokens: those of all words (the most frequent 4096), without the tokens'
    of = vocab.where(F.col("h") != end).groupBy("e").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("n"), "e").limit(4096).toPandas().set_index("e").astype("int64")
    mine = pd.DataFrame({"e": got["e"].to_numpy()[order][:own], "n": top_c[:own], "v": 1}).groupby("e").sum()
    of = of.sub(mine.reindex(of.index, fill_value=0)).query("n > 0").reset_index().sort_values(["n", "e"], ascending=[False, True])[: SIZE - RARE - 1].sort_values("e")
    n = np.concatenate([[words - top_c[:own].sum() - of["n"].sum()], of["n"]])
    v = np.concatenate([[distinct - own - of["v"].sum()], of["v"]])
    counts = np.zeros(SIZE + own)
    counts[END], counts[RARE : RARE + len(n)], counts[SIZE:] = ends, n, top_c[:own]
    sent = training.sparkSession.sparkContext.broadcast((top_h, top_c, own, of["e"].to_numpy().astype(np.int32)))
    mass = np.ones(SIZE)
    mass[RARE : RARE + len(n)] = n + 0.5 * v + 0.5
    return Learned(vocab, uuid.uuid4().hex, sent, ends, words + ends, distinct + (ends > 0), mass, LogBilinear(counts, RARE + len(n)))


def triples(training: DataFrame, learned: Learned) -> DataFrame:
    """t (three tokens of BITS bits), c over all texts."""
    key, sent = learned.key, learned.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(key, sent)
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0), 4 * K.BLOCK_BYTES):
                h, ending, first = _hashed(data, offsets)
                tokens, ends = _with_ends(known.tokens(known.index.find(h), ending), first)
                two, one = _before(tokens, ends)
                t, c = np.unique((((two << BITS) | one) << BITS) | tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], names=["t", "c"])

    return training.select(F.col("text").cast("string")).mapInArrow(tidy(run), "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))


def train(table: DataFrame, model: LogBilinear) -> LogBilinear:
    """Trains the model on a written table of triples; see the head of this file."""
    spark = table.sparkSession
    n, total = table.agg(F.count(F.lit(1)), F.sum("c")).first()
    if not n:
        return model
    trainers = max(1, min(TRAINERS, -(-n // PART)))
    mean, passes = total / n, max(1, min(PASSES, -(-STEPS * BATCH // n)))
    steps = -(-n // trainers) * passes // BATCH + 1
    # all of a small table is shuffled together, and a part is cut into chunks otherwise
    held = HELD if trainers > 1 else PART

    def run_on(sent, mine, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            k = TaskContext.get().partitionId()
            if not mine(k):
                return
            own = LogBilinear.__new__(LogBilinear)
            own.__dict__.update({name: value.copy() if isinstance(value, np.ndarray) else {x: y.copy() for x, y in value.items()} for name, value in sent.value.items()})
            seen = own.fit(_chunks(batches, held), mean, steps, rate, passes, 5 + k)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen] * len(own.p)), pa.array(list(own.p)), pa.array([x.tobytes() for x in own.p.values()], pa.binary())], names=["n", "name", "value"])

        return run

    def trained(start: LogBilinear, mine, rate: float) -> LogBilinear:
        sent = spark.sparkContext.broadcast(start.__dict__)
        rows = table.select("t", "c").coalesce(trainers).mapInArrow(tidy(run_on(sent, mine, rate)), "n long, name string, value binary").collect()  # TRAINERS models at most
        if rows:
            for name, old in start.p.items():
                mine_ = [(r.n, np.frombuffer(r.value, np.float32).reshape(old.shape)) for r in rows if r.name == name]
                with np.errstate(invalid="ignore"):
                    start.p[name] = (sum(w * v.astype(float) for w, v in mine_) / sum(w for w, _ in mine_)).astype(np.float32)
        sent.unpersist()
        return start

    model = trained(model, lambda k: k == 0, 0.02)
    return trained(model, lambda k: k > 0, 0.005) if trainers > 1 else model


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    mask, held, size = (1 << BITS) - 1, [], 0

    def chunk() -> tuple[np.ndarray, np.ndarray]:
        t, c = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        return np.stack([t >> (2 * BITS), (t >> BITS) & mask, t & mask], 1).astype(np.int32), c

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= most:
            yield chunk()
            held, size = [], 0
    if size:
        yield chunk()


def learn(training: DataFrame) -> Learned:
    """Counts, and the trained model, of all texts."""
    out = count(training)
    train(written(triples(training, out), "triples"), out.model)
    return out


def score_texts(docs: DataFrame, learned: Learned | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned: from the documents not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    got = learned or learn(rows.where("NOT held_out"))
    whole = got.total + 0.5 * (got.distinct + 1)
    key, sent, ends, model = got.key, got.words, got.ends, spark.sparkContext.broadcast(got.model)
    end_base, log_whole, log_mass = math.log10((ends + 0.5) / whole), math.log10(whole), np.log10(got.mass)
    kinds = "doc_id long, held_out boolean, row long, h long, m long, n_tokens long, n_known long, base double, score double"
    names = [x.split(" ")[0] for x in kinds.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row0 = _words(key, sent), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(2), 2 * K.BLOCK_BYTES):
                h, ending, first = _hashed(data, offsets)
                slot = known.index.find(h)
                plain = known.tokens(slot, ending)
                tokens, stops = _with_ends(plain, first)
                p = model.value.log10(*_before(tokens, stops), tokens)
                common = slot >= 0
                log_c = np.log10(known.counts[slot] + 0.5)  # -1 takes the last, 0
                # the join below adds the count of words that don't travel
                inner = np.where(plain >= SIZE, 0.0, np.where(common, log_c, 0.0) - log_mass[np.minimum(plain, SIZE - 1)])
                base = np.where(common, log_c - log_whole, 0.0)
                total_of = lambda v, f: np.diff(np.concatenate([[0.0], np.cumsum(v)])[f])
                n, at = b - a, first
                sums = [np.diff(first) + 1, total_of(common, at).astype(np.int64) + (ends > 0), total_of(base, at) + end_base, total_of(inner, at) + total_of(p, np.concatenate([[0], stops + 1]))]
                ids = np.arange(row0, row0 + n)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(ids), none, none, *map(pa.array, sums)], names=names)
                rare = np.flatnonzero(~common)
                doc = K.row_of(first)[rare]
                order = np.lexsort((h[rare], doc))
                rare, doc = h[rare][order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])])) if len(rare) else np.zeros(0, int)
                m, k = np.diff(np.append(new, len(rare))), len(new)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(ids[doc[new]]), pa.array(rare[new].view(np.int64)), pa.array(m), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)
                row0 += n

    parts = written(rows.mapInArrow(tidy(score), kinds), "parts")
    counted = parts.where("h IS NOT NULL").select("row", "h", "m").join(got.vocabulary, "h", "left")
    each = F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rarer = counted.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("_n"), F.sum(each - F.col("m") * log_whole).alias("_b"), F.sum(each).alias("_s"))
    out = parts.where("h IS NULL").join(rarer, "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("_n")).alias("n_known"), F.lit(got.total).cast("long").alias("train_tokens"), (F.col("base") + zero("_b")).alias("base_score"), (F.col("score") + zero("_s")).alias("score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
