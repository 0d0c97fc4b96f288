"""Operator 2: mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source takes each document a whole number of times, and once more those whose hash is
below the source's threshold. Thresholds come from histograms: sizes summed by source and hash bucket (combined before the
shuffle, so a hot source costs no more), then only the bucket on the boundary is split by the next bits of the hash, LEVELS
times. Nothing is sorted but the few rows of a histogram.

Defined results: null texts have size 0; a null source is one source, the last; rows that repeat doc_id and text share a
hash, hence a decision: a group of them that goes over what is left of its source's target is left out as a whole, and the
documents after it take its place as far as they can; without words all targets are 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own_columns, read, written

#: 3 levels of 4096 buckets: 2^36 buckets on the boundary.
LEVELS, BITS = 3, 12
#: After the first threshold, documents beyond it that are no larger than what is left get a threshold of their own, so that
#: a long document on the boundary doesn't leave a gap.
ROUNDS = 2
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: one row for each source (source, source_size). Adds target: by weight, at most MOST times the size.

    Filling to a common level: sources with the least room for their weight are full first, and the level is the first at
    which the next source is not."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_room = W.orderBy("_room", F.col("source").asc_nulls_last())
    full = by_room.rowsBetween(W.unboundedPreceding, -1)
    out = sizes.withColumn("_w", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).withColumn("_room", MOST * F.col("source_size") / F.col("_w"))
    out = out.withColumn("_level", (F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(full), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(full), F.lit(0))))
    out = out.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_room"), F.struct(F.row_number().over(by_room), F.col("_level").alias("l")))).over(every)["l"])
    return out.select("source", "source_size", F.least(F.col("_level") * F.col("_w"), MOST * F.col("source_size").cast("double")).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    """Adds _source, _size and _h, the document's fixed hash of LEVELS * BITS bits."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.lit(5)), 64 - LEVELS * BITS)
    return docs.withColumns({"_source": F.col("source").cast("string"), "_size": word_count(F.col("text")), "_h": h})


def thresholds(sized: DataFrame, target_of=targets) -> DataFrame:
    """For each source (_s): source_size, target, how often it takes every document, and the hashes below which once more."""
    rows = sized.select(F.col("_source").alias("source"), F.col("_size").alias("size"), "_h")
    goals = target_of(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = goals.withColumn("_times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("_left", F.col("target") - F.col("_times") * F.col("source_size"))
    more = F.lit(False)
    for k in range(ROUNDS):
        goals = _thresholds(_named(rows, goals).where(~more & _beyond(k)) if k else rows, goals, k)
        more = more | _taken(k, "size")
    return goals.withColumnRenamed("source", "_s")


def mixed(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds source_size, target and times, how often the mix takes each row."""
    more = F.lit(False)
    for k in range(ROUNDS):
        more = more | _taken(k, "_size")
    out = sized.join(goals, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("times", (F.col("_times") + more.cast("long")).cast("long"))
    return out.select(*sized.columns, "source_size", "target", "times")


def mix(docs: DataFrame, target_of=targets) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times. target_of gives each source's target from the sources' sizes."""
    sized = written(_sized(docs).select(F.col("doc_id").cast("long"), "_source", "_size", "_h"), "sizes")
    out = mixed(sized, thresholds(sized, target_of))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("times")).alias("taken"), "times")


def repeat_by_mix(docs: DataFrame, target_of=targets) -> DataFrame:
    """docs, each as often as the mix takes it. Rows without words are taken as often as every row of their source is."""
    rows = docs.select("doc_id", "text", "source", F.struct(*own_columns(docs)).alias("row"))
    sized = _sized(rows).select("row", "_source", "_size", "_h")
    goals = thresholds(written(sized.drop("row"), "sizes"), target_of)
    out = mixed(sized, goals).where("times > 0").withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _beyond(k: int) -> Column:
    """Not on the thresholds of the rounds before k: what went over there (one hash, so one row or rows that repeat) would go
    over again, and end the round where it begins."""
    out = F.lit(True)
    for j in range(k):
        out = out & (F.col("_h") != F.col(f"_path{j}"))
    return out


def _taken(k: int, size: str) -> Column:
    """Whether round k takes a row once more."""
    return (F.col("_h") < F.col(f"_path{k}")) & (F.col(size) <= F.col(f"_most{k}")) & _beyond(k)


def _named(rows: DataFrame, goals: DataFrame) -> DataFrame:
    return rows.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _thresholds(rows: DataFrame, goals: DataFrame, k: int) -> DataFrame:
    """goals with _path<k>: rows below this hash fit into _left (no rows larger than _left count), and what is left then."""
    name = f"_path{k}"
    bound = goals.withColumns({f"_most{k}": F.col("_left"), name: F.lit(0).cast("long")})
    rows = rows.select("source", "size", "_h", *(["_left"] if k else []))
    if k:
        rows = rows.where(F.col("size") <= F.col("_left")).drop("_left")
    for level in range(LEVELS):
        bound = written(bound, "bound")
        down = (LEVELS - 1 - level) * BITS
        own = bound.select(F.col("source").alias("_s"), F.col(name).alias("_path"), F.col("_left").alias("_still"))
        match = F.col("source").eqNullSafe(F.col("_s"))
        inside = rows.join(own, match & (F.shiftright("_h", down + BITS) == F.col("_path"))) if level else rows
        inside = inside.groupBy("source", F.shiftright("_h", down).alias("_b")).agg(F.sum("size").alias("_n"))
        found = inside.withColumn("_sum", F.sum("_n").over(W.partitionBy("source").orderBy("_b"))).join(own, match)
        # the first bucket that goes over what is left; with none, all buckets are taken
        over = F.when(F.col("_sum") > F.col("_still"), F.struct(F.col("_b").alias("b"), (F.col("_still") - F.col("_sum") + F.col("_n")).alias("l")))
        found = found.groupBy("_s").agg(F.min(over).alias("_f"), F.max("_b").alias("_last"), (F.max("_still") - F.max("_sum")).alias("_rest"))
        found = found.select("_s", F.coalesce("_f.b", F.col("_last") + 1).alias("_p"), F.coalesce("_f.l", "_rest").alias("_l"))
        bound = bound.join(found, match, "left").withColumns({"_left": F.coalesce("_l", "_left"), name: F.coalesce("_p", F.shiftleft(F.col(name), BITS))}).drop("_s", "_p", "_l")
    return written(bound, "thresholds")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("times")
