"""Operator 7: removal of lines that spread over many sites.

Lines (trimmed, with a word) are hashed to 96 bits. Lines that occur less often than `sites` times cannot reach `sites`
sites and drop out by a plain count. For the rest, HyperLogLog sketches of the site merge by aggregation (partial sketches
are made before the shuffle, so a line that stands in a third of all documents is one row for each task). Lines whose
estimate lies within NEAR of the threshold get an exact distinct count. A line over the threshold stays where it stands
first (smallest doc_id, then text hash and place) and is removed everywhere else.

The text is read three times: to count lines, to write the places of those that are frequent enough, and for the result.
Joins by line: up to MOST_LINES lines are broadcast; of more, those that hold at least 1 / MOST_HOT of all places are, and
only the others are shuffled, so that a line in a third of all documents doesn't land in one task.

Defined results: null and empty texts have no lines; a null site counts as a site of its own; rows that repeat doc_id and
text are treated alike; a null doc_id comes after all others; an empty table gives no rows. All other columns are kept
(_n_lines and _n_removed are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, read, written

SITES = 5
LG_K = 12
#: Estimates from threshold / NEAR to threshold * NEAR are checked exactly.
NEAR = 1.5
#: Lines that are broadcast (20 bytes each, counted before), and the most lines that count as hot.
MOST_LINES, MOST_HOT = 1 << 20, 1 << 14
#: Positions of removed lines are looked up in buckets of 2^BUCKET_BITS places.
BUCKET_BITS = 8
_BLANKS = " \t\x0b\x0c\r"


def lines(docs: DataFrame, site: str) -> DataFrame:
    """_id, _th (which text), site, pos, h1, h2 of every line with a word."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")
    return rows.select("_id", "_th", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _on_lines(rows: DataFrame, table: DataFrame, n: int, places: int) -> DataFrame:
    """rows (places in all) with their line of table, which has n lines, each once, and n_places, how often each occurs."""
    if n <= MOST_LINES:
        return rows.join(F.broadcast(table), ["h1", "h2"])
    hot = F.col("n_places") >= max(2, places // MOST_HOT)
    cold = rows.join(F.broadcast(table.where(hot).select("h1", "h2")), ["h1", "h2"], "left_anti")
    return rows.join(F.broadcast(table.where(hot)), ["h1", "h2"]).unionByName(cold.join(table.where(~hot), ["h1", "h2"]))


def spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """The lines on at least `sites` sites: h1, h2, n_sites (estimated, or exact near the threshold), first (id, text hash,
    place); and the places (_id, _th, pos, h1, h2) at which they stand."""
    rows = lines(docs, site)
    often = written(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_places")).where(F.col("n_places") >= sites), "often")
    n, places = often.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_places"), F.lit(0))).first()
    theirs = written(_on_lines(rows, often, n, places), "places")
    first = F.min(F.struct(F.coalesce("_id", F.lit(2**63 - 1)).alias("id"), "_th", "pos")).alias("first")
    found = theirs.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n_sites"), first, F.max("n_places").alias("n_places"))
    found = written(found, "spread")
    near = found.where(F.col("n_sites").between(sites / NEAR, sites * NEAR)).select("h1", "h2", "n_places")
    exact = _on_lines(theirs.drop("n_places"), near, n, places).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_exact"))
    spread = written(found.join(exact, ["h1", "h2"], "left").withColumn("n_sites", F.coalesce("_exact", "n_sites")).where(F.col("n_sites") >= sites).drop("_exact"), "boilerplate")
    return spread, _on_lines(theirs.drop("n_places"), spread, n, places)


def remove_spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """docs with the text that is left, and _n_lines, _n_removed (lines with a word, before and removed)."""
    _, at = spread_lines(docs, site, sites)
    here = (F.coalesce(F.col("_id"), F.lit(2**63 - 1)) == F.col("first.id")) & (F.col("_th") == F.col("first._th")) & (F.col("pos") == F.col("first.pos"))
    drops = at.where(~here).groupBy("_id", "_th").agg(F.collect_set("pos").alias("_all"))
    # below the join, so that the buckets are made once for each text and not for each line
    buckets = F.transform(F.sequence(F.lit(0), F.shiftright(F.array_max("_all"), BUCKET_BITS)), lambda b: F.filter("_all", lambda p: F.shiftright(p, BUCKET_BITS) == b))
    drops = drops.select("_id", "_th", F.size("_all").cast("long").alias("_n"), buckets.alias("_drop"))
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"))
    out = rows.join(drops, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_th")), "left")
    text = F.col("row.text")
    parts = F.split(text, "\n", -1)
    gone = lambda i: F.coalesce(F.array_contains(F.get("_drop", F.shiftright(i, BUCKET_BITS)), i), F.lit(False))
    left = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(~gone(i), x)), lambda x: x.isNotNull()), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))).cast("long")
    kept = [left.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return out.select(*kept, n_lines.alias("_n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("_n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_spread_lines(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line, length(line) AS n FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
s AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '')) >= 5),
m AS (SELECT l.*, s.line IS NOT NULL AND s.first <> (l.doc_id, l.pos) AS gone FROM l LEFT JOIN s ON l.line = s.line)
SELECT doc_id, count(*) FILTER (line <> '')::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, greatest(0, coalesce(sum(n) FILTER (NOT gone), 0) + count(*) FILTER (NOT gone) - 1)::BIGINT AS n_chars_left
FROM m GROUP BY doc_id
"""
