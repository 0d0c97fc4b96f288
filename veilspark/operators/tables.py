"""Tables: a strategy for every column, pseudonyms that run through all of them, reports and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.masks import keep_first_column
from ..functions.normalise import canonical_column
from .scrub import identified, in_order, matched, numbered, replaced, scrubbed, tag_of

STRATEGIES = ("mask_all", "ner", "skip")
#: The number of the first row of data in a file with a header.
FIRST_ROW = 2


def check_strategies(columns: list[str], strategies: dict[str, str]) -> None:
    if not isinstance(strategies, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in strategies.items()):
        raise ValueError("strategies must map column names to strategies")
    if unknown := sorted({v for v in strategies.values() if v not in STRATEGIES}):
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    if missing := [c for c in columns if c not in strategies]:
        raise ValueError(f"columns without a strategy: {', '.join(missing)}")


_FOUND = ("entity_type", "original_masked", "replacement", "score", "recognizer")


def scrub_table(df: DataFrame, strategies: dict[str, str], row: str, mode: str = "mask", scope: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The scrubbed table, its findings (row, column, ...) in their order, and in placeholder mode the mapping. `row` numbers
    the rows (nulls and repeated numbers are rows like others); `scope` names columns within which a value keeps its number.

    Every cell is made from its own row, by columns of a projection, or in placeholder mode by a key of our own; where that
    finds nothing a cell is null, never the original."""
    columns = [c for c in df.columns if c != row and c not in scope]
    check_strategies(columns, strategies)
    if mode not in ("mask", "placeholder"):
        raise ValueError(f"unknown mode {mode}")
    named = [c for c in columns if strategies[c] == "ner"]
    whole = [c for c in columns if strategies[c] == "mask_all"]
    own = lambda c: F.col(f"`{c}`").cast("string")
    base = df.withColumns({f"_ner{k}": scrubbed(F.coalesce(own(c), F.lit("")), **options) for k, c in enumerate(named)})
    base = base.withColumns({f"_all{k}": keep_first_column(own(c)) for k, c in enumerate(whole)})
    ids = None
    if mode == "placeholder":
        base, ids = _table_placeholders(base, columns, named, whole, row, list(scope))
    cells = []
    for k, c in enumerate(columns):
        if c in named:
            n = named.index(c)
            cells.append(F.transform(f"_ner{n}.findings", lambda f, i: F.struct(F.lit(k).alias("col"), F.lit(c).alias("column"), i.alias("finding"), *(f[x].alias(x) for x in _FOUND))))
        elif c in whole:
            mask = (F.lit("COLUMN_MASK"), keep_first_column(own(c)), F.col(f"_all{whole.index(c)}"), F.lit(1.0), F.lit("ColumnStrategy"))
            one = F.array(F.struct(F.lit(k).alias("col"), F.lit(c).alias("column"), F.lit(0).alias("finding"), *(v.alias(x) for x, v in zip(_FOUND, mask))))
            cells.append(F.when(own(c) != "", one))
    none = F.array().cast("array<struct<col:int,column:string,finding:int,entity_type:string,original_masked:string,replacement:string,score:double,recognizer:string>>")
    found = F.concat(*(F.coalesce(x, none) for x in cells)) if cells else none
    findings = base.select(*scope, F.col(f"`{row}`"), F.explode_outer(found).alias("f")).where("f IS NOT NULL").select(*scope, F.col(f"`{row}`"), "f.*").orderBy(*scope, F.col(f"`{row}`"), "col", "finding")
    new = {c: F.when(own(c).isNotNull(), F.col(f"_ner{k}.scrubbed")) for k, c in enumerate(named)} | {c: F.when(own(c) == "", own(c)).otherwise(F.col(f"_all{k}")) for k, c in enumerate(whole)}
    return base.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns)), findings, ids


def _table_placeholders(base: DataFrame, columns: list[str], named: list[str], whole: list[str], row: str, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """base with placeholders in _ner and _all, and the mapping. Values are numbered by row, then column, then place."""
    rows = base.withColumn("_key", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    place = lambda c, k: F.struct(F.col(f"`{row}`").alias("r"), F.col("_key").alias("key"), F.lit(columns.index(c)).alias("c"), k.alias("k"))
    cells = [F.lit(None).cast("array<struct<col:int,_k:int,tag:string,value:string>>")]
    for k, c in enumerate(named):
        cells.append(F.transform(f"_ner{k}.findings", lambda f, i: F.struct(F.lit(k).alias("col"), i.alias("_k"), tag_of(f["entity_type"]).alias("tag"), canonical_column(f["value"]).alias("value"))))
    none = F.array().cast("array<struct<col:int,_k:int,tag:string,value:string>>")
    each = rows.select("_key", *scope, F.col(f"`{row}`").alias("_row"), F.explode(F.concat(*(F.coalesce(x, none) for x in cells))).alias("f")).select("_key", *scope, "_row", "f.*")
    order = F.create_map(*(F.lit(x) for k, c in enumerate(named) for x in (k, columns.index(c))))[F.col("col")] if named else F.col("col")
    each = each.withColumn("_first", F.struct(F.col("_row").alias("r"), F.col("_key").alias("key"), order.alias("c"), F.col("_k").alias("k"))).drop("_row")
    ids = identified(each, scope)
    if named:
        placed = matched(each, ids, [*scope, "tag", "value"], "inner")
        per_row = placed.groupBy("_key").agg(*(in_order(F.collect_list(F.when(F.col("col") == k, F.struct("_k", "placeholder")))).alias(f"_p{k}") for k in range(len(named))))
        rows_out = rows.join(per_row, "_key", "left")
        for k, c in enumerate(named):
            rows_out = rows_out.withColumn("_f", F.col(f"_ner{k}.findings"))
            new, found = replaced(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "_f", f"_p{k}")
            some = F.size("_f") > 0
            rows_out = rows_out.withColumn(f"_ner{k}", F.struct(F.when(some, new).otherwise(F.col(f"_ner{k}.scrubbed")).alias("scrubbed"), F.when(some, found).otherwise(F.col("_f")).alias("findings")))
        rows_out = rows_out.drop("_f", *(f"_p{k}" for k in range(len(named))))
    else:
        rows_out = rows
    if whole:
        each = rows.select("_key", *scope, F.explode(F.array(*(F.struct(F.lit(k).alias("col"), F.lit(c).alias("tag"), F.col(f"`{c}`").cast("string").alias("value"), place(c, F.lit(0)).alias("_first")) for k, c in enumerate(whole)))).alias("f")).select("_key", *scope, "f.*").where("value <> ''")
        names = numbered(each.groupBy(*scope, "tag", "value").agg(F.min("_first").alias("_first")), [*scope, "tag"], ["_first", "value"])
        # numbers that findings have taken under the same name
        taken = ids.groupBy(*scope, "tag").agg(F.count(F.lit(1)).alias("taken"))
        names = matched(names, taken, [*scope, "tag"], "left").withColumn("n", F.col("n") + F.coalesce("taken", F.lit(0)))
        names = names.select(*scope, "tag", "value", F.concat(F.lit("<"), "tag", F.lit("_"), "n", F.lit(">")).alias("placeholder"))
        placed = matched(each, names, [*scope, "tag", "value"], "inner").groupBy("_key").agg(*(F.max(F.when(F.col("col") == k, F.col("placeholder"))).alias(f"_all{k}") for k in range(len(whole))))
        rows_out = rows_out.drop(*(f"_all{k}" for k in range(len(whole)))).join(placed, "_key", "left")
        ids = ids.unionByName(names)
    return rows_out.drop("_key"), ids


def report(findings: DataFrame, row: str, filename: str, filetype: str, mode: str, strategies: dict[str, str] | None = None) -> DataFrame:
    """One row of JSON: when, what, counts and findings by row, column and place. Original values are only in it masked."""
    each = findings.select(F.struct(F.col(row).alias("_r"), F.col("col").alias("_c"), F.col("finding").alias("_f"), "entity_type", "original_masked", "replacement", "score", "recognizer", F.struct(F.col(row).alias("row"), "column").alias("location")).alias("f"))
    listed = each.agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(*(f[c].alias(c) for c in ("entity_type", "original_masked", "replacement", "score", "recognizer", "location")))).alias("findings"))
    stats = findings.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "n"))).alias("stats"))
    plans = F.create_map(*(F.lit(x) for kv in (strategies or {}).items() for x in kv)) if strategies else F.lit(None).cast("map<string,string>")
    body = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit("veilspark").alias("tool"), F.lit(filename).alias("source_filename"), F.lit(filetype).alias("filetype"), F.lit(mode).alias("mode"), plans.alias("column_strategies"), "stats", "findings")
    return stats.crossJoin(listed).select(F.to_json(body).alias("report"))  # one row each


def preview(df: DataFrame, row: str, samples: int = 3) -> DataFrame:
    """For each column its first non-empty values, and the number of rows."""
    columns = [c for c in df.columns if c != row]
    cells = df.select(F.col(row), F.posexplode(F.array(*(F.col(f"`{c}`").cast("string") for c in columns))).alias("col", "value"))
    full = cells.where("value <> ''").withColumn("n", F.row_number().over(W.partitionBy("col").orderBy(row))).where(F.col("n") <= samples)
    got = full.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("samples"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "col int, name string")
    return names.join(got, "col", "left").crossJoin(df.agg(F.count(F.lit(1)).alias("row_count"))).select("col", "name", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "row_count")
