"""Whole files: read, scrub by column strategies, write, report. Every file stands for itself: a value keeps its number within
a file only, and a file with an error (too large, ragged, a cell too long, a column without a strategy) has no output at all.

Rows of files are exploded to cells, so a file is worked on by many tasks; only writing and reporting gather a file again,
which the limits on files bound (10 MiB, 20 000 rows, 500 columns).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import keep_first_column
from ..sources.files import file_bytes, read_files
from .names import distinct_names, output_name, safe_name
from .scrub import mapping, matched, numbered, scrub
from .tables import STRATEGIES

_LOCATION = "struct<start:int,end:int,row:long,column:string>"


def _literal(strategies: dict[str, str]) -> Column:
    if not isinstance(strategies, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in strategies.items()):
        raise ValueError("strategies must map column names to strategies")
    if unknown := sorted({v for v in strategies.values() if v not in STRATEGIES}):
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    return F.create_map(*(F.lit(x) for kv in strategies.items() for x in kv)) if strategies else F.create_map().cast("map<string,string>")


def scrub_files(spark: SparkSession, path: str, strategies: dict | None = None, mode: str = "mask", **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """strategies: a strategy for every column of all tables, or such a dictionary for each file name.

    Returns the files (path, name, filetype, content, report, error), their findings (path, row, col, column, finding, start,
    end, ...), and in placeholder mode the mapping, which is in neither of them. options: those of scrub()."""
    strategies = strategies or {}
    each = bool(strategies) and all(isinstance(v, dict) for v in strategies.values())
    plan = F.lit(None).cast("map<string,string>")
    if each:
        for name, own in strategies.items():
            plan = F.when(F.element_at(F.split("path", "/"), -1) == name, _literal(own)).otherwise(plan)
    else:
        plan = _literal(strategies)
    plan = F.coalesce(plan, F.create_map().cast("map<string,string>"))
    table = F.col("filetype") != "txt"
    rows = read_files(spark, path).withColumn("plan", F.when(table, plan))
    lacking = F.filter("header", lambda c: ~F.map_contains_key("plan", c))
    rows = rows.withColumn("error", F.coalesce("error", F.when(table & (F.size(lacking) > 0), F.concat(F.lit("NO_STRATEGY "), F.array_join(lacking, ", ")))))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    good = rows.where("error IS NULL AND row IS NOT NULL")
    data = good.where((F.col("filetype") == "txt") | (F.col("row") > 1))
    columns = F.when(F.col("filetype") == "txt", F.array(F.lit(None).cast("string"))).otherwise(F.col("header"))
    cells = data.select("path", "row", "plan", F.size("cells").alias("_width"), "cells", F.posexplode(columns).alias("col", "column"))
    cells = cells.select("path", "row", "col", "column", (F.col("col") < F.col("_width")).alias("there"), F.coalesce(F.get("cells", F.col("col")), F.lit("")).alias("value"), F.coalesce(F.when(F.col("column").isNotNull(), F.element_at("plan", F.col("column"))), F.lit("ner")).alias("strategy"))
    done, ids = _cells(cells, mode, options)
    done = done.persist(StorageLevel.MEMORY_AND_DISK)
    found = done.select("path", "row", "col", "column", F.posexplode("findings").alias("finding", "f"))
    found = found.select("path", "row", "col", "column", "finding", *(f"f.{c}" for c in ("entity_type", "start", "end", "original_masked", "replacement", "score", "recognizer")))
    return _files(rows, done, found, mode), found.orderBy("path", "row", "col", "finding"), ids


def _cells(cells: DataFrame, mode: str, options: dict) -> tuple[DataFrame, DataFrame | None]:
    """path, row, col, column, there, new, findings, error of every cell, and the mapping."""
    keep = ["path", "row", "col", "column", "there"]
    named = cells.where("strategy = 'ner'").withColumn("_order", F.struct("row", "col"))
    named = scrub(named, "value", mode, order="_order" if mode == "placeholder" else None, scope=["path"] if mode == "placeholder" else (), on_long="quarantine", **options)
    ids = mapping(named, "_order", ["path"]) if mode == "placeholder" else None
    kind = named.schema["findings"].dataType
    one = named.select(*keep, F.col("scrubbed").alias("new"), "findings", "error")
    no = F.lit(None)
    whole = cells.where("strategy = 'mask_all'").withColumn("new", keep_first_column(F.col("value")))
    if mode == "placeholder":
        filled = whole.where("value <> ''").withColumn("tag", F.col("column"))
        names = numbered(filled.groupBy("path", "tag", "value").agg(F.min(F.struct("row", "col")).alias("_first")), ["path", "tag"], ["_first", "value"])
        names = matched(names, ids.groupBy("path", "tag").agg(F.count(F.lit(1)).alias("taken")), ["path", "tag"], "left")
        names = names.select("path", "tag", "value", F.concat(F.lit("<"), "tag", F.lit("_"), F.col("n") + F.coalesce("taken", F.lit(0)), F.lit(">")).alias("placeholder"))
        whole = matched(whole.withColumn("tag", F.col("column")), names, ["path", "tag", "value"], "left").withColumn("new", F.when(F.col("value") == "", "").otherwise(F.col("placeholder")))
        ids = ids.unionByName(names)
    mask = F.array(F.struct(F.lit("COLUMN_MASK").alias("entity_type"), F.lit(0).alias("start"), F.length("value").alias("end"), F.lit(1.0).alias("score"), F.lit("ColumnStrategy").alias("recognizer"), "value", keep_first_column(F.col("value")).alias("original_masked"), F.col("new").alias("replacement"), F.lit(0).alias("scrubbed_start"), F.length("new").alias("scrubbed_end")))
    two = whole.select(*keep, "new", F.when(F.col("value") != "", mask.cast(kind)).otherwise(F.array().cast(kind)).alias("findings"), no.cast("string").alias("error"))
    three = cells.where("strategy = 'skip'").select(*keep, F.col("value").alias("new"), F.array().cast(kind).alias("findings"), no.cast("string").alias("error"))
    return one.unionByName(two).unionByName(three), ids


def _files(rows: DataFrame, done: DataFrame, found: DataFrame, mode: str) -> DataFrame:
    heads = rows.groupBy("path", "filetype").agg(F.max("title").alias("title"), F.max("error").alias("error"), F.max_by("header", F.col("row").isNotNull()).alias("header"), F.max(F.to_json("plan")).alias("plan"))
    late = done.groupBy("path").agg(F.max("error").alias("late"))
    heads = heads.join(late, "path", "left").withColumn("error", F.coalesce("error", "late")).drop("late")
    whole = heads.join(done.select("path", "row", "col", "there", "new"), "path", "left")

    def build(table: pd.DataFrame) -> pd.DataFrame:
        first = table.iloc[0]
        content = None
        if first.error is None:
            header = [] if first.header is None else list(first.header)
            out = {}
            for r, there, new in table[table.row.notna()].sort_values(["row", "col"])[["row", "there", "new"]].itertuples(index=False):
                out.setdefault(r, []).extend([new] * bool(there))
            rows = [header] * bool(header) + list(out.values())
            if any(v is None for r in rows for v in r):
                return pd.DataFrame({"path": [first.path], "content": [None], "failed": ["INCOMPLETE"]})
            content = file_bytes(first.filetype, first.title, rows)
        return pd.DataFrame({"path": [first.path], "content": [content], "failed": [None]})

    built = whole.groupBy("path").applyInPandas(build, "path string, content binary, failed string")
    out = heads.join(built, "path").withColumn("error", F.coalesce("error", "failed")).drop("failed", "title", "header")
    file = F.element_at(F.split("path", "/"), -1)
    out = out.withColumns({"name": F.when(F.col("error").isNull(), output_name(file)), "source": safe_name(file)})
    place = F.when(F.col("column").isNull(), F.struct("start", "end", F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("column"))).otherwise(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("row"), F.col("column")))
    item = F.struct("row", "col", "finding", "entity_type", "original_masked", "score", "recognizer", "replacement", place.cast(_LOCATION).alias("location"))
    listed = found.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("_f"))
    shown = F.transform("_f", lambda f: F.struct(*(f[c].alias(c) for c in ("entity_type", "original_masked", "score", "recognizer", "replacement", "location"))))
    stats = found.groupBy("path", "entity_type").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("stats"))
    out = out.join(listed, "path", "left").join(stats, "path", "left")
    none = shown_type(found)
    body = F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit("veilspark").alias("tool"), F.col("source").alias("source_filename"), "filetype", F.lit(mode).alias("mode"),
        F.from_json("plan", "map<string,string>").alias("column_strategies"), F.coalesce("stats", F.create_map().cast("map<string,bigint>")).alias("stats"), F.coalesce(shown, none).alias("findings"),
    )
    return out.select("path", "name", "filetype", "content", F.when(F.col("error").isNull(), F.to_json(body)).alias("report"), "error")


def shown_type(found: DataFrame) -> Column:
    return F.array().cast(f"array<struct<entity_type:string,original_masked:string,score:double,recognizer:string,replacement:string,location:{_LOCATION}>>")


def saved_names(files: DataFrame, archive: Sequence[str] = ()) -> DataFrame:
    """files with names that differ from each other, for save_files()."""
    good = files.where("error IS NULL")
    return distinct_names(good, "name", "path", list(archive)).withColumn("name", F.col("entry")).drop("entry")
