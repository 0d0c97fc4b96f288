"""File names: scrubbed stems, and safe, distinct names in an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scrub import scrubbed

_ILLEGAL = '[<>:"/\\\\|?*\\p{C}]'


def safe_stem(stem: Column) -> Column:
    """A masked stem as a file name: '*' as 'x', illegal and unprintable characters gone, 'file' if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(stem, "\\*", "x"), _ILLEGAL, "")
    return F.when(F.coalesce(F.trim(out), F.lit("")) == "", F.lit("file")).otherwise(out)


def _parts(name: Column) -> tuple[Column, Column]:
    stem, ext = F.regexp_replace(name, "\\.[^.]*$", ""), F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1))
    return safe_stem(scrubbed(stem, on_long="quarantine")["scrubbed"]), ext


def output_name(name: Column) -> Column:
    """<masked stem>.scrubbed.<ext>"""
    stem, ext = _parts(name)
    return F.concat(stem, F.lit(".scrubbed."), ext)


def safe_name(name: Column) -> Column:
    """<masked stem>.<ext>, as reports name the source."""
    stem, ext = _parts(name)
    return F.concat(stem, F.lit("."), ext)


def entry_name(name: Column) -> Column:
    """The last part of a path of either kind, without a drive, illegal characters, and blanks or dots at its ends."""
    base = F.regexp_replace(F.regexp_extract(name, "([^/\\\\]*)$", 1), "^[A-Za-z]:", "")
    base = F.btrim(F.regexp_replace(base, _ILLEGAL, ""), F.lit(" ."))
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit("file")).otherwise(base)


def distinct_names(df: DataFrame, name: str, order: str, archive: list[str] = ()) -> DataFrame:
    """Adds entry: the second of the same name in an archive is `stem (2).ext`, and so on. A made name that another entry has
    already pushes on to the next free number."""
    base = df.withColumn("_b", entry_name(F.col(name)))
    n = F.row_number().over(W.partitionBy(*archive, "_b").orderBy(order))
    rows = base.withColumn("_n", n)
    taken = rows.groupBy(*archive).agg(F.collect_set("_b").alias("_all"))
    rows = rows.join(taken, list(archive)) if archive else rows.crossJoin(taken)  # one row: the at most 40 names of an archive
    stem, ext = F.regexp_replace("_b", "\\.[^.]*$", ""), F.regexp_extract("_b", "(\\.[^.]*)$", 1)
    numbered = lambda k: F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), ext)
    free = F.filter(F.sequence(F.lit(2), F.size("_all") + F.col("_n") + 1), lambda k: ~F.array_contains("_all", numbered(k)))
    return rows.withColumn("entry", F.when(F.col("_n") == 1, F.col("_b")).otherwise(numbered(F.element_at(free, F.col("_n") - 1)))).drop("_b", "_n", "_all")
