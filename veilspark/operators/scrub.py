"""Masking, pseudonyms, findings and counts for a column of texts.

Detection and splicing run in one Arrow-batched function (spans by Python's regular expressions took half the time of the
for. Numbering, counting and reports are joins and aggregations.

Placeholder mode needs the findings twice, for the numbers and for the texts. Their places are kept by persist(), so that texts go
through Python once and no original value is written to a shared folder; spark.catalog.clearCache() gives the room back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.detect import detect, found_all
from ..functions.masks import mask_value
from ..functions.normalise import canonical_column
from ..plans.entities import MAX_CHARS, RULES, TAGS, Rule, chosen

FINDING = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string,value:string,original_masked:string,replacement:string,scrubbed_start:int,scrubbed_end:int>"
_SPAN = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string>"
_RESULT = f"struct<scrubbed:string,findings:array<{FINDING}>>"
_ENTITIES, _RECOGNIZERS = pa.array([r.entity for r in RULES]), pa.array([r.name for r in RULES])
POLICIES = ("fail", "quarantine")


class _Findings(NamedTuple):
    """Findings of a batch as columns, by text and place; ends: how many there are up to each text."""

    ends: pa.Array
    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    entity: pa.Array
    recognizer: pa.Array

    def nested(self, **columns) -> pa.ListArray:
        each = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
        return pa.ListArray.from_arrays(self.ends, each)


def _looked_through(texts: list[str | None], wanted: set[str], allow: list[str], join_broken: bool, ner, extra: tuple[Rule, ...]) -> _Findings:
    if ner or extra:
        spans = [(k, *s) for k, t in enumerate(texts) if t is not None for s in detect(t, wanted, allow, join_broken, ner, extra)]
        of, entity, start, end, score, recognizer, _ = zip(*spans) if spans else ((),) * 7
        of, start, end, score = np.array(of, np.int64), np.array(start, np.int32), np.array(end, np.int32), np.array(score, np.float64)
        entity, recognizer = pa.array(entity, pa.string()), pa.array(recognizer, pa.string())
    else:
        of, start, end, score, order = found_all(texts, wanted, allow, join_broken)
        entity, recognizer = _ENTITIES.take(pa.array(order)), _RECOGNIZERS.take(pa.array(order))
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    return _Findings(pa.array(ends, pa.int32()), of, start.astype(np.int32), end.astype(np.int32), np.array([round(x, 3) for x in score.tolist()], np.float64), entity, recognizer)


def _spliced(texts: list[str | None], found: _Findings) -> pa.StructArray:
    """The masked texts and their findings."""
    of, start, end = found.of.tolist(), found.start.tolist(), found.end.tolist()
    values = [texts[k][a:b] for k, a, b in zip(of, start, end)]
    masks = list(map(mask_value, found.entity.to_pylist(), values))
    new, done, parts = list(texts), 0, []
    for i, (k, a, b, mask) in enumerate(zip(of, start, end, masks), 1):
        parts += (texts[k][done:a], mask)
        done = b
        if i == len(of) or of[i] != k:
            new[k] = "".join(parts) + texts[k][b:]
            done, parts = 0, []
    # starts move by the sum of what the findings before in the text have grown by
    sizes = np.fromiter(map(len, masks), np.int32, len(masks))
    before = np.concatenate([[0], np.cumsum(sizes - (found.end - found.start))])
    begins = (found.start + before[:-1] - before[np.searchsorted(found.of, found.of)]).astype(np.int32)
    masked = pa.array(masks, pa.string())
    each = found.nested(entity_type=found.entity, start=found.start, end=found.end, score=found.score, recognizer=found.recognizer, value=pa.array(values, pa.string()), original_masked=masked, replacement=masked, scrubbed_start=begins, scrubbed_end=begins + sizes)
    return pa.StructArray.from_arrays([pa.array(new, pa.string()), each], ["scrubbed", "findings"])


def limited(text: Column, max_chars: int | None, on_long: str) -> tuple[Column, Column]:
    """The text, and whether it is too long. Such a text fails the query or is null; it is never passed on."""
    if on_long not in POLICIES:
        raise ValueError(f"unknown policy {on_long}")
    if max_chars is None:
        return text, F.lit(False)
    long = F.coalesce(F.length(text) > max_chars, F.lit(False))
    return F.when(long, F.raise_error(F.lit("TEXT_TOO_LONG")) if on_long == "fail" else F.lit(None)).otherwise(text), long


def scrubbed(text: Column, entities: list[str] | None = None, allow: Sequence[str] = (), join_broken: bool = True, ner=None, extra: Sequence[Rule] = (), max_chars: int | None = MAX_CHARS, on_long: str = "fail") -> Column:
    """A struct of the masked text and its findings; null for a null text, and for one over max_chars with "quarantine"."""
    extra = tuple(extra)
    wanted, allow = set(chosen(entities, extra)), [t for t in allow if t]
    text, _ = limited(text, max_chars, on_long)

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        return _spliced(rows, _looked_through(rows, wanted, allow, join_broken, ner, extra))

    if ner or extra:
        return run(text)
    got = run(F.when(text.rlike("[\\p{Nd}@]"), text))
    return F.struct(F.coalesce(got["scrubbed"], text).alias("scrubbed"), got["findings"].alias("findings"))


def spans(text: Column, entities: list[str] | None = None, allow: Sequence[str] = (), join_broken: bool = True, ner=None, extra: Sequence[Rule] = (), max_chars: int | None = MAX_CHARS, on_long: str = "fail") -> Column:
    """The findings of scrubbed() without values and masks, as columns with numbers move faster than texts; none for null."""
    extra = tuple(extra)
    wanted, allow = set(chosen(entities, extra)), [t for t in allow if t]
    text, _ = limited(text, max_chars, on_long)

    @F.arrow_udf(f"array<{_SPAN}>")
    def run(texts: pa.Array) -> pa.Array:
        found = _looked_through(texts.to_pylist(), wanted, allow, join_broken, ner, extra)
        return found.nested(entity_type=found.entity, start=found.start, end=found.end, score=found.score, recognizer=found.recognizer)

    return run(text if ner or extra else F.when(text.rlike("[\\p{Nd}@]"), text))


def valued(text: Column, found: str) -> Column:
    """Entity and value of each of the spans."""
    return F.transform(found, lambda f: F.struct(f["entity_type"].alias("entity_type"), text.substr(f["start"] + 1, f["end"] - f["start"]).alias("value")))


def masks_of(found: Column) -> Column:
    """Masks for structs of entity_type and value."""

    @F.arrow_udf("array<string>")
    def run(found: pa.Array) -> pa.Array:
        each = found.flatten()
        ends = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        masks = map(mask_value, each.field("entity_type").to_pylist(), each.field("value").to_pylist())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(masks, pa.string()))

    return run(found)


def scrub(df: DataFrame, text: str = "text", mode: str = "mask", entities: list[str] | None = None, allow: Sequence[str] = (), join_broken: bool = True, ner=None, max_chars: int | None = MAX_CHARS, on_long: str = "fail", order: str | None = None, scope: Sequence[str] = (), extra: Sequence[Rule] = ()) -> DataFrame:
    """df with scrubbed, findings, stats and error: scrubbed_with_mapping() without the mapping.

    mode "mask", or "placeholder" (then order names a column that says which row comes first, and scope the columns within
    which a value keeps its number; rows of equal order are ordered by the values found). Texts over max_chars fail the
    query, or with on_long="quarantine" give a null text and an error; the raw text is never passed on."""
    return scrubbed_with_mapping(df, text, mode, entities, allow, join_broken, ner, max_chars, on_long, order, scope, extra)[0]


def scrubbed_with_mapping(df: DataFrame, text: str = "text", mode: str = "mask", entities: list[str] | None = None, allow: Sequence[str] = (), join_broken: bool = True, ner=None, max_chars: int | None = MAX_CHARS, on_long: str = "fail", order: str | None = None, scope: Sequence[str] = (), extra: Sequence[Rule] = ()) -> tuple[DataFrame, DataFrame | None]:
    """As scrub(), and in placeholder mode the mapping with which the texts were made: mapping() of the texts gives the same,
    but makes all of them for it."""
    ids = None
    if mode not in ("mask", "placeholder"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "placeholder" and order is None:
        raise ValueError("placeholder mode needs an order column")
    c = F.col(f"`{text}`").cast("string")
    _, long = limited(c, max_chars, on_long)
    error = F.when(long, F.lit("TEXT_TOO_LONG")) if on_long == "quarantine" else F.lit(None).cast("string")
    options = (entities, allow, join_broken, ner, extra, max_chars, on_long)
    if mode == "placeholder":
        out, ids = _with_placeholders(df.withColumns({"_f": spans(c, *options), "_error": error, "_text": c}), df.columns, order, list(scope))
    else:
        out = df.withColumn("_s", scrubbed(c, *options)).withColumns({"scrubbed": F.col("_s.scrubbed"), "findings": F.col("_s.findings")}).withColumn("error", error).drop("_s")
    kinds = F.array_distinct(F.transform("findings", lambda f: f["entity_type"]))
    return out.withColumn("stats", F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("findings", lambda f: f["entity_type"] == k)).cast("long")))), ids


def tag_of(entity: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))[entity], entity)


def numbered(values: DataFrame, by: Sequence[str], first: Sequence[str]) -> DataFrame:
    """values with n: 1, 2, ... by `first` within `by`. Ranges of the order are numbered side by side, by places in the sorted
    range, and each begins where the ranges before it end, so no task holds all values of a group."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(parts, *by, *first).sortWithinPartitions(*by, *first)
    ranged = ranged.withColumns({"_p": F.spark_partition_id(), "n": F.monotonically_increasing_id()}).persist(StorageLevel.MEMORY_AND_DISK)
    before = F.sum("_c").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    begins = ranged.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_c"), F.min("n").alias("_at")).withColumn("_begin", F.coalesce(before, F.lit(0)) - F.col("_at") + 1)
    return matched(ranged, begins.drop("_c", "_at"), ["_p", *by], "inner").withColumn("n", F.col("n") + F.col("_begin")).drop("_p", "_begin")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """left with the other columns of right where all keys are equal, null with null."""
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    return left.alias("a").join(right.alias("b"), on, how).select("a.*", *(F.col(f"b.`{c}`") for c in right.columns if c not in keys))


def mapping(found: DataFrame, order: str, scope: Sequence[str] = ()) -> DataFrame:
    """placeholder, tag and value for each different value of `found` (findings by scope), numbered by first appearance."""
    return identified(_values(found, order, scope), scope)


def text_mapping(df: DataFrame, text: str, order: str, scope: Sequence[str] = (), **options) -> DataFrame:
    """mapping() of df's texts, without making masked texts for it. options: those of scrubbed()."""
    c = F.col(f"`{text}`").cast("string")
    return mapping(df.withColumn("_f", spans(c, **options)).withColumn("findings", valued(c, "_f")), order, scope)


def _values(found: DataFrame, order: str, scope: Sequence[str], *keys: str) -> DataFrame:
    """keys, scope, and of each finding its place in the text (_k), _first, tag and value. Where the order is an integer,
    _first is a number: a minimum of structs would make the aggregation sort all findings."""
    kind = found.select(F.col(order)).schema[0].dataType
    slim = F.transform("findings", lambda f: F.struct(tag_of(f["entity_type"]).alias("tag"), canonical_column(f["value"]).alias("value")))
    first = F.struct("_o", "_k")
    if isinstance(kind, IntegralType):  # nulls come first
        first = F.coalesce(F.col("_o").cast("decimal(19,0)"), F.lit(Decimal(-(2**63) - 1))) * F.lit(Decimal(2**31)) + F.col("_k")
    each = exploded(found.select(*keys, *scope, F.col(order).alias("_o"), slim.alias("_v")), "_v", *keys, *scope, "_o")
    return each.select(*keys, *scope, "_k", first.alias("_first"), "f.tag", "f.value")


def identified(values: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The mapping of values (tag, value, _first: where it stands)."""
    first = values.groupBy(*scope, "tag", "value").agg(F.min("_first").alias("_first"))
    ids = numbered(first, [*scope, "tag"], ["_first", "value"])
    return ids.select(*scope, "tag", "value", F.concat(F.lit("<"), "tag", F.lit("_"), "n", F.lit(">")).alias("placeholder"))


def replaced(text: Column, findings: str, placeholders: str) -> tuple[Column, Column]:
    """The text with placeholders in place of its findings, and the findings with them. Null where placeholders are missing."""
    found, places = F.col(findings), F.col(placeholders)
    zipped = F.zip_with(found, places, lambda f, p: f.withField("replacement", p))
    before = F.transform(found, lambda f, i: F.struct(F.coalesce(F.get(found, i - 1)["end"], F.lit(0)).alias("at"), f["start"].alias("start"), F.get(places, i).alias("p")))
    pieces = F.transform(before, lambda x: F.concat(text.substr(x["at"] + 1, x["start"] - x["at"]), x["p"]))
    tail = text.substr(F.element_at(found, -1)["end"] + 1, F.length(text))
    # starts move by the sum of what the findings before have grown by
    moved = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("by"), F.array().cast(f"array<{FINDING}>").alias("out")),
        lambda a, f: F.struct(
            (a["by"] + F.length(f["replacement"]) - (f["end"] - f["start"])).alias("by"),
            F.concat(a["out"], F.array(f.withField("scrubbed_start", f["start"] + a["by"]).withField("scrubbed_end", f["start"] + a["by"] + F.length(f["replacement"])))).alias("out"),
        ),
        lambda a: a["out"],
    )
    whole = F.size(places) == F.size(found)
    return F.when(whole, F.concat(F.array_join(pieces, ""), tail)), F.when(whole, moved)


def in_order(pairs: Column) -> Column:
    """Placeholders from collected (place, placeholder) pairs."""
    return F.transform(F.sort_array(pairs), lambda x: x["placeholder"])


def _with_placeholders(found: DataFrame, columns: list[str], order: str, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """From rows with _text, _f (its spans) and _error."""
    rows = found.withColumn("_key", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    text = F.col("_text")
    each = _values(rows.withColumn("findings", valued(text, "_f")), order, scope, "_key")
    ids = identified(each, scope)
    placed = matched(each.drop("_first"), ids, [*scope, "tag", "value"], "inner")
    per_row = placed.groupBy("_key").agg(in_order(F.collect_list(F.struct("_k", "placeholder"))).alias("_p"))
    # the new texts need no more of the spans than their places
    match = rows.withColumn("_at", F.transform("_f", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))).join(per_row, "_key", "left")
    match = match.withColumn("_m", masks_of(valued(text, "_f")))
    whole = F.zip_with(F.zip_with("_f", valued(text, "_f"), lambda f, v: f.withField("value", v["value"])), "_m", lambda f, m: f.withField("original_masked", m).withField("replacement", m).withField("scrubbed_start", f["start"]).withField("scrubbed_end", f["end"]))
    match = match.withColumn("_found", whole.cast(f"array<{FINDING}>"))
    new, places = replaced(text, "_at", "_p")[0], replaced(text, "_found", "_p")[1]
    some = F.size("_at") > 0
    match = match.withColumns({"scrubbed": F.when(some, new).otherwise(F.when(F.col("_error").isNull(), text)), "findings": F.when(some, places).otherwise(F.col("_found")), "error": F.col("_error")})
    return match.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, "scrubbed", "findings", "error"]))), ids


def exploded(rows: DataFrame, findings: str, *columns: Column | str, place: str = "_k") -> DataFrame:
    """columns, and `place` and f for each finding. From a plain explode Spark infers a filter on the array and moves it, with
    the whole detection in it, to the scan: texts would go through Python twice, once in the few tasks of the scan."""
    return rows.select(*columns, F.posexplode_outer(findings).alias(place, "f")).where("f IS NOT NULL")


def detect_findings(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """A row for each finding, without original values. options: those of scrubbed()."""
    rows = df.select(*keys, scrubbed(F.col(f"`{text}`").cast("string"), **options).alias("s"))
    return exploded(rows, "s.findings", *keys, place="finding").select(*keys, "finding", *(f"f.{c}" for c in ("entity_type", "start", "end", "score", "recognizer", "original_masked", "replacement", "scrubbed_start", "scrubbed_end")))


def entity_counts(df: DataFrame, by: list[str] = (), text: str = "text", **options) -> DataFrame:
    return detect_findings(df, list(by), text, **options).groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def restore(scrubbed_df: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """Puts the values of a mapping back in place of placeholders (one scope). What follows the last placeholder of a text
    carries the row's columns, and has a key of its own in the join, which thus deals these parts over all tasks."""
    parts = scrubbed_df.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode(F.regexp_extract_all(F.concat(F.col(text), F.lit("<>")), F.lit("(?s)(.*?)(<[A-Z_]+_[0-9]+>|<>\\z)"), F.lit(0))).alias("_k", "_part"))
    parts = parts.withColumns({"_p": F.regexp_extract("_part", "(<[A-Z_]*_?[0-9]*>)\\z", 1), "_t": F.regexp_replace("_part", "<[A-Z_]*_?[0-9]*>\\z", "")})
    last = F.col("_p") == "<>"
    parts = parts.select("_id", "_k", "_p", "_t", F.when(last, F.struct(*(F.col(f"`{c}`") for c in scrubbed_df.columns))).alias("_row"), F.when(last, F.concat("_p", "_id")).otherwise(F.col("_p")).alias("_j"))
    joined = parts.join(ids.select(F.col("placeholder").alias("_j"), F.col("value").alias("_v")), "_j", "left")
    shown = F.concat("_t", F.coalesce("_v", F.when(F.col("_p") == "<>", "").otherwise(F.col("_p"))))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", shown.alias("s")))), lambda x: x["s"]), "")
    return joined.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), whole.alias("restored")).select("_row.*", "restored")
