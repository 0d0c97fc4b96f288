"""Streams: masking needs no state; counts by entity and time window close with the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scrub import scrub, scrubbed


def scrub_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """As scrub() in mask mode; placeholders are numbered over a whole table and have no stream."""
    if options.pop("mode", "mask") != "mask":
        raise ValueError("placeholders need the whole table")
    return scrub(stream, text, "mask", **options)


def entity_counts_by_window(stream: DataFrame, ts: str, text: str = "text", window: str = "5 minutes", late: str = "10 minutes", **options) -> DataFrame:
    found = stream.withWatermark(ts, late).select(F.col(ts), F.explode(scrubbed(F.col(text), **options)["findings"]).alias("f"))
    return found.groupBy(F.window(ts, window), F.col("f.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
