"""Counts kept up to date from a stream of synapses (an extension: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(synapses: DataFrame) -> DataFrame:
    """Incoming synapses of each neuron so far; write with output mode ``update`` or ``complete``."""
    return synapses.groupBy("post_id").agg(F.count(F.lit(1)).alias("in_synapses"), F.sum("size").alias("in_weight"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by time window; rows later than ``late`` are dropped and windows before it are closed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
