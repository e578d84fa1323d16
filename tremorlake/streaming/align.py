"""Continuous form of forcing alignment: tumbling bins with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_bins(forcing: DataFrame, *, step: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Sum and mean per site, channel and bin; a bin is emitted once the watermark passes it.

    State is one partial aggregate per open bin; rows later than ``lateness`` are dropped.
    """
    bins = (
        forcing.withWatermark("ts", lateness)
        .groupBy("site_id", "channel", F.window("ts", step).alias("w"))
        .agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    )
    return bins.select("site_id", "channel", F.col("w.start").alias("ts"), "total", "mean", "n")
