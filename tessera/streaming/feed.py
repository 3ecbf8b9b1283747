"""Live feeds: the monotone serial filter, late data, tumbling and session windows as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"^(\d{8})\|(\d+)\n?$"


def parsed(lines: DataFrame, digits: int, line: str = "value") -> DataFrame:
    """serial and digits of lines of the form `8-digit serial|digits`; others are dropped."""
    exact = rf"^\d{{8}}\|\d{{{digits}}}\n?$"
    good = lines.filter(F.col(line).rlike(exact))
    return good.withColumn("serial", F.regexp_extract(line, LINE, 1).cast("bigint")).withColumn("digits", F.regexp_extract(line, LINE, 2))


def _accept(key, batches, state):
    """Rows whose serial is over all accepted before; a batch is taken in order of time."""
    top = state.get[0] if state.exists else -(2**62)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    before = rows["serial"].cummax().shift(fill_value=top).clip(lower=top)
    kept = rows[rows["serial"] > before]
    state.update((int(max(top, rows["serial"].max())),))
    yield kept[["channel", "event_id", "serial", "digits"]]


def monotone(feed: DataFrame) -> DataFrame:
    """A stream's accepted rows, with one serial of state a channel; repeated or late serials go."""
    return feed.select("channel", "event_id", "ts", "serial", "digits").groupBy("channel").applyInPandasWithState(_accept, "channel bigint, event_id bigint, serial bigint, digits string", "top bigint", "append", "NoTimeout")


def tumbling(feed: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window; rows later than the watermark are dropped by a stream."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", "total")


def sessions(feed: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return feed.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")
