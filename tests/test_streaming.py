"""Streams against their batch twins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.sources import adapters
from tessera.streaming import feed

SF = "/root/testdata/sf0.001"


def streamed(spark, rows, path, plan, name):
    rows.coalesce(1).write.parquet(str(path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(path / "in"))
    q = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_monotone_serials(spark, tmp_path):
    rows = adapters.feed(spark, SF)
    got = {(r["channel"], r["event_id"]) for r in streamed(spark, rows, tmp_path, feed.monotone, "mono").collect()}
    batch = catalogue.QUERIES["serial_monotone_accept"](spark, SF).filter("accepted")
    assert got == {(r["channel"], r["event_id"]) for r in batch.collect()}


def closed(rows):
    """The time that the watermark of two hours has reached once all rows are read."""
    return rows.agg(F.max("ts")).first()[0] - timedelta(hours=2)


def test_tumbling_windows(spark, tmp_path):
    rows = adapters.feed(spark, SF)
    got = {(r["event_type"], r["hour"]): r["n"] for r in streamed(spark, rows, tmp_path, feed.tumbling, "tumble").collect()}
    batch = {(r["event_type"], r["hour"]): r["n"] for r in catalogue.QUERIES["tumbling_windows"](spark, SF).collect()}
    end = closed(rows)
    want = {k: n for k, n in batch.items() if datetime.strptime(k[1], "%Y-%m-%d %H:%M") + timedelta(hours=1) <= end}
    assert want and got == want


def test_session_windows(spark, tmp_path):
    rows = adapters.feed(spark, SF)
    got = {(r["user_id"], r["first"]): r["n"] for r in streamed(spark, rows, tmp_path, feed.sessions, "session").collect()}
    end, gap = closed(rows), timedelta(minutes=30)
    by = {}
    for r in rows.select("user_id", "ts").collect():
        by.setdefault(r["user_id"], []).append(r["ts"])
    want = {}
    for user, times in by.items():
        times.sort()
        first, last, n = times[0], times[0], 0
        for t in [*times, None]:
            if t is None or t - last >= gap:
                if last + gap <= end:
                    want[user, first.strftime("%Y-%m-%d %H:%M:%S")] = n
                first, n = t, 0
            last, n = t, n + 1
    assert want and got == want


def test_lines(spark):
    lines = spark.createDataFrame([("00000001|0042\n",), ("1|0042",), ("00000002|42",), ("00000003|00a2",), ("00000004|9999",)], "value string")
    assert [(r["serial"], r["digits"]) for r in feed.parsed(lines, 4).collect()] == [(1, "0042"), (4, "9999")]
