"""Queries through ordered folds, iterations and whole-clip transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.plans.registry import query, sql_query
from tessera.session import ship
from tessera.sources import adapters, clips

NUMBERED = "o AS (SELECT channel, event_id, value, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS k FROM {feed})"


@query("idle_cost_ewma", f"WITH RECURSIVE {NUMBERED}, r AS (SELECT channel, event_id, k, value AS cost FROM o WHERE k = 1 UNION ALL SELECT o.channel, o.event_id, o.k, CASE WHEN o.value > r.cost THEN o.value ELSE 0.9e0 * r.cost + 0.1e0 * o.value END AS cost FROM r JOIN o ON o.channel = r.channel AND o.k = r.k + 1) SELECT channel, event_id, floor(cost * 10000 + 0.5e0) / 10000 AS cost FROM r")
def idle_cost_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up at once, down by a tenth: the cost that an idle slot must hold."""

    def step(cost, row):
        cost = row.value if cost is None or row.value > cost else 0.9 * cost + 0.1 * row.value
        return cost, (row.channel, row.event_id, cost)

    f = adapters.feed(spark, sf_dir).select("channel", "event_id", "ts", "value")
    got = folds.fold(f, "channel", ["ts", "event_id"], step, None, "channel bigint, event_id bigint, cost double")
    return got.withColumn("cost", F.floor(F.col("cost") * 10000 + 0.5) / 10000)  # the same halves up on both engines


@query("clock_pacing", f"WITH RECURSIVE {NUMBERED}, r AS (SELECT channel, event_id, k, value AS phase FROM o WHERE k = 1 UNION ALL SELECT o.channel, o.event_id, o.k, CASE WHEN abs(o.value - r.phase) > 60 THEN o.value ELSE r.phase + 0.3e0 * (o.value - r.phase) END AS phase FROM r JOIN o ON o.channel = r.channel AND o.k = r.k + 1) SELECT channel, event_id, floor(phase * 10000 + 0.5e0) / 10000 AS phase FROM r")
def clock_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase that follows its clock in proportion and jumps when it is too far off."""

    def step(phase, row):
        phase = row.value if phase is None or abs(row.value - phase) > 60 else phase + 0.3 * (row.value - phase)
        return phase, (row.channel, row.event_id, phase)

    f = adapters.feed(spark, sf_dir).select("channel", "event_id", "ts", "value")
    got = folds.fold(f, "channel", ["ts", "event_id"], step, None, "channel bigint, event_id bigint, phase double")
    return got.withColumn("phase", F.floor(F.col("phase") * 10000 + 0.5) / 10000)


@query("greedy_budget", "WITH RECURSIVE o AS (SELECT role, id, bytes, row_number() OVER (PARTITION BY role ORDER BY priority DESC, id) AS k FROM {pieces}), r AS (SELECT role, id, k, CASE WHEN bytes <= 5000 THEN bytes ELSE 0 END AS used, bytes <= 5000 AS taken FROM o WHERE k = 1 UNION ALL SELECT o.role, o.id, o.k, CASE WHEN r.used + o.bytes <= 5000 THEN r.used + o.bytes ELSE r.used END AS used, r.used + o.bytes <= 5000 AS taken FROM r JOIN o ON o.role = r.role AND o.k = r.k + 1) SELECT role, id, used, taken FROM r")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank, take what still fits and skip what doesn't."""

    def step(used, row):
        taken = used + row.bytes <= 5000
        used += row.bytes * taken
        return used, (row.role, row.id, used, taken)

    p = adapters.pieces(spark, sf_dir).select("role", "id", "bytes", (-F.col("priority")).alias("rank"))
    return folds.fold(p, "role", ["rank", "id"], step, 0, "role string, id bigint, used bigint, taken boolean")




@query("kmeans_full")
def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.pixels(spark, sf_dir).groupBy("r", "g", "b").agg(F.count("*").alias("weight"))
    return folds.kmeans(p, ["r", "g", "b"], 8, 5)


@query("palette_assignment")
def palette_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean colours of even frames paired one to one with those of odd frames."""
    e = adapters.frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("bigint").alias("label"))
    means = adapters.pixels(spark, sf_dir).join(e, "frame").groupBy((F.col("frame") % 2).alias("side"), "label").agg(*[F.avg(c).alias(c) for c in "rgb"])
    ship(spark)

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values("label") for s in (0, 1))
        d = ((a[list("rgb")].to_numpy()[:, None] - b[list("rgb")].to_numpy()[None]) ** 2).sum(2)
        got = folds.assign_greedily(d)
        return pd.DataFrame({"was": [int(a["label"].iloc[r]) for r, _ in got], "now": [int(b["label"].iloc[c]) for _, c in got]})

    return means.groupBy(F.lit(1).alias("all_")).applyInPandas(pair, "was bigint, now bigint")  # palettes have 256 entries at most




@query("transcode_sweep")
def transcode_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip in version 1 and in version 3 by tile size: the shortest wins, of equals the smallest tile."""
    packed = clips.packed_cells(adapters.cells(spark, sf_dir))
    sized = lambda df, v, t: df.select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.lit(v).alias("version"), F.lit(t).alias("tile_size"))
    out = sized(clips.encoded(packed, 8, 8, 1), 1, 0)
    for t in (4, 8, 16):
        out = out.unionByName(sized(clips.encoded(packed, 8, 8, 3, tile_size=t), 3, t))
    return out.groupBy("path").agg(F.min(F.struct("bytes", "version", "tile_size")).alias("best"), F.max(F.when(F.col("version") == 1, F.col("bytes"))).alias("v1_bytes")).select("path", "v1_bytes", "best.bytes", "best.version", "best.tile_size")


@query("crc_checksums")
def crc_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.frame(spark, sf_dir, "documents")
    return d.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


sql_query("metadata_left_join", "SELECT p.id, p.codec, m.n, m.n IS NULL AS unlabelled FROM {pieces} p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey) m ON m.l_partkey = p.id")
sql_query("report_rows", "SELECT codec, concat(codec, ': ', CAST(count(*) AS {text}), ' files, ', CAST(sum(bytes) AS {text}), ' bytes') AS line FROM {pieces} GROUP BY codec")
sql_query("versioned_names", "SELECT page_id, concat('clip.', substr(sha2(html, 256), 1, 12), '.bin') AS name, sha2(html, 256) AS sha FROM {pages}", "SELECT page_id, concat('clip.', substr(sha256(html), 1, 12), '.bin') AS name, sha256(html) AS sha FROM {pages}")
sql_query("switch_latency", "WITH e AS (SELECT channel, ts, event_id, event_type FROM {feed}), s AS (SELECT channel, event_id AS began FROM e WHERE event_type = 'signup'), p AS (SELECT channel, event_id AS done FROM e WHERE event_type = 'purchase') SELECT s.channel, s.began, coalesce(min(p.done) - s.began, -1) AS latency FROM s LEFT JOIN p ON p.channel = s.channel AND p.done > s.began AND p.done <= s.began + 50 GROUP BY s.channel, s.began")
