"""Lags, runs, loops and seams of clips. The plans work on whole frames by clip; the SQL on pairs of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import loops
from tessera.plans.registry import query
from tessera.sources import adapters

#: Half a second to the clip's length at 15 frames a second; sums of differences that count as equal, and share of the motion.
LEAST, MOST, ABSOLUTE, RELATIVE = 8, 249, 1165, 1.02
#: The same for zones of four cells, and the lags of 0.3 to 3 seconds.
ZONE_LEAST, ZONE_MOST, ZONE_ABSOLUTE, ZONE_RELATIVE = 4, 45, 110, 1.5

FRAMES = """f AS (SELECT vec_id AS frame, CAST(floor(vec_id / 250) AS BIGINT) AS clip,
  list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS BIGINT)) AS c FROM {embeddings})"""
MOVED = """near AS (SELECT a.clip, a.frame, list_sum(list_transform(list_zip(a.c, b.c), lambda x: abs(x[1] - x[2]))) AS diff FROM f a JOIN f b ON a.clip = b.clip AND b.frame = a.frame + 1),
  last AS (SELECT clip, max(frame) AS frame FROM f GROUP BY clip),
  twice AS (SELECT * FROM near UNION ALL SELECT l.clip, l.frame, n.diff FROM last l JOIN near n ON n.clip = l.clip AND n.frame = l.frame - 1),
  moved AS (SELECT clip, frame, median(diff) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS motion FROM twice)"""
PAIRS = f"""p AS (SELECT a.clip, b.frame - a.frame AS lag_, a.frame, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda x: abs(x[1] - x[2]))) AS BIGINT) AS diff
  FROM f a JOIN f b ON a.clip = b.clip AND b.frame - a.frame BETWEEN {LEAST} AND {MOST})"""
RUNS = f"""e AS (SELECT p.* FROM p JOIN moved m ON m.clip = p.clip AND m.frame = p.frame WHERE p.diff <= {ABSOLUTE} AND p.diff <= {RELATIVE}::DOUBLE * m.motion),
  o AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip, lag_ ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS opens FROM e),
  g AS (SELECT *, sum(opens) OVER (PARTITION BY clip, lag_ ORDER BY frame) AS run FROM o),
  r AS (SELECT clip, lag_, min(frame) AS first, max(frame) - min(frame) + 1 AS length FROM g GROUP BY clip, lag_, run),
  best AS (SELECT clip, lag_, first, length FROM (SELECT *, row_number() OVER (PARTITION BY clip, lag_ ORDER BY length DESC, first) AS k FROM r) WHERE k = 1)"""


@query("lag_difference_profile", f"WITH {FRAMES}, {PAIRS} SELECT clip, lag_, count(*) AS pairs, CAST(sum(diff) AS BIGINT) AS total, min(diff) AS least FROM p GROUP BY clip, lag_")
def lag_difference_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(clip: int, _: int, m: np.ndarray) -> pd.DataFrame:
        each = [(clip, lag, d) for lag in range(LEAST, min(MOST, len(m) - 1) + 1) if len(d := loops.differences(m, lag))]
        return pd.DataFrame([(c, lag, len(d), d.sum(), d.min()) for c, lag, d in each], columns=["clip", "lag_", "pairs", "total", "least"])

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "clip bigint, lag_ bigint, pairs bigint, total bigint, least bigint")


@query("longest_run", f"WITH {FRAMES}, {MOVED}, {PAIRS}, {RUNS} SELECT clip, lag_, first, length FROM best")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(clip: int, first: int, m: np.ndarray) -> pd.DataFrame:
        got = loops.runs(m, LEAST, MOST, ABSOLUTE, RELATIVE)
        return pd.DataFrame([(clip, lag, first + a, n) for lag, a, n in got if n], columns=["clip", "lag_", "first", "length"])

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "clip bigint, lag_ bigint, first bigint, length bigint")


@query("loop_detect", f"""WITH {FRAMES}, {MOVED}, {PAIRS}, {RUNS},
  c AS (SELECT clip, lag_, first, length FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY length DESC, lag_) AS k FROM best WHERE length >= lag_) WHERE k = 1),
  inside AS (SELECT c.clip, c.lag_, p.frame, p.diff, median(p.diff) OVER (PARTITION BY c.clip) AS mid FROM c JOIN p ON p.clip = c.clip AND p.lag_ = c.lag_ AND p.frame >= c.first AND p.frame < c.first + c.length),
  t AS (SELECT clip, lag_, min(frame) AS first, max(frame) AS last FROM inside WHERE diff <= 2 * mid GROUP BY clip, lag_),
  s AS (SELECT *, last - first + 1 AS length, (last - first + 1 + lag_) // lag_ AS laps FROM t WHERE last - first + 1 >= lag_),
  size AS (SELECT clip, count(*) AS n, min(frame) AS zero FROM f GROUP BY clip)
  SELECT s.clip, s.first - zero AS intro, s.lag_ AS period, laps, greatest(0, n - (s.first - zero) - laps * s.lag_) AS tail,
    (SELECT round(avg(diff), 6) FROM p WHERE p.clip = s.clip AND p.lag_ = s.lag_ AND p.frame BETWEEN s.first AND s.last) AS copies,
    (SELECT round(avg(motion), 6) FROM moved m WHERE m.clip = s.clip AND m.frame >= s.first AND m.frame < s.first + s.lag_) AS motion
  FROM s JOIN size ON size.clip = s.clip""")
def loop_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["intro", "period", "laps", "tail", "copies", "motion"]

    def run(clip: int, _: int, m: np.ndarray) -> pd.DataFrame:
        got = loops.loop(m, LEAST, MOST, ABSOLUTE, RELATIVE)
        return pd.DataFrame([(clip, *(got[n] for n in names))] if got else [], columns=["clip", *names])

    found = loops.by_clip(adapters.packed(spark, sf_dir), run, "clip bigint, intro bigint, period bigint, laps bigint, tail bigint, copies double, motion double")
    return found.withColumns({n: F.round(n, 6) for n in ("copies", "motion")})


ZONES = f"""cell AS (SELECT clip, frame, unnest(c) AS v, unnest(range(0, 64)) AS i FROM f),
  zone AS (SELECT clip, frame, (i // 16) * 4 + (i % 8) // 2 AS z, i, v FROM cell),
  zn AS (SELECT a.clip, a.frame, a.z, sum(abs(a.v - b.v)) AS diff FROM zone a JOIN zone b ON a.clip = b.clip AND a.i = b.i AND b.frame = a.frame + 1 GROUP BY a.clip, a.frame, a.z),
  zt AS (SELECT * FROM zn UNION ALL SELECT n.clip, n.frame + 1, z, diff FROM zn n JOIN (SELECT clip, max(frame) AS frame FROM f GROUP BY clip) l ON l.clip = n.clip AND n.frame = l.frame - 1),
  zm AS (SELECT clip, frame, z, median(diff) OVER (PARTITION BY clip, z ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS motion FROM zt),
  zp AS (SELECT a.clip, b.frame - a.frame AS lag_, a.frame, a.z, sum(abs(a.v - b.v)) AS diff FROM zone a JOIN zone b ON a.clip = b.clip AND a.i = b.i AND b.frame - a.frame BETWEEN {ZONE_LEAST} AND {ZONE_MOST} GROUP BY ALL),
  ze AS (SELECT zp.clip, lag_, zp.frame, zp.z FROM zp JOIN zm ON zm.clip = zp.clip AND zm.frame = zp.frame AND zm.z = zp.z WHERE diff <= {ZONE_ABSOLUTE} AND diff <= {ZONE_RELATIVE}::DOUBLE * motion),
  zo AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip, lag_, z ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS opens FROM ze),
  zg AS (SELECT *, sum(opens) OVER (PARTITION BY clip, lag_, z ORDER BY frame) AS run FROM zo),
  zl AS (SELECT clip, lag_, z, max(length) AS length FROM (SELECT clip, lag_, z, run, max(frame) - min(frame) + 1 AS length FROM zg GROUP BY ALL) GROUP BY ALL),
  size AS (SELECT clip, count(*) AS n FROM f GROUP BY clip),
  za AS (SELECT zl.clip, lag_, z FROM zl JOIN size ON size.clip = zl.clip WHERE length >= greatest(lag_, (n - lag_) // 2)),
  area AS (SELECT clip, lag_, count(*) AS zones FROM za GROUP BY ALL),
  first_ AS (SELECT clip, min(lag_) AS lag_ FROM (SELECT *, max(zones) OVER (PARTITION BY clip) AS best FROM area) WHERE zones > best - 1 GROUP BY clip)"""


def zones_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, period, zone) of the zones that repeat with the clip's least eligible period."""
    cell = np.arange(64)
    zone = cell // 16 * 4 + cell % 8 // 2

    def run(clip: int, _: int, m: np.ndarray) -> pd.DataFrame:
        got = loops.zone_loop(m, zone, ZONE_LEAST, ZONE_MOST, ZONE_ABSOLUTE, ZONE_RELATIVE)
        return pd.DataFrame([(clip, got[0], int(z)) for z in np.flatnonzero(got[1])] if got else [], columns=["clip", "period", "zone"])

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "clip bigint, period bigint, zone bigint")


@query("zone_loops", f"WITH {FRAMES}, {ZONES} SELECT za.clip, za.lag_ AS period, CAST(z AS BIGINT) AS zone FROM za JOIN first_ ON first_.clip = za.clip AND first_.lag_ = za.lag_")
def zone_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones_of(spark, sf_dir)


@query("first_eligible_period", f"WITH {FRAMES}, {ZONES} SELECT area.clip, area.lag_ AS period, round(zones / 16, 6) AS area FROM area JOIN first_ ON first_.clip = area.clip AND first_.lag_ = area.lag_")
def first_eligible_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones_of(spark, sf_dir).groupBy("clip", "period").agg(F.round(F.count("*") / 16, 6).alias("area"))


@query("loop_seam_percentile", f"""WITH {FRAMES}, start AS (SELECT clip, frame AS first FROM f WHERE frame % 250 % 25 = 0),
  seam AS (SELECT s.clip, s.first, list_sum(list_transform(list_zip(a.c, b.c), lambda x: abs(x[1] - x[2]))) AS jump FROM start s JOIN f a ON a.frame = s.first JOIN f b ON b.clip = s.clip AND b.frame = s.first + 24),
  near AS (SELECT s.clip, s.first, list_sum(list_transform(list_zip(a.c, b.c), lambda x: abs(x[1] - x[2]))) AS diff FROM start s JOIN f a ON a.frame >= s.first AND a.frame < s.first + 24 JOIN f b ON b.clip = s.clip AND b.frame = a.frame + 1)
  SELECT s.first, CAST(jump AS BIGINT) AS jump, round(100.0::DOUBLE * count_if(diff < jump) / count(*), 6) AS percentile, median(diff) AS typical FROM seam s JOIN near n ON n.first = s.first GROUP BY s.first, jump""")
def loop_seam_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of loops of 25 frames: the jump from the last to the first among the jumps inside."""

    def run(_: int, zero: int, m: np.ndarray) -> pd.DataFrame:
        out = []
        for a in range(0, len(m) - 24, 25):
            part = m[a : a + 25]
            near, jump = loops.differences(part, 1), int(np.abs(part[0] - part[-1]).sum())
            out.append((zero + a, jump, 100.0 * int((near < jump).sum()) / len(near), float(np.median(near))))
        return pd.DataFrame(out, columns=["first", "jump", "percentile", "typical"])

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "first bigint, jump bigint, percentile double, typical double").withColumn("percentile", F.round("percentile", 6))
