"""Change reports, keyframes, predictors and replay over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import frames
from tessera.plans.registry import query, sql_query
from tessera.sources import adapters

LAGGED = "SELECT frame, cell, x, y, value, lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) AS before FROM {cells}"


@query("frame_change_report", f"""
WITH l AS ({LAGGED}),
p AS (SELECT frame, count(*) AS n, CAST(sum(CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM l GROUP BY frame),
s AS (SELECT *, n AS full_bytes, 2 + 3 * changed AS delta_bytes, CAST(ceil(n / 8) AS BIGINT) + changed AS mask_bytes FROM p)
SELECT frame, n, changed, round(changed / n, 6) AS share, frame % 15 = 0 AS keyframe, frame % 15 AS chain, full_bytes, delta_bytes, mask_bytes,
  CASE WHEN frame % 15 = 0 OR (full_bytes <= delta_bytes AND full_bytes <= mask_bytes) THEN 'FULL' WHEN delta_bytes <= mask_bytes THEN 'DELTA' ELSE 'MASK' END AS tag,
  CASE WHEN frame % 15 = 0 THEN full_bytes ELSE least(full_bytes, delta_bytes, mask_bytes) END AS bytes
FROM s""")
def frame_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.change_report(adapters.cells(spark, sf_dir))


@query("keyframe_asof", """
SELECT frame, CAST(max(CASE WHEN frame % 15 = 0 THEN frame END) OVER (PARTITION BY floor(frame / 250) ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS key_frame
FROM (SELECT DISTINCT frame FROM {cells})""")
def keyframe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = adapters.cells(spark, sf_dir).select(F.floor(F.col("frame") / adapters.CLIP).alias("clip"), "frame").distinct()
    keys = own.filter("frame % 15 = 0").select("clip", "frame", F.col("frame").alias("key_frame"))
    return frames.asof(own, keys, "frame", ["key_frame"], ["clip"]).select("frame", "key_frame")


sql_query("next_key_horizon", """
WITH f AS (SELECT DISTINCT frame FROM {cells}), n AS (
  SELECT frame, min(CASE WHEN frame % 15 = 0 THEN frame END) OVER (PARTITION BY floor(frame / 250) ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS k FROM f)
SELECT frame, CAST(CASE WHEN k - frame <= 10 THEN k END AS BIGINT) AS next_key FROM n""")

sql_query("delta_replay_last_value", f"""
WITH l AS ({LAGGED}), d AS (SELECT frame, cell, CAST(floor(frame / 15) AS BIGINT) AS key_group, CASE WHEN frame % 15 = 0 OR before IS NULL OR before <> value THEN value END AS written FROM l)
SELECT frame, cell, key_group, last_value(written IGNORE NULLS) OVER (PARTITION BY cell, key_group ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM d""")

for name, other, order in (("left", "lag(value) OVER (PARTITION BY frame, y ORDER BY x)", ""), ("top", "lag(value) OVER (PARTITION BY frame, x ORDER BY y)", ""), ("prev_sub", "lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame)", "")):
    sql_query(f"predictor_{name}", f"SELECT frame, cell, ((value - coalesce({other}, 0)) % 256 + 256) % 256 AS residual FROM {{cells}}")

sql_query("predictor_prev_xor",
    "SELECT frame, cell, value ^ coalesce(lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame), 0L) AS residual FROM {cells}",
    "SELECT frame, cell, xor(value, coalesce(lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame), 0)) AS residual FROM {cells}")

GRADIENT = """WITH a AS (SELECT frame, cell, x, y, value, coalesce(lag(value) OVER (PARTITION BY frame, y ORDER BY x), 0) AS l, coalesce(lag(value) OVER (PARTITION BY frame, x ORDER BY y), 0) AS t FROM {cells}),
b AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY frame, y ORDER BY x), 0) AS lt FROM a)"""
sql_query("predictor_gradient", GRADIENT + " SELECT frame, cell, ((value - (l + t - lt)) % 256 + 256) % 256 AS residual FROM b")

sql_query("predictor_choice", GRADIENT + """, r AS (SELECT frame, ((value - l) % 256 + 256) % 256 AS r1, ((value - t) % 256 + 256) % 256 AS r2, ((value - (l + t - lt)) % 256 + 256) % 256 AS r3 FROM b),
c AS (SELECT frame, CAST(sum(least(r1, 256 - r1)) AS BIGINT) AS left_cost, CAST(sum(least(r2, 256 - r2)) AS BIGINT) AS top_cost, CAST(sum(least(r3, 256 - r3)) AS BIGINT) AS gradient_cost FROM r GROUP BY frame)
SELECT frame, left_cost, top_cost, gradient_cost, CASE WHEN left_cost <= top_cost AND left_cost <= gradient_cost THEN 'LEFT' WHEN top_cost <= gradient_cost THEN 'TOP' ELSE 'GRADIENT' END AS chosen FROM c""")

sql_query("predictor_inverse_left", """
WITH r AS (SELECT frame, cell, x, y, value, ((value - coalesce(lag(value) OVER (PARTITION BY frame, y ORDER BY x), 0)) % 256 + 256) % 256 AS residual FROM {cells})
SELECT frame, cell, value, CAST(sum(residual) OVER (PARTITION BY frame, y ORDER BY x) % 256 AS BIGINT) AS restored FROM r""")

sql_query("predictor_inverse_gradient", GRADIENT + """, r AS (SELECT frame, cell, x, y, value, ((value - (l + t - lt)) % 256 + 256) % 256 AS residual FROM b),
s AS (SELECT *, CAST(sum(residual) OVER (PARTITION BY frame, y ORDER BY x) AS BIGINT) AS row_sum FROM r)
SELECT frame, cell, value, CAST(sum(row_sum) OVER (PARTITION BY frame, x ORDER BY y) % 256 AS BIGINT) AS restored FROM s""")

sql_query("keyframe_schedule", f"""
WITH l AS ({LAGGED}), f AS (SELECT frame, CAST(sum(abs(value - coalesce(before, value))) AS BIGINT) AS moved FROM l GROUP BY frame),
k AS (SELECT frame, moved, moved > 1250 AS hard_cut, frame % 15 = 0 OR moved > 1250 AS is_key FROM f),
g AS (SELECT *, CAST(sum(CASE WHEN is_key THEN 1 ELSE 0 END) OVER (PARTITION BY floor(frame / 250) ORDER BY frame) AS BIGINT) AS key_group FROM k)
SELECT frame, moved, hard_cut, is_key, key_group, row_number() OVER (PARTITION BY floor(frame / 250), key_group ORDER BY frame) - 1 AS chain FROM g""")

sql_query("tag_counts", f"""
WITH l AS ({LAGGED}), p AS (SELECT frame, CAST(sum(CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM l GROUP BY frame),
t AS (SELECT frame, changed, CASE WHEN frame % 15 = 0 THEN 'FULL' WHEN 2 + 3 * changed <= 8 + changed THEN 'DELTA' WHEN 8 + changed < 64 THEN 'MASK' ELSE 'FULL' END AS tag FROM p)
SELECT tag, count(*) AS frames, CAST(sum(CASE tag WHEN 'FULL' THEN 64 WHEN 'DELTA' THEN 2 + 3 * changed ELSE 8 + changed END) AS BIGINT) AS bytes, round(avg(changed), 6) AS mean_changed, CAST(max(frame % 15) AS BIGINT) AS longest_chain FROM t GROUP BY tag""")

sql_query("palette_block_inference", """
WITH e AS (SELECT vec_id AS frame, CAST(label AS BIGINT) AS palette, lag(label) OVER (PARTITION BY floor(vec_id / 250) ORDER BY vec_id) AS before FROM {embeddings}),
b AS (SELECT frame, palette, CAST(sum(CASE WHEN before IS NULL OR before <> palette THEN 1 ELSE 0 END) OVER (PARTITION BY floor(frame / 250) ORDER BY frame) AS BIGINT) AS block FROM e)
SELECT CAST(floor(frame / 250) AS BIGINT) AS clip, block, palette, min(frame) AS first, max(frame) + 1 AS stop, count(*) AS frames FROM b GROUP BY CAST(floor(frame / 250) AS BIGINT), block, palette""")

sql_query("fixed_blocks", """
SELECT CAST(floor(frame / 30) AS BIGINT) AS block, min(frame) AS first, max(frame) AS last, count(DISTINCT frame) AS frames, round(avg(value), 6) AS mean_value FROM {cells} GROUP BY CAST(floor(frame / 30) AS BIGINT)""")


sql_query("dirty_union", f"""
WITH l AS ({LAGGED}), d AS (SELECT DISTINCT frame, y FROM l WHERE before <> value UNION SELECT DISTINCT frame + 1 AS frame, y FROM l WHERE before <> value)
SELECT frame, count(*) AS rows_dirty, min(y) AS y0, max(y) AS y1 FROM d GROUP BY frame""")

sql_query("trellis_one_step", f"""
WITH l AS ({LAGGED}) SELECT frame, cell, CASE WHEN before IS NOT NULL AND abs(value - before) <= 6 THEN before ELSE value END AS emitted, CASE WHEN before IS NOT NULL AND value <> before AND abs(value - before) <= 6 THEN 1 ELSE 0 END AS held FROM l""")
