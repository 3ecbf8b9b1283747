"""Loops, runs, gaps, seams, box sums, edges and quality measures along frames and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import frames
from tessera.plans.registry import query, sql_query
from tessera.sources import adapters

MOTION = "l AS (SELECT frame, cell, x, y, value, lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) AS before FROM {cells}), m AS (SELECT frame, CAST(sum(abs(value - before)) AS BIGINT) AS motion FROM l WHERE before IS NOT NULL GROUP BY frame)"
sql_query("zone_motion", f"WITH {MOTION} SELECT frame, CAST(floor(x / 4) AS BIGINT) AS zx, CAST(floor(y / 4) AS BIGINT) AS zy, round(avg(abs(value - before)), 6) AS motion FROM l WHERE before IS NOT NULL GROUP BY frame, CAST(floor(x / 4) AS BIGINT), CAST(floor(y / 4) AS BIGINT)")


@query("moving_median", f"WITH {MOTION} SELECT frame, round(median(motion) OVER (PARTITION BY floor(frame / 250) ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS median FROM m")
def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    moved = frames.previous(adapters.cells(spark, sf_dir)).filter("before IS NOT NULL").groupBy("frame").agg(F.sum(F.abs(F.col("value") - F.col("before"))).alias("motion"))
    near = F.array_sort(F.collect_list("motion").over(Window.partitionBy(F.floor(F.col("frame") / 250)).orderBy("frame").rowsBetween(-4, 4)))
    n = F.size("near")
    low, high = F.element_at("near", F.floor((n + 1) / 2).cast("int")), F.element_at("near", F.floor((n + 2) / 2).cast("int"))
    return moved.select("frame", near.alias("near")).select("frame", F.round((low + high) / 2, 6).alias("median"))


sql_query("empty_gaps", """
WITH e AS (SELECT frame, max(value) AS top FROM {cells} GROUP BY frame), f AS (SELECT frame FROM e WHERE top >= 168),
g AS (SELECT frame, lag(frame) OVER (PARTITION BY floor(frame / 250) ORDER BY frame) AS before FROM f)
SELECT before + 1 AS gap_start, frame - before - 1 AS gap_frames FROM g WHERE frame - before > 1""")
BOX = "b AS (SELECT frame, cell, x, y, value, sum(value) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rx FROM {cells}), c AS (SELECT frame, cell, value, CAST(sum(rx) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS box FROM b)"
sql_query("box_sum", f"WITH {BOX} SELECT frame, cell, box FROM c")
sql_query("box_error", f"WITH {BOX.replace('{cells}', '(SELECT frame, cell, x, y, value - (value - value % 8) AS value FROM {cells}) AS q')} SELECT frame, CAST(sum(box * box) AS BIGINT) AS low_frequency_error FROM c GROUP BY frame")
sql_query("edge_mask_dilated", """
WITH s AS (SELECT frame, cell, x, y, CASE WHEN abs(value - coalesce(lag(value) OVER (PARTITION BY frame, y ORDER BY x), value)) >= 24 OR abs(value - coalesce(lag(value) OVER (PARTITION BY frame, x ORDER BY y), value)) >= 24 THEN 1 ELSE 0 END AS edge FROM {cells}),
h AS (SELECT frame, cell, x, y, edge, max(edge) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM s)
SELECT frame, cell, edge, max(wide) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dilated FROM h""")
sql_query("gradient_weights", """
WITH g AS (SELECT frame, cell, coalesce(lead(value) OVER (PARTITION BY frame, y ORDER BY x), value) - coalesce(lag(value) OVER (PARTITION BY frame, y ORDER BY x), value) AS dx, coalesce(lead(value) OVER (PARTITION BY frame, x ORDER BY y), value) - coalesce(lag(value) OVER (PARTITION BY frame, x ORDER BY y), value) AS dy FROM {cells})
SELECT frame, cell, round(1 + 4 * least(1.0e0, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) / 64), 6) AS weight FROM g""")
sql_query("psnr_vs_quantized", "SELECT frame, CAST(sum((value % 8) * (value % 8)) AS BIGINT) AS sse, round(CASE WHEN sum((value % 8) * (value % 8)) = 0 THEN NULL ELSE 10 * log10(65025.0e0 * 64 / sum((value % 8) * (value % 8))) END, 6) AS psnr FROM {cells} GROUP BY frame")
sql_query("banding_plateaus", "WITH n AS (SELECT frame, value, lead(value) OVER (PARTITION BY frame, y ORDER BY x) AS right_ FROM {cells}) SELECT frame, CAST(sum(CASE WHEN abs(right_ - value) BETWEEN 1 AND 8 THEN 1 ELSE 0 END) AS BIGINT) AS smooth, CAST(sum(CASE WHEN abs(right_ - value) BETWEEN 1 AND 8 AND (right_ - right_ % 16) = (value - value % 16) THEN 1 ELSE 0 END) AS BIGINT) AS plateau FROM n WHERE right_ IS NOT NULL GROUP BY frame")
sql_query("temporal_error", "WITH l AS (SELECT frame, value, lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) AS before FROM {cells}) SELECT frame, round(avg(abs((value - value % 8) - (before - before % 8) - (value - before))), 6) AS temporal_error FROM l WHERE before IS NOT NULL GROUP BY frame")
sql_query("ripple_p95", f"WITH {BOX}, r AS (SELECT frame, abs(value * 9 - box) AS ripple FROM c WHERE value < 128), k AS (SELECT frame, ripple, row_number() OVER (PARTITION BY frame ORDER BY ripple) AS k, count(*) OVER (PARTITION BY frame) AS n FROM r) SELECT frame, max(n) AS dark, CAST(max(CASE WHEN k = CAST(floor((n - 1) * 95 / 100) AS BIGINT) + 1 THEN ripple END) AS BIGINT) AS p95 FROM k GROUP BY frame")
sql_query("luma_bias", "SELECT frame, round(CAST(sum(value - value % 8) - sum(value) AS DOUBLE) / count(*), 2) AS bias FROM {cells} GROUP BY frame")
sql_query("white_frames", "WITH f AS (SELECT frame, avg(value) AS mean, avg(CASE WHEN value >= 140 THEN 1.0e0 ELSE 0.0e0 END) AS white FROM {cells} GROUP BY frame) SELECT frame, round(mean, 6) AS mean, round(white, 6) AS white, white >= 0.3e0 AS near_white, round(abs(mean - lag(mean) OVER (PARTITION BY floor(frame / 250) ORDER BY frame)), 6) AS jump FROM f")
sql_query("top_whitest", "WITH f AS (SELECT frame, avg(value) AS mean FROM {cells} GROUP BY frame) SELECT frame, round(mean, 6) AS mean FROM f ORDER BY f.mean DESC, frame LIMIT 20")
sql_query("tile_selection", "WITH t AS (SELECT frame, CAST(floor(y / 4) * 2 + floor(x / 4) AS BIGINT) AS tile, value, row_number() OVER (PARTITION BY frame, floor(y / 4), floor(x / 4) ORDER BY value) AS k FROM {cells}) SELECT frame, tile, max(CASE WHEN k = 15 THEN value END) - max(CASE WHEN k = 1 THEN value END) AS range_, CAST(sum((value % 8) * (value % 8)) AS BIGINT) AS error FROM t GROUP BY frame, tile")
sql_query("hard_cuts", f"WITH {MOTION} SELECT frame, motion FROM m WHERE motion > 1250")
TILE = "t AS (SELECT frame, CAST(floor(y / 4) * 2 + floor(x / 4) AS BIGINT) AS tile, count(*) AS npix, count(DISTINCT value) AS kinds, CAST(sum(CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM (SELECT *, lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) AS before FROM (SELECT frame, cell, x, y, CASE WHEN value >= 156 THEN value - value % 16 ELSE 96 END AS value FROM {cells})) GROUP BY frame, CAST(floor(y / 4) * 2 + floor(x / 4) AS BIGINT))"
OPS = TILE + ", o AS (SELECT *, CASE WHEN changed = 0 THEN 'SKIP' WHEN kinds = 1 THEN 'SOLID' WHEN 2 + 2 * changed <= least(3 + CAST(ceil(npix / 8) AS BIGINT), 2 + CAST(ceil(npix / 8) AS BIGINT) + changed) THEN 'SPARSE' WHEN kinds = 2 THEN 'PACK1' WHEN kinds <= 4 THEN 'PACK2' WHEN kinds <= 16 AND kinds + CAST(ceil(npix / 2) AS BIGINT) < 1 + npix THEN 'PAL4' ELSE 'PAL8' END AS opcode FROM t)"
sql_query("tile_opcode_histogram", f"WITH {OPS} SELECT opcode, count(*) AS tiles, CAST(sum(changed) AS BIGINT) AS changed FROM o GROUP BY opcode")
sql_query("skip_runs", f"WITH {OPS}, s AS (SELECT frame, tile, tile - row_number() OVER (PARTITION BY frame ORDER BY tile) AS g FROM o WHERE opcode = 'SKIP') SELECT frame, min(tile) AS first_tile, count(*) AS run FROM s GROUP BY frame, g")
sql_query("tile_geometry", "SELECT frame, CAST(floor(y / 3) * 3 + floor(x / 3) AS BIGINT) AS tile, count(*) AS cells, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM {cells} GROUP BY frame, CAST(floor(y / 3) * 3 + floor(x / 3) AS BIGINT)")
sql_query("tile_size_sweep", "WITH s AS (SELECT * FROM (VALUES (2), (3), (4), (5), (8)) AS t(size)), b AS (SELECT frame, size, floor(y / size) AS ty, floor(x / size) AS tx, count(DISTINCT value) AS kinds, count(*) AS n FROM {cells} CROSS JOIN s GROUP BY frame, size, floor(y / size), floor(x / size)), c AS (SELECT frame, CAST(size AS BIGINT) AS size, CAST(sum(1 + least(n, kinds + ceil(n / 2))) AS BIGINT) AS bytes FROM b GROUP BY frame, size) SELECT frame, size, bytes FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY bytes, size) AS k FROM c) WHERE k = 1")
sql_query("change_mask_bytes", "WITH l AS (SELECT frame, cell, CASE WHEN lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) <> value THEN 1 ELSE 0 END AS changed FROM {cells}) SELECT frame, CAST(floor(cell / 8) AS BIGINT) AS byte_, CAST(sum(changed * CAST(pow(2, cell % 8) AS BIGINT)) AS BIGINT) AS mask FROM l GROUP BY frame, CAST(floor(cell / 8) AS BIGINT)")
sql_query("sparse_offset_delta", "WITH l AS (SELECT frame, cell, value, lag(value) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) AS before FROM {cells}), c AS (SELECT frame, cell, value FROM l WHERE before <> value) SELECT frame, cell, cell - coalesce(lag(cell) OVER (PARTITION BY frame ORDER BY cell), -1) - 1 AS delta, value FROM c")
sql_query("uvarint_length", "WITH v AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 100) AS BIGINT) AS v FROM {orders}) SELECT id, v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS bytes FROM v")
sql_query("bayer_dither", "SELECT frame, cell, CASE WHEN value % 16 > CAST(substr('00081002120414061303110115071309', CAST((y % 4) * 8 + (x % 4) * 2 + 1 AS INT), 2) AS BIGINT) THEN value - value % 16 + 16 ELSE value - value % 16 END AS dithered FROM {cells}")
sql_query("confetti", "WITH n AS (SELECT DISTINCT frame FROM {cells}), h AS (SELECT frame, cell, (frame * 1103515245 + cell * 12345 + 67890) % 2147483648 AS h FROM {cells}) SELECT frame, cell, h % 8 AS px, CAST(floor(h / 8) AS BIGINT) % 8 AS py, abs(CAST(floor(h / 64) AS BIGINT) % 64 - 32) AS wave FROM h")
sql_query("bilinear_sample", "SELECT frame, cell, round((value + coalesce(lead(value) OVER (PARTITION BY frame, y ORDER BY x), value)) / 2.0e0, 6) AS mixed FROM {cells}")
