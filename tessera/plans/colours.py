"""Palettes, colour spaces, nearest centres and colour aggregates over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colour
from tessera.operators import frames
from tessera.plans.registry import query, sql_query
from tessera.sources import adapters

PALETTE = """palette AS (SELECT CAST(label AS BIGINT) AS idx, CAST(floor(avg(r)) AS BIGINT) AS pr, CAST(floor(avg(g)) AS BIGINT) AS pg, CAST(floor(avg(b)) AS BIGINT) AS pb
FROM {pixels} AS p JOIN {embeddings} AS e ON p.frame = e.vec_id GROUP BY label)"""
LUMA = "CAST(floor((77 * r + 150 * g + 29 * b) / 256) AS BIGINT)"
CENTRES = [(k, (37 * k) % 256, (91 * k + 40) % 256, (153 * k + 90) % 256) for k in range(16)]
CENTRES_SQL = "centres AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in CENTRES) + ") AS t(centre, cr, cg, cb))"
NEAR = CENTRES_SQL + """, d AS (SELECT frame, px, r, g, b, CAST(centre AS BIGINT) AS centre, CAST((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb) AS BIGINT) AS distance FROM {pixels} CROSS JOIN centres),
k AS (SELECT *, row_number() OVER (PARTITION BY frame, px ORDER BY distance, centre) AS rank FROM d), near AS (SELECT frame, px, r, g, b, centre, distance FROM k WHERE rank = 1)"""


def centre_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CENTRES, "centre bigint, r bigint, g bigint, b bigint")


def nearest_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.nearest(adapters.pixels(spark, sf_dir), centre_frame(spark), ["r", "g", "b"])


sql_query("palette_lookup_rgb", f"WITH {PALETTE}, c AS (SELECT frame, cell, value % 10 AS idx FROM {{cells}}) SELECT frame, cell, c.idx AS idx, pr, pg, pb FROM c JOIN palette ON c.idx = palette.idx")
sql_query("palette_band", f"WITH {PALETTE}, c AS (SELECT frame, cell, y, value % 10 AS idx FROM {{cells}} WHERE y >= 2 AND y <= 4) SELECT frame, cell, pr * 65536 + pg * 256 + pb AS packed FROM c JOIN palette ON c.idx = palette.idx")
sql_query("palette_dirty_only", f"""WITH {PALETTE}, l AS (SELECT frame, cell, value % 10 AS idx, lag(value % 10) OVER (PARTITION BY floor(frame / 250), cell ORDER BY frame) AS before FROM {{cells}})
SELECT frame, cell, pr, pg, pb FROM l JOIN palette ON l.idx = palette.idx WHERE before IS NULL OR before <> l.idx""")
sql_query("palette_packed_lut", f"WITH {PALETTE}, c AS (SELECT DISTINCT value AS idx FROM {{cells}}) SELECT c.idx AS idx, coalesce(4278190080 + pb * 65536 + pg * 256 + pr, 4278190080) AS packed FROM c LEFT JOIN palette ON c.idx = palette.idx")


@query("palette_asof", """
WITH e AS (SELECT vec_id AS frame, CAST(label AS BIGINT) AS label, lag(label) OVER (PARTITION BY floor(vec_id / 250) ORDER BY vec_id) AS before FROM {embeddings}),
m AS (SELECT frame, CASE WHEN before IS NULL OR before <> label THEN label END AS emitted FROM e)
SELECT frame, last_value(emitted IGNORE NULLS) OVER (PARTITION BY floor(frame / 250) ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS palette FROM m""")
def palette_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("bigint").alias("palette"))
    e = e.withColumn("clip", F.floor(F.col("frame") / adapters.CLIP))
    changed = frames.previous(e, ["clip"], "frame", "palette").filter("before IS NULL OR before <> palette").select("clip", "frame", "palette")
    return frames.asof(e.select("clip", "frame"), changed, "frame", ["palette"], ["clip"]).select("frame", "palette")


sql_query("planes_to_cells", "SELECT frame, CAST(floor(cell / 2) AS BIGINT) AS place, max(CASE WHEN cell % 2 = 0 THEN value END) AS glyph, max(CASE WHEN cell % 2 = 1 THEN value END) AS colour FROM {cells} GROUP BY frame, CAST(floor(cell / 2) AS BIGINT)")
sql_query("ramp_index", "SELECT frame, cell, least(9, greatest(0, CAST(floor(value * 10 / 256) AS BIGINT))) AS ramp, substr(' .:-=+*#%@', CAST(least(9, greatest(0, floor(value * 10 / 256))) AS INT) + 1, 1) AS glyph FROM {cells}")
sql_query("frame_cells_by_mode", f"SELECT frame, px, frame % 4 AS mode, CASE frame % 4 WHEN 0 THEN CAST(floor({LUMA} * 10 / 256) AS BIGINT) WHEN 1 THEN {LUMA} WHEN 2 THEN CAST(floor(r / 8) * 1024 + floor(g / 8) * 32 + floor(b / 8) AS BIGINT) ELSE r * 65536 + g * 256 + b END AS cell_value FROM {{pixels}}")


@query("integer_luma", f"SELECT frame, px, {LUMA} AS luma FROM {{pixels}}")
def integer_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.pixels(spark, sf_dir).select("frame", "px", colour.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


sql_query("bt709_limited", """
WITH f AS (SELECT frame, px, 16 + (2126e-4 * r + 7152e-4 * g + 722e-4 * b) * 219 / 255.0 AS yf, r, g, b FROM {pixels})
SELECT frame, px, CAST(least(235, greatest(16, floor(yf + 0.5))) AS BIGINT) AS y709, round(128 + (b - (2126e-4 * r + 7152e-4 * g + 722e-4 * b)) / 18556e-4 * 224 / 255.0, 6) AS cb, round(128 + (r - (2126e-4 * r + 7152e-4 * g + 722e-4 * b)) / 15748e-4 * 224 / 255.0, 6) AS cr FROM f""")


@query("oklab_convert", f"SELECT frame, px, round(ok_l, 6) AS ok_l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b FROM (SELECT frame, px, {colour.sql_oklab()} FROM {{pixels}})")
def oklab_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = colour.oklab(F.col("r"), F.col("g"), F.col("b"))
    return adapters.pixels(spark, sf_dir).select("frame", "px", *[F.round(c, 6).alias(n) for c, n in zip(lab, ("ok_l", "ok_a", "ok_b"), strict=True)])


@query("oklab_round_trip", "SELECT frame, px, r, g, b FROM {pixels}")
def oklab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.pixels(spark, sf_dir)
    lab = p.select("frame", "px", *[c.alias(n) for c, n in zip(colour.oklab(F.col("r"), F.col("g"), F.col("b")), "lmn", strict=True)])
    return colour.from_oklab(lab, ("l", "m", "n")).select("frame", "px", "r", "g", "b")


sql_query("colour_keys", "SELECT frame, px, r * 65536 + g * 256 + b AS key24, CAST(floor(r / 8) * 1024 + floor(g / 8) * 32 + floor(b / 8) AS BIGINT) AS key15 FROM {pixels}")


@query("nearest_center", f"WITH {NEAR} SELECT frame, px, centre, distance FROM near")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_pixels(spark, sf_dir).select("frame", "px", "centre", "distance")


@query("lut_quantize", CENTRES_SQL.join(["WITH ", ""]) + """, u AS (SELECT DISTINCT CAST(floor(r / 16) AS BIGINT) AS kr, CAST(floor(g / 16) AS BIGINT) AS kg, CAST(floor(b / 16) AS BIGINT) AS kb FROM {pixels}),
d AS (SELECT kr, kg, kb, CAST(centre AS BIGINT) AS centre, (kr * 16 + 8 - cr) * (kr * 16 + 8 - cr) + (kg * 16 + 8 - cg) * (kg * 16 + 8 - cg) + (kb * 16 + 8 - cb) * (kb * 16 + 8 - cb) AS d FROM u CROSS JOIN centres),
l AS (SELECT kr, kg, kb, centre FROM (SELECT *, row_number() OVER (PARTITION BY kr, kg, kb ORDER BY d, centre) AS k FROM d) WHERE k = 1)
SELECT frame, px, centre FROM {pixels} JOIN l ON kr = floor(r / 16) AND kg = floor(g / 16) AND kb = floor(b / 16)""")
def lut_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.pixels(spark, sf_dir)
    keys = [F.floor(F.col(c) / 16).cast("bigint").alias(f"k{c}") for c in "rgb"]
    used = p.select(*keys).distinct().select("kr", "kg", "kb", *[(F.col(f"k{c}") * 16 + 8).alias(c) for c in "rgb"])
    lut = frames.nearest(used, centre_frame(spark), ["r", "g", "b"]).select("kr", "kg", "kb", "centre")
    return p.select("frame", "px", *keys).join(F.broadcast(lut), ["kr", "kg", "kb"]).select("frame", "px", "centre")  # at most 16 ** 3 rows


@query("kmeans_step", f"WITH {NEAR} SELECT centre, count(*) AS n, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, CAST(sum(distance) AS BIGINT) AS inertia FROM near GROUP BY centre")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.round(F.avg(c), 6).alias(c) for c in "rgb"]
    return nearest_pixels(spark, sf_dir).groupBy("centre").agg(F.count("*").alias("n"), *means, F.sum("distance").alias("inertia"))


sql_query("color_aggregate", "SELECT r * 65536 + g * 256 + b AS key24, count(*) AS weight, min(frame) AS first_frame FROM {pixels} GROUP BY r * 65536 + g * 256 + b")
sql_query("distinct_colours", "SELECT frame, count(DISTINCT r * 65536 + g * 256 + b) AS colours FROM {pixels} GROUP BY frame")
sql_query("canonical_palette_sort", f"WITH {PALETTE} SELECT idx, pr, pg, pb, row_number() OVER (ORDER BY pr, pg, pb, idx) - 1 AS place FROM palette")
sql_query("pair_search", f"WITH {CENTRES_SQL}, p AS (SELECT a.centre AS base, b.centre AS partner, k, abs(4 * 128 - ((4 - k) * a.cr + k * b.cr)) + abs(4 * 96 - ((4 - k) * a.cg + k * b.cg)) AS err FROM centres a CROSS JOIN centres b CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(k)) SELECT CAST(base AS BIGINT) AS base, CAST(partner AS BIGINT) AS partner, CAST(k AS BIGINT) AS coverage, CAST(err AS BIGINT) AS error FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY err, partner, k) AS rank FROM p) WHERE rank = 1")
sql_query("monotone_refit", f"WITH {NEAR}, m AS (SELECT centre, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, CAST(sum(distance) AS BIGINT) AS was FROM near GROUP BY centre), e AS (SELECT n.centre, sum((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb)) AS now, max(was) AS was FROM near n JOIN m ON n.centre = m.centre GROUP BY n.centre) SELECT centre, was, round(now, 4) AS now, now < was AS accepted FROM e")
sql_query("alpha_binarize", "SELECT frame, px, CASE WHEN g >= 128 THEN 255 ELSE 0 END AS alpha, CASE WHEN g >= 128 THEN r ELSE 16 END AS r, CASE WHEN g >= 128 THEN b ELSE 16 END AS b FROM {pixels}")
sql_query("alpha_composite", "SELECT frame, px, CAST(floor((g * r + (255 - g) * 128) / 255) AS BIGINT) AS over_gray FROM {pixels}")
sql_query("alpha_summary", "SELECT frame, CAST(sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) AS BIGINT) AS visible, CAST(sum(CASE WHEN g >= 140 THEN 1 ELSE 0 END) AS BIGINT) AS opaque, min(CASE WHEN g >= 140 THEN px END) AS first_opaque, max(CASE WHEN g >= 140 THEN px END) AS last_opaque, round(avg(r), 6) AS mean_r FROM {pixels} GROUP BY frame")
