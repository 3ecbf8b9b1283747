"""Frames by colour, gamut, reserved colours, tiles, overlays and slots, each with SQL of another form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colour
from tessera.operators import frames, scenes
from tessera.plans.registry import query
from tessera.session import ship
from tessera.sources import adapters

#: The 21 colours of a frame as a grid.
COLUMNS = 7
#: The colours of indices 224 to 254 that patches may use.
RESERVED = (
    (128, 0, 0), (255, 0, 0), (255, 128, 128), (128, 64, 0), (255, 128, 0), (255, 255, 0), (128, 128, 0), (0, 128, 0),
    (0, 255, 0), (128, 255, 128), (0, 128, 128), (0, 255, 255), (0, 0, 128), (0, 0, 255), (128, 128, 255), (128, 0, 128),
    (255, 0, 255), (255, 128, 192), (255, 224, 189), (141, 85, 36), (192, 192, 192), (255, 215, 0), (16, 16, 30), (64, 64, 74),
    (113, 113, 124), (161, 161, 173), (209, 209, 220), (255, 255, 255), (255, 200, 0), (0, 200, 0), (200, 0, 0),
)
#: Coverage over which each band begins.
COVERAGE = ((21, 247), (74, 248), (127, 249), (180, 250), (233, 251))

LAB = f"lab AS (SELECT frame, px, r, g, b, {colour.sql_oklab()} FROM {{pixels}})"
HIST = f"""{LAB}, spot AS (SELECT frame, least(1.0, greatest(0.0, ok_l)) * 11 AS pl, least(1.0, greatest(0.0, (ok_a + 0.4::DOUBLE) / 0.8::DOUBLE)) * 9 AS pa, least(1.0, greatest(0.0, (ok_b + 0.4::DOUBLE) / 0.8::DOUBLE)) * 9 AS pb FROM lab),
  corner AS (SELECT frame, least(11, floor(pl) + ul) * 100 + least(9, floor(pa) + ua) * 10 + least(9, floor(pb) + ub) AS bin,
    (CASE ul WHEN 1 THEN pl - floor(pl) ELSE 1 - pl + floor(pl) END) * (CASE ua WHEN 1 THEN pa - floor(pa) ELSE 1 - pa + floor(pa) END) * (CASE ub WHEN 1 THEN pb - floor(pb) ELSE 1 - pb + floor(pb) END) AS w
    FROM spot, (VALUES (0), (1)) AS x(ul), (VALUES (0), (1)) AS y(ua), (VALUES (0), (1)) AS z(ub)),
  hist AS (SELECT frame, CAST(bin AS BIGINT) AS bin, sum(w) / 21 AS share FROM corner GROUP BY ALL)"""
DESC = """luma AS (SELECT frame, px, (77 * r + 150 * g + 29 * b) >> 8 AS y FROM {pixels}),
  steps AS (SELECT a.frame, abs(a.y - b.y) AS d FROM luma a JOIN luma b ON a.frame = b.frame AND ((b.px = a.px + 1 AND a.px % 7 < 6) OR b.px = a.px + 7)),
  gradient AS (SELECT frame, avg(d) / 255 AS gradient FROM steps GROUP BY frame),
  mean AS (SELECT frame, avg(ok_l) AS ml, avg(ok_a) AS ma, avg(ok_b) AS mb FROM lab GROUP BY frame),
  des AS (SELECT m.frame, ml, ma, mb, gradient FROM mean m JOIN gradient g ON g.frame = m.frame)"""
SCORES = """pair AS (SELECT a.frame AS i, b.frame AS j FROM des a JOIN des b ON b.frame > a.frame AND b.frame <= a.frame + 10 AND floor(a.frame / 250) = floor(b.frame / 250)),
  sides AS (SELECT i, j, bin, share AS s, 0.0::DOUBLE AS t FROM pair JOIN hist ON frame = i UNION ALL SELECT i, j, bin, 0.0::DOUBLE, share FROM pair JOIN hist ON frame = j),
  far AS (SELECT i, j, least(1.0, sqrt(sum((sqrt(s) - sqrt(t)) * (sqrt(s) - sqrt(t))) / 2)) AS distribution FROM (SELECT i, j, bin, sum(s) AS s, sum(t) AS t FROM sides GROUP BY ALL) GROUP BY i, j),
  score AS (SELECT i, j, distribution, least(1.0, sqrt(pow(a.ml - b.ml, 2) + pow(a.ma - b.ma, 2) + pow(a.mb - b.mb, 2)) / 0.55::DOUBLE) AS mean, least(1.0, abs(a.gradient - b.gradient) / 0.25::DOUBLE) AS gradient FROM far JOIN des a ON a.frame = i JOIN des b ON b.frame = j),
  d AS (SELECT *, 0.68::DOUBLE * distribution + 0.27::DOUBLE * mean + 0.05::DOUBLE * gradient AS score FROM score)"""


def described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = adapters.pixels(spark, sf_dir)
    return scenes.histogram(p), scenes.described(p, COLUMNS)


@query("soft_histogram", f"WITH {HIST} SELECT frame, bin, round(share, 6) AS share FROM hist WHERE share >= 0.000001")
def soft_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir)[0].filter("share >= 0.000001").withColumn("share", F.round("share", 6))


@query("hellinger_change", f"WITH {HIST}, {DESC}, {SCORES} SELECT j AS frame, round(distribution, 6) AS distribution, round(mean, 6) AS mean, round(gradient, 6) AS gradient, round(score, 6) AS score FROM d WHERE j = i + 1")
def hellinger_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scenes.change(*described(spark, sf_dir), adapters.CLIP)
    return got.withColumns({c: F.round(c, 6) for c in ("distribution", "mean", "gradient", "score")})


#: The given frames change all the time, so that other limits than the usual ones show all reasons.
HARD, SLOW = 0.20, 0.145


@query("adaptive_blocks", f"""WITH RECURSIVE {HIST}, {DESC}, {SCORES}, near AS (SELECT j AS frame, score FROM d WHERE j = i + 1),
  walk AS (SELECT CAST(floor(frame / 250) AS BIGINT) AS clip, frame, frame AS first, 'start-of-stream' AS reason, 1.0::DOUBLE AS score, true AS opens FROM des WHERE frame % 250 = 0
    UNION ALL SELECT clip, frame, CASE WHEN reason IS NULL THEN first ELSE frame END, reason, CASE reason WHEN 'hard-cut' THEN near ELSE far END, reason IS NOT NULL
    FROM (SELECT w.clip, n.frame, w.first, n.score AS near, d.score AS far, CASE WHEN n.score >= {HARD} THEN 'hard-cut' WHEN n.frame - w.first >= 10 THEN 'max-frames' WHEN n.frame - w.first >= 5 AND d.score >= {SLOW} THEN 'color-drift' END AS reason
      FROM walk w JOIN near n ON n.frame = w.frame + 1 JOIN d ON d.i = w.first AND d.j = n.frame)),
  size AS (SELECT first, count(*) AS frames FROM walk GROUP BY first)
  SELECT clip, w.first, frames, reason, round(score, 6) AS score, round(CASE WHEN reason IN ('hard-cut', 'start-of-stream') THEN 0 WHEN score <= 0.06 THEN 0.25 WHEN score >= 0.42 THEN 0 ELSE 0.25 * (1 - (score - 0.06) / 0.36) END, 6)::DOUBLE AS stability
  FROM walk w JOIN size s ON s.first = w.first WHERE opens""")
def adaptive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scenes.blocks(*described(spark, sf_dir), adapters.CLIP, cut=HARD, drift=SLOW)
    return got.withColumns({c: F.round(c, 6) for c in ("score", "stability")})


@query("spatial_trellis", """
WITH c AS (SELECT frame, (y // 4) * 2 + x // 4 AS tile, value // 16 AS idx, value AS target FROM {cells}),
n AS (SELECT frame, tile, idx, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY frame, tile) AS kinds, row_number() OVER (PARTITION BY frame, tile ORDER BY n, idx) AS rank FROM n),
rare AS (SELECT frame, tile, idx AS rare, n FROM k WHERE kinds IN (3, 5, 17) AND rank = 1),
j AS (SELECT r.frame, r.tile, rare, o.idx AS into_, r.n, max(abs(o.idx * 16 + 8 - target) - abs(rare * 16 + 8 - target)) AS worst
  FROM rare r JOIN n o ON o.frame = r.frame AND o.tile = r.tile AND o.idx <> rare JOIN c ON c.frame = r.frame AND c.tile = r.tile AND c.idx = rare GROUP BY ALL)
SELECT frame, tile, rare, into_, worst, n AS cells FROM (SELECT *, row_number() OVER (PARTITION BY frame, tile ORDER BY worst, into_) AS best FROM j) WHERE best = 1 AND worst <= 14""")
def spatial_trellis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices are 16 grey levels, targets the cells' own values, tiles 4 x 4, the budget 14."""
    c = adapters.cells(spark, sf_dir).select("frame", (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).alias("tile"), F.struct(F.floor(F.col("value") / 16).cast("int").alias("index"), F.col("value").cast("int").alias("target")).alias("v"))
    tiles = c.groupBy("frame", "tile").agg(F.collect_list("v").alias("values"))
    palette = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: k * 16 + 8)
    big = lambda c, n=None: F.col(c).cast("bigint").alias(n or c)
    return scenes.merge_rare(tiles, palette, 14).select("frame", "tile", big("rare"), big("into", "into_"), big("worst"), big("cells"))


def bleed_sql() -> str:
    steps = ["s0 AS (SELECT frame, x, y, CASE WHEN value >= 140 THEN value END AS v FROM {cells})"]
    for k in range(1, 9):
        steps.append(f"""s{k} AS (SELECT a.frame, a.x, a.y, coalesce(a.v, (sum(b.v) + count(b.v) // 2) // nullif(count(b.v), 0)) AS v
  FROM s{k - 1} a LEFT JOIN s{k - 1} b ON a.v IS NULL AND b.frame = a.frame AND b.v IS NOT NULL AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.frame, a.x, a.y, a.v)""")
    return "WITH " + ", ".join(steps) + " SELECT frame, y * 8 + x AS cell, CAST(v AS BIGINT) AS value FROM s8"


@query("colour_bleed", bleed_sql())
def colour_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under 140 count as unknown; null is what eight steps don't reach."""
    p = adapters.packed(spark, sf_dir)
    known = F.transform("cells", lambda v: F.when(v >= 140, v))
    return p.select("frame", F.posexplode(scenes.bleed(known, 8)).alias("cell", "value")).select("frame", F.col("cell").cast("bigint").alias("cell"), F.col("value").cast("bigint").alias("value"))


@query("banding_proxy", """
WITH m AS (SELECT frame, x // 2 AS bx, y // 2 AS bw, avg(value) AS v, avg(value - value % 16) AS q FROM {cells} GROUP BY ALL),
n AS (SELECT a.frame, abs(a.v - b.v) AS dv, abs(a.q - b.q) AS dq FROM m a JOIN m b ON a.frame = b.frame AND ((b.bx = a.bx + 1 AND b.bw = a.bw) OR (b.bx = a.bx AND b.bw = a.bw + 1)))
SELECT frame, count(*) AS positions, round(sum(greatest(0, dq - dv)), 6) AS extra FROM n WHERE dv <= 12 GROUP BY frame""")
def banding_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra steps of 16 grey levels between means of 2 x 2 cells, along both axes, where the source steps by 12 at most."""
    block = (F.floor(F.col("y") / 2) * 4 + F.floor(F.col("x") / 2)).cast("int")
    means = adapters.cells(spark, sf_dir).groupBy("frame", block.alias("k")).agg(F.avg("value").alias("v"), F.avg(F.col("value") - F.col("value") % 16).alias("q"))
    rows = means.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("k", "v", "q"))).alias("m")).select("frame", F.col("m.v").alias("v"), F.col("m.q").alias("q"))
    step = lambda i, j: F.struct(F.abs(F.get("v", i) - F.get("v", j)).alias("dv"), F.abs(F.get("q", i) - F.get("q", j)).alias("dq"))
    places = F.sequence(F.lit(0), F.lit(15))
    near = F.concat(F.transform(F.filter(places, lambda i: i % 4 < 3), lambda i: step(i, i + 1)), F.transform(F.filter(places, lambda i: i < 12), lambda i: step(i, i + 4)))
    smooth = rows.select("frame", F.filter(near, lambda s: s["dv"] <= 12).alias("s")).filter(F.size("s") > 0)
    return smooth.select("frame", F.size("s").cast("bigint").alias("positions"), F.round(F.aggregate("s", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), s["dq"] - s["dv"])), 6).alias("extra"))


def gamut_sql() -> str:
    """Sixteen halvings written out, one subquery each."""
    inside = lambda k: " AND ".join(f"{c} >= 0 AND {c} <= 1" for c in colour.sql_linear_of("l", f"a * {k}", f"b * {k}"))
    steps = [f"{LAB}, wide AS (SELECT frame, px, least(1.0, greatest(0.0, ok_l)) AS l, ok_a * 6 AS a, ok_b * 6 AS b FROM lab), k0 AS (SELECT *, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, {inside('1')} AS fits FROM wide)"]
    steps += [f"k{n} AS (SELECT * EXCLUDE (lo, hi), CASE WHEN {inside('((lo + hi) * 0.5::DOUBLE)')} THEN (lo + hi) * 0.5::DOUBLE ELSE lo END AS lo, CASE WHEN {inside('((lo + hi) * 0.5::DOUBLE)')} THEN hi ELSE (lo + hi) * 0.5::DOUBLE END AS hi FROM k{n - 1})" for n in range(1, 17)]
    return "WITH " + ", ".join(steps) + " SELECT frame, px, fits, round(CASE WHEN fits THEN 1.0 ELSE lo END, 5) AS factor, round(a * CASE WHEN fits THEN 1.0 ELSE lo END, 5) AS ok_a, round(b * CASE WHEN fits THEN 1.0 ELSE lo END, 5) AS ok_b FROM k16"


@query("gamut_map", gamut_sql())
def gamut_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of six times the chroma, brought back into sRGB with lightness and hue kept."""
    lab = colour.with_oklab(adapters.pixels(spark, sf_dir), ["frame", "px"])
    wide = colour.once(lab, ["frame", "px"], l=F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l"))), a=F.col("a") * 6, b=F.col("b") * 6)
    got = colour.gamut_factor(wide, ("l", "a", "b"))
    return got.select("frame", "px", "fits", F.round("factor", 5).alias("factor"), F.round(F.col("a") * F.col("factor"), 5).alias("ok_a"), F.round(F.col("b") * F.col("factor"), 5).alias("ok_b"))


RESERVED_SQL = "reserved AS (SELECT idx, " + colour.sql_oklab() + " FROM (VALUES " + ", ".join(f"({224 + k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(RESERVED)) + ") AS t(idx, r, g, b))"


@query("reserved_nearest", f"""WITH {LAB}, {RESERVED_SQL}, k AS (SELECT frame, px, g, idx, row_number() OVER (PARTITION BY frame, px ORDER BY pow(lab.ok_l - t.ok_l, 2) + pow(lab.ok_a - t.ok_a, 2) + pow(lab.ok_b - t.ok_b, 2), idx) AS rank FROM lab, reserved t)
  SELECT frame, px, CAST(CASE WHEN g < 120 THEN 255 ELSE idx END AS BIGINT) AS reserved FROM k WHERE rank = 1""")
def reserved_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green stands for the alpha: under 120 a pixel is transparent."""
    table = spark.createDataFrame([(224 + k, *c) for k, c in enumerate(RESERVED)], "centre bigint, r bigint, g bigint, b bigint")
    names = ("ok_l", "ok_a", "ok_b")
    near = frames.nearest(colour.with_oklab(adapters.pixels(spark, sf_dir), ["frame", "px", "g"], names), colour.with_oklab(table, ["centre"], names), list(names))
    return near.select("frame", "px", F.when(F.col("g") < 120, 255).otherwise(F.col("centre")).cast("bigint").alias("reserved"))


@query("coverage_bands", "SELECT frame, cell, 246 + (value > 21)::INT + (value > 74)::INT + (value > 127)::INT + (value > 180)::INT + (value > 233)::INT AS band FROM (SELECT frame, cell, (value - 60) * 2 AS value FROM {cells})")
def coverage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = (F.col("value") - 60) * 2
    band = F.lit(246)
    for over, index in COVERAGE:
        band = F.when(cover > over, index).otherwise(band)
    return adapters.cells(spark, sf_dir).select("frame", "cell", band.alias("band"))


@query("byte_entropy", """WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
  c AS (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(bs) AS b FROM h) GROUP BY ALL), t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
  e AS (SELECT doc_id, -sum(n * log2(n / total)) / 8 AS bytes FROM t GROUP BY doc_id)
  SELECT h.doc_id, CAST(len(bs) AS BIGINT) AS n, floor(coalesce(bytes, 0) * 1000 + 0.5) / 1000 AS bytes FROM h LEFT JOIN e ON e.doc_id = h.doc_id""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-0 entropy of each text's bytes, in bytes: the cost estimate before deflating. One count of 256 a text."""
    ship(spark)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                n = np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256)
                n = n[n > 0]
                out.append((int(n.sum()), float(-(n * np.log2(n / n.sum())).sum() / 8) if len(n) else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "n", "bytes"])

    got = adapters.frame(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, bytes double")
    return got.withColumn("bytes", F.floor(F.col("bytes") * 1000 + 0.5) / 1000)


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"))


@query("slots_at_frame", "SELECT s.slot, e.vec_id AS frame, s.flag = 1 AND s.w = s.h AS shown FROM {slots} s JOIN {embeddings} e ON e.vec_id BETWEEN s.start AND s.stop")
def slots_at_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots at each frame of their interval; shown where the flag is set and the patch's size is the slot's."""
    s = adapters.slots(spark, sf_dir).select("slot", "start", "stop", ((F.col("flag") == 1) & (F.col("w") == F.col("h"))).alias("shown"))
    return frames.interval_join(frames_of(spark, sf_dir), "frame", s, "start", "stop").select("slot", "frame", "shown")


@query("run_length_expand", "SELECT s.slot, e.vec_id AS frame, e.vec_id - s.start AS place FROM {slots} s JOIN {embeddings} e ON e.vec_id >= s.start AND e.vec_id <= s.stop")
def run_length_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as rows, by counting them out; places without a frame go."""
    s = adapters.slots(spark, sf_dir).select("slot", "start", F.explode(F.sequence("start", "stop")).alias("frame"))
    return s.join(frames_of(spark, sf_dir), "frame").select("slot", "frame", (F.col("frame") - F.col("start")).alias("place"))


@query("slot_overlap_pairs", "SELECT a.scene, a.slot AS a, b.slot AS b FROM {slots} a JOIN {slots} b ON a.scene = b.scene AND a.slot < b.slot AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h AND a.start <= b.stop AND b.start <= a.stop")
def slot_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.overlaps(adapters.slots(spark, sf_dir), "scene", "slot")


def covered(spark: SparkSession, sf_dir: str, *key: str) -> DataFrame:
    """(frame, cell, dx, dy, w, last, key): cells under slots, of equal rectangles with equal keys the last slot alone."""
    s = adapters.slots(spark, sf_dir).withColumn("patch", F.col("slot") % 8)
    same = s.groupBy("x", "y", "w", "h", "start", "stop", *key).agg(F.max("slot").alias("last"))
    at = frames.interval_join(frames_of(spark, sf_dir), "frame", same, "start", "stop")
    return frames.covered_cells(at, 8, 8, "frame", "w", "last", *key)


@query("rectangle_mask", "SELECT DISTINCT c.frame, c.cell FROM {cells} c JOIN {slots} s ON s.start <= c.frame AND s.stop >= c.frame AND c.x >= s.x AND c.x < s.x + s.w AND c.y >= s.y AND c.y < s.y + s.h")
def rectangle_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir).select("frame", "cell").distinct()


@query("overlay_compose", """WITH k AS (SELECT c.frame, c.cell, s.slot, (s.slot % 8 + (c.x - s.x) + (c.y - s.y) * s.w) % 8 AS p FROM {cells} c JOIN {slots} s ON s.flag = 1 AND s.start <= c.frame AND s.stop >= c.frame AND c.x >= s.x AND c.x < s.x + s.w AND c.y >= s.y AND c.y < s.y + s.h),
  top AS (SELECT frame, cell, p FROM (SELECT *, row_number() OVER (PARTITION BY frame, cell ORDER BY slot DESC, p DESC) AS n FROM k WHERE p < 7) WHERE n = 1)
  SELECT c.frame, c.cell, coalesce(246 + p, value) AS shown FROM {cells} c LEFT JOIN top t ON t.frame = c.frame AND t.cell = c.cell""")
def overlay_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches painted over the cells in the order of slots; a patch's index 7 is transparent."""
    on = covered(spark, sf_dir, "patch", "flag").filter("flag = 1")
    paint = (F.col("patch") + F.col("dx") + F.col("dy") * F.col("w")) % 8
    top = on.withColumn("paint", paint).filter("paint < 7").groupBy("frame", "cell").agg(F.max(F.struct("last", "paint"))["paint"].alias("paint"))
    return adapters.cells(spark, sf_dir).join(top, ["frame", "cell"], "left").select("frame", "cell", F.coalesce(F.col("paint") + 246, "value").alias("shown"))
