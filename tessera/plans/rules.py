"""Rules, parsers, limits and playback plans. The plans parse texts; the SQL tells what went into these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.plans.registry import query
from tessera.sources import adapters


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("size"))


def pick(values: tuple, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def picked(values: tuple, k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(values)} = {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


PART = "p AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM {part})"


@query("grid_geometry", f"WITH {PART}, s AS (SELECT id, size, 10 + id % 50 AS w, CASE WHEN id % 11 = 0 THEN 70000 ELSE 80 END AS cols, CASE WHEN id % 7 = 0 THEN 45 ELSE 0 END AS fixed, CASE WHEN id % 4 = 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS f FROM p) SELECT id, CASE WHEN cols <= 65535 THEN CASE WHEN fixed > 0 THEN fixed ELSE greatest(1, CAST(round_even(cols * (size / w) * f, 0) AS BIGINT)) END END AS rows_ FROM s")
def grid_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = rules.grid_rows(10 + i % 50, F.col("size"), F.when(i % 11 == 0, 70000).otherwise(80), F.when(i % 7 == 0, 45).otherwise(0), i % 4 == 3, 0.5)
    return part(spark, sf_dir).select("id", rows.alias("rows_"))


@query("probe_pairs", f"WITH {PART} SELECT id, size * 16 AS width, size * 9 AS height, round(CASE WHEN id % 3 = 0 THEN size ELSE 30000 / (1000 + id % 7) END, 6)::DOUBLE AS fps, CASE WHEN id % 5 > 0 THEN 'yuv420p' END AS pix_fmt FROM p")
def probe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines key=value of a probe, some without a pixel format."""
    i, s = F.col("id"), F.col("size")
    fps = F.when(i % 3 == 0, s.cast("string")).otherwise(F.concat(F.lit("30000/"), (1000 + i % 7).cast("string")))
    text = F.concat(F.lit("width="), s * 16, F.lit("\nheight="), s * 9, F.lit("\nr_frame_rate="), fps, F.when(i % 5 > 0, "\npix_fmt=yuv420p").otherwise(""))
    told = part(spark, sf_dir).select("id", F.str_to_map(text, F.lit("\n"), F.lit("=")).alias("m"))
    return told.select("id", F.col("m")["width"].cast("bigint").alias("width"), F.col("m")["height"].cast("bigint").alias("height"), F.round(rules.rate(F.col("m")["r_frame_rate"]), 6).alias("fps"), F.col("m")["pix_fmt"].alias("pix_fmt"))


@query("fps_literal", f"WITH {PART} SELECT id, round(CASE id % 3 WHEN 0 THEN 30000 / (1000 + id % 7) WHEN 1 THEN size::DOUBLE ELSE size + 0.5 END, 6)::DOUBLE AS fps FROM p")
def fps_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("id"), F.col("size")
    text = F.when(i % 3 == 0, F.concat(F.lit("30000/"), (1000 + i % 7).cast("string"))).when(i % 3 == 1, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit(".5")))
    return part(spark, sf_dir).select("id", F.round(rules.rate(text), 6).alias("fps"))


@query("metric_log_parse", f"""WITH {PART} SELECT id, CASE WHEN id % 4 > 0 THEN '0.' || (1000 + size) ELSE '-' END AS ssim_y, CASE WHEN id % 4 > 0 THEN '0.9' || size ELSE '-' END AS ssim_all,
  CASE WHEN id % 3 = 0 THEN '-' WHEN id % 5 = 0 THEN 'inf' ELSE size || '.25' END AS psnr, CASE WHEN id % 6 = 0 THEN 0 ELSE id + size END AS frames FROM p""")
def metric_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of an encoder's filters; some lack a part."""
    i, s = F.col("id"), F.col("size").cast("string")
    ssim = F.when(i % 4 > 0, F.concat(F.lit("[p] SSIM Y:0."), F.col("size") + 1000, F.when(i % 2 == 0, " (12.5)").otherwise(""), F.lit(" U:0.98 V:0.97 (9.1) All:0.9"), s, F.lit(" (17.2)\n"))).otherwise("")
    psnr = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("[q] PSNR y:40.1 u:inf v:43.0 average:"), F.when(i % 5 == 0, "inf").otherwise(F.concat(s, F.lit(".25"))), F.lit(" min:1\n")))
    count = F.when(i % 6 == 0, "done").otherwise(F.concat(F.lit("frame=    1 fps=0\nframe= "), i + F.col("size"), F.lit(" fps=25\n")))
    return part(spark, sf_dir).select("id", *[c.alias(n) for n, c in rules.metrics(F.concat(count, ssim, psnr)).items()])


@query("range_resolve", """WITH p AS (SELECT page_id AS id, octet_length(encode(html)) AS n, page_id % 7 AS k FROM {pages}), r AS (SELECT id, n, k,
    CASE k WHEN 0 THEN id * 40 WHEN 1 THEN id * 40 WHEN 2 THEN greatest(0, n - id) WHEN 3 THEN n WHEN 5 THEN 7 ELSE 0 END AS a, CASE k WHEN 0 THEN least(id * 40 + 999, n - 1) WHEN 5 THEN least(3, n - 1) ELSE n - 1 END AS b FROM p)
  SELECT id AS page_id, CASE WHEN k IN (4, 6) THEN 200 WHEN a < n AND b >= a THEN 206 ELSE 416 END AS status, CASE WHEN k IN (4, 6) THEN 0 WHEN a < n AND b >= a THEN a END AS first, CASE WHEN k IN (4, 6) THEN n - 1 WHEN a < n AND b >= a THEN b END AS last FROM r""")
def range_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a-b, a-, -n, - alone, another unit, b under a, and none."""
    i, k = F.col("page_id"), F.col("page_id") % 7
    header = F.when(k == 0, F.concat(F.lit("bytes="), i * 40, F.lit("-"), i * 40 + 999)).when(k == 1, F.concat(F.lit(" bytes = "), i * 40, F.lit("-"))).when(k == 2, F.concat(F.lit("bytes=-"), i)).when(k == 3, "bytes=-").when(k == 4, "items=0-3").when(k == 5, "bytes=7-3")
    p = adapters.frame(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("n"), header.alias("header"))
    return p.select("page_id", *[c.cast("bigint").alias(n) for n, c in rules.byte_range(F.col("header"), F.col("n")).items()])


@query("pointer_rules", """WITH p AS (SELECT page_id AS id, sha256(url) AS h, page_id % 8 AS k FROM {pages}) SELECT id AS page_id, CASE WHEN k IN (0, 1, 2) THEN 'clip.' || substr(h, 1, CASE k WHEN 0 THEN 8 WHEN 1 THEN 64 ELSE 12 END) || '.asclv' ELSE '' END AS pointer,
  k NOT IN (3, 5) AS token_ok, k NOT IN (4, 6) AS id_ok FROM p""")
def pointer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer files with comments, blank lines, wrong names; tokens and ids good and bad."""
    k, h = F.col("page_id") % 8, F.sha2("url", 256)
    name = lambda n: F.concat(F.lit("clip."), F.substring(h, 1, n), F.lit(".asclv"))
    text = (F.when(k == 0, name(8)).when(k == 1, F.concat(F.lit("# note\n\n \t"), name(64), F.lit(" \r\nclip.zz.asclv"))).when(k == 2, F.concat(name(12), F.lit("\n")))
        .when(k == 3, F.upper(name(12))).when(k == 4, name(7)).when(k == 5, F.concat(F.lit("x\n"), name(12))).when(k == 6, "# only\n").otherwise(F.concat(name(12), F.repeat(F.lit("\n#" + "x" * 99), 50))))
    token = F.when(k == 3, "a b").when(k == 5, F.repeat(F.lit("t"), 81)).otherwise(F.substring(h, 1, 20))
    own = F.when(k == 4, "").when(k == 6, "a\tb").otherwise(F.substring(h, 1, 30))
    return adapters.frame(spark, sf_dir, "pages").select("page_id", rules.pointer(text).alias("pointer"), F.regexp_like(token, F.lit("^[A-Za-z0-9_-]{1,80}$")).alias("token_ok"), rules.clean(own, 64).alias("id_ok"))


KEYS = ("a/index.HTML", "b.js", "c.png", "clip.0123456789abcdef.asclv", "clip.0123.asclv", "d.slots", "e.txt", "noext", "f.mp4", "g.webm", "x/y.tsv", "h.m3u8", "i.mpd", "j.ts", "k.m4s", "l.json", "m.tar.gz", "v/clip.00aa11bb.asclv")


@query("content_type_map", "WITH k AS (SELECT page_id, " + picked(KEYS, "page_id") + " AS k FROM {pages}) SELECT page_id, CASE " + " ".join(f"WHEN lower(k) LIKE '%.{e}' THEN '{t}'" for e, t in sorted(rules.TYPES.items())) + " ELSE 'application/octet-stream' END AS mime, k IN ('clip.0123456789abcdef.asclv', 'v/clip.00aa11bb.asclv') AS immutable FROM k")
def content_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = adapters.frame(spark, sf_dir, "pages").select("page_id", pick(KEYS, F.col("page_id")).alias("k"))
    return key.select("page_id", rules.content_type(F.col("k")).alias("mime"), F.regexp_like(F.substring_index("k", "/", -1), F.lit(rules.POINTER)).alias("immutable"))


LEVEL_ROWS = ", ".join(f"('{n}', {k}, {a}, {s}, {d})" for k, (n, a, s, d) in enumerate(rules.LEVELS))


@query("level_lookup", f"""WITH {PART}, s AS (SELECT id, ((size * 64 + 15) // 16) * ((size * 36 + 15) // 16) AS mbs, 10 + id % 51 AS fps, 1 + id % 16 AS wanted FROM p),
  t AS (SELECT * FROM (VALUES {LEVEL_ROWS}) AS v(level, k, rate, most, dpb)),
  c AS (SELECT id, r.refs, level, k FROM s JOIN (SELECT unnest(range(1, 17)) AS refs) r ON r.refs <= wanted JOIN t ON mbs <= most AND mbs * fps <= rate AND least(16, dpb // mbs) >= r.refs),
  best AS (SELECT id, refs, level, row_number() OVER (PARTITION BY id ORDER BY refs DESC, k) AS n FROM c)
  SELECT s.id, best.refs, best.level FROM s LEFT JOIN best ON best.id = s.id AND n = 1""")
def level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("id"), F.col("size")
    got = rules.level(s * 64, s * 36, 10 + i % 51, (1 + i % 16).cast("int"))
    return part(spark, sf_dir).select("id", got.alias("l")).select("id", "l.refs", "l.level")


@query("alarm_predicates", """WITH b AS (SELECT id, (bytes % 700 - 350) / 100.0::DOUBLE AS bias, bytes, priority FROM {pieces}) SELECT id, array_to_string(list_filter([
  CASE WHEN abs(bias) > 1 THEN 'shift ' || printf('%+.2f', bias) END, CASE WHEN priority < 40 AND bytes > 1500 THEN 'over 1500 B' END], lambda x: x IS NOT NULL), '; ') AS note FROM b""")
def alarm_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shift of luma over one tone, and a size over the ceiling where the role has one."""
    bias = (F.col("bytes") % 700 - 350) / 100
    return adapters.pieces(spark, sf_dir).select("id", F.concat_ws("; ", F.when(F.abs(bias) > 1, F.format_string("shift %+.2f", bias)), F.when((F.col("priority") < 40) & (F.col("bytes") > 1500), "over 1500 B")).alias("note"))


NAMES = ("custom", "detail", "balanced", "graphic", "graphic-hq", "graphic-ultra", "color", "unknown")


@query("profile_defaults", f"WITH {PART}, c AS (SELECT id, size, {picked(NAMES, 'id')} AS profile FROM p) SELECT id, coalesce(CASE WHEN size % 3 = 0 THEN size * 10 END, CASE profile WHEN 'detail' THEN 960 WHEN 'graphic-ultra' THEN 960 WHEN 'balanced' THEN 640 WHEN 'graphic' THEN 640 WHEN 'graphic-hq' THEN 768 WHEN 'color' THEN 320 ELSE 480 END) AS cols, CASE profile WHEN 'detail' THEN 64 WHEN 'balanced' THEN 128 ELSE 256 END AS palette_size FROM c WHERE profile <> 'unknown'")
def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user sets goes before the profile, that before the default; unknown profiles are refused."""
    preset = spark.createDataFrame([("custom", None, None), *((n, *v) for n, v in rules.PROFILES.items())], "profile string, p_cols bigint, p_size bigint")
    p = part(spark, sf_dir).withColumn("profile", pick(NAMES, F.col("id"))).join(F.broadcast(preset), "profile")  # seven rows
    return p.select("id", F.coalesce(F.when(F.col("size") % 3 == 0, F.col("size") * 10), "p_cols", F.lit(480)).cast("bigint").alias("cols"), F.coalesce("p_size", F.lit(256)).cast("bigint").alias("palette_size"))


def options(i: Column) -> dict[str, Column]:
    return {
        "mode": pick(("pixel", "pixel", "color", "other"), i), "cols": (i * 977) % 70000, "rows": (i * 31) % 66000 - 100, "fps": i % 260, "palette_size": i % 260, "aspect": (i % 10 - 1) / 10.0, "palette": pick((*rules.PALETTES, "none"), i), "block": i % 9 - 1,
        "algorithm": pick((*rules.ALGORITHMS, "kmeans-oklab", "lloyd"), i), "dither": pick(("off", "selective", "auto", "noise", "off"), i), "matrix": i % 5, "lut_bits": i % 9, "budget": i % 12 / 10.0, "improvement": (i % 11 - 1) / 10.0, "window": i % 6,
        "refit": i % 13 - 1, "refine": F.greatest(F.lit(0), i % 17 - 4), "exact": i % 3 == 0, "byte_budget": F.when(i % 4 == 0, i % 50 - 3), "reserved": i % 14 - 1,
    }


OPTION_SQL = f"""WITH {PART}, o AS (SELECT id AS i, {picked(("pixel", "pixel", "color", "other"), "id")} AS mode, (id * 977) % 70000 AS cols, (id * 31) % 66000 - 100 AS rws, id % 260 AS fps, id % 260 AS ps, id % 10 - 1 AS aspect, {picked(("per-frame", "global", "block", "adaptive", "none"), "id")} AS pal,
  id % 9 - 1 AS block, {picked(("median-cut", "fast-octree", "kmeans-rgb", "kmeans-oklab", "kmeans-oklab", "lloyd"), "id")} AS alg, {picked(("off", "selective", "auto", "noise", "off"), "id")} AS dit, id % 5 AS mat, id % 9 AS bits, id % 12 AS budget, id % 11 - 1 AS imp, id % 6 AS win,
  id % 13 - 1 AS refit, greatest(0, id % 17 - 4) AS refine, id % 3 = 0 AS exact, CASE WHEN id % 4 = 0 THEN id % 50 - 3 END AS bb, id % 14 - 1 AS res FROM p)
""" + " UNION ALL ".join(f"SELECT i AS id, '{n}' AS rule FROM o WHERE {c}" for n, c in (
    ("mode", "mode = 'other'"), ("cols", "cols NOT BETWEEN 1 AND 65535"), ("rows", "rws NOT BETWEEN 0 AND 65535"), ("fps", "fps NOT BETWEEN 1 AND 255"), ("palette_size", "ps NOT BETWEEN 1 AND 256"), ("aspect", "aspect <= 0"), ("palette", "pal = 'none'"), ("block", "block = -1"),
    ("algorithm", "alg = 'lloyd'"), ("dither", "dit = 'noise'"), ("matrix", "mat IN (0, 1, 3)"), ("dither_mode", "dit <> 'off' AND mode <> 'pixel'"), ("lut_bits", "bits IN (1, 2, 8)"), ("budget", "budget = 11"), ("improvement", "imp < 0"), ("window", "win = 0"), ("refit", "refit IN (-1, 11)"),
    ("refine", "refine > 10"), ("refine_algorithm", "refine > 0 AND alg <> 'kmeans-oklab'"), ("exact", "exact AND dit = 'off'"), ("byte_budget_mode", "bb IS NOT NULL AND dit = 'off'"), ("byte_budget", "bb < 0"), ("reserved", "res = -1"), ("reserved_size", "res > 0 AND ps < res + 22")))


@query("option_rules", OPTION_SQL)
def option_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).select("id", F.explode(rules.option_faults(options(F.col("id")))).alias("rule"))


@query("near_lossless", f"WITH {PART}, b AS (SELECT id, size % 5 - 1 AS n, id % 3 AS t, id % 4 // 2 AS s FROM p) SELECT id, CASE WHEN n = 0 THEN t WHEN n > 0 AND t + s = 0 THEN n END AS temporal, CASE WHEN n = 0 THEN s WHEN n > 0 AND t + s = 0 THEN n END AS spatial, CASE WHEN n < 0 THEN 'negative' WHEN n > 0 AND t + s > 0 THEN 'mixed' END AS error FROM b")
def near_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.near_lossless(F.col("size") % 5 - 1, F.col("id") % 3, F.floor(F.col("id") % 4 / 2))
    return part(spark, sf_dir).select("id", *[c.alias(n) for n, c in got.items()])


@query("stage_order", f"WITH {PART} SELECT id, CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS place FROM p")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a stage by its name; null for an unknown one."""
    name = pick(("trellis", "quantize", "emit", "dither", "other"), F.col("id"))
    return part(spark, sf_dir).select("id", F.nullif(F.array_position(F.array(*[F.lit(s) for s in rules.STAGES]), name) - 1, F.lit(-1)).alias("place"))


@query("digit_layout", """WITH v AS (SELECT event_id, CAST(floor(value * 37) AS BIGINT) % 10000 AS v, event_id % 2 = 0 AS pad, lpad(CAST(CAST(floor(value * 37) AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS t FROM {feed})
  SELECT event_id, p AS place, CASE WHEN NOT pad AND p < 4 AND CAST(substr(t, 1, p) AS BIGINT) = 0 THEN 10 ELSE CAST(substr(t, p, 1) AS BIGINT) END AS glyph FROM v, (SELECT unnest(range(1, 5)) AS p)""")
def digit_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.feed(spark, sf_dir).select("event_id", F.posexplode(rules.glyphs(F.floor(F.col("value") * 37) % 10000, 4, F.col("event_id") % 2 == 0)).alias("k", "glyph"))
    return f.select("event_id", (F.col("k") + 1).cast("bigint").alias("place"), "glyph")


@query("payload_parse", """WITH f AS (SELECT event_id, event_id % 30 AS a, event_id % 70 AS b, event_id % 3 AS here, event_id % 9 AS c, event_id % 11 = 0 AS short, event_id % 13 = 0 AS letter FROM {feed}),
  g AS (SELECT *, NOT short AND NOT letter AND a <= 23 AND b <= 59 AND CASE here WHEN 0 THEN c = 0 WHEN 1 THEN c BETWEEN 1 AND 7 ELSE false END AS ok FROM f)
  SELECT event_id, ok AS accepted, CASE WHEN ok THEN a END AS hours, CASE WHEN ok THEN b END AS minutes, CASE WHEN ok THEN CASE here WHEN 0 THEN -1 ELSE c END END AS choice FROM g""")
def payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers of two digits, and a choice of 1 to 7 led by a digit that tells whether there is one; all or nothing."""
    e = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(e % 30), two(e % 70), (e % 3).cast("string"), F.when(e % 11 == 0, "").otherwise((e % 9).cast("string")))
    text = F.when(e % 13 == 0, F.overlay(text, F.lit("x"), F.lit(2), F.lit(1))).otherwise(text)
    t = adapters.feed(spark, sf_dir).select("event_id", text.alias("t"))
    good = F.regexp_like("t", F.lit("^[0-9]{6}$"))
    number = lambda a, n: F.when(good, F.substring("t", a, n)).cast("bigint")
    a, b, here, c = number(1, 2), number(3, 2), number(5, 1), number(6, 1)
    ok = F.coalesce(good & (a <= 23) & (b <= 59) & F.when(here == 0, c == 0).when(here == 1, c.between(1, 7)).otherwise(False), F.lit(False))
    return t.select("event_id", ok.alias("accepted"), F.when(ok, a).alias("hours"), F.when(ok, b).alias("minutes"), F.when(ok, F.when(here == 0, -1).otherwise(c)).alias("choice"))


@query("feed_fields_valid", """WITH f AS (SELECT channel, event_id, ts, serial, event_id % 10 AS k, CAST(floor(value) AS BIGINT) % 100 AS a, event_id % 77 AS b FROM {feed}),
  g AS (SELECT *, k NOT IN (1, 2, 3, 4) AND a <= 59 AND b <= 59 AS fields FROM f)
  SELECT event_id, fields AS valid, fields AND serial > coalesce(max(CASE WHEN fields THEN serial END) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM g""")
def feed_fields_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `8-digit serial|4 digits` and a line end: form, digits and ranges, then a serial over all accepted before."""
    k, digits = F.col("event_id") % 10, F.concat(F.lpad((F.floor("value") % 100).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 77).cast("string"), 2, "0"))
    serial = F.lpad(F.col("serial").cast("string"), 8, "0")
    line = F.when(k == 1, F.concat(serial, F.lit("|"), digits)).when(k == 2, F.concat(serial, F.lit(":"), digits, F.lit("\n"))).when(k == 3, F.concat(serial, F.lit("|0a"), F.substring(digits, 3, 2), F.lit("\n"))).when(k == 4, F.concat(F.substring(serial, 2, 7), F.lit("|"), digits, F.lit("\n"))).otherwise(F.concat(serial, F.lit("|"), digits, F.lit("\n")))
    f = adapters.feed(spark, sf_dir).select("channel", "event_id", "ts", line.alias("line"))
    form = F.regexp_like("line", F.lit(r"\A[0-9]{8}\|[0-9]{4}\n\z"))
    valid = form & (F.when(form, F.substring("line", 10, 2)).cast("int") <= 59) & (F.when(form, F.substring("line", 12, 2)).cast("int") <= 59)
    told = f.select("channel", "event_id", "ts", F.coalesce(valid, F.lit(False)).alias("valid"), F.when(form, F.substring("line", 1, 8)).cast("bigint").alias("serial"))
    before = Window.partitionBy("channel").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max(F.when(F.col("valid"), F.col("serial"))).over(before), F.lit(-1))
    return told.select("event_id", "valid", (F.col("valid") & F.coalesce(F.col("serial") > top, F.lit(False))).alias("accepted"))


@query("residency_plan", """WITH s AS (SELECT id, id // 64 AS list, id % 5 > 0 AS resident, CASE WHEN id % 9 > 0 THEN priority ELSE 1000000000 END AS pr, CASE WHEN id % 17 > 0 THEN bytes ELSE 0 END AS b FROM {pieces})
  SELECT a.id, a.list, coalesce(bool_and(a.resident), false) AND coalesce(sum(o.b), 0) <= 20000 AS kept FROM s a LEFT JOIN s o ON o.list = a.list AND o.resident AND a.resident AND (o.pr, o.id) <= (a.pr, a.id) GROUP BY a.id, a.list""")
def residency_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each list of 64 pieces the resident ones, by priority and arrival, until the first that is over the budget."""
    i = F.col("id")
    p = adapters.pieces(spark, sf_dir).select("id", F.floor(i / 64).alias("list"), (i % 5 > 0).alias("resident"), F.when(i % 9 > 0, F.col("priority")).alias("priority"), F.when(i % 17 > 0, F.col("bytes")).alias("bytes"))
    order = Window.partitionBy("list", "resident").orderBy(F.coalesce("priority", F.lit(1_000_000_000)), "id").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("id", "list", (F.col("resident") & (F.sum(F.coalesce("bytes", F.lit(0))).over(order) <= 20000)).alias("kept"))


@query("rank_by_ratio", "WITH t AS (SELECT id, id // 64 AS list, bytes % 37 AS gain, 1 + priority % 12 AS cost FROM {pieces}) SELECT a.id, a.list, 1 + count(b.id) AS place FROM t a LEFT JOIN t b ON b.list = a.list AND (b.gain * a.cost > a.gain * b.cost OR (b.gain * a.cost = a.gain * b.cost AND b.id < a.id)) GROUP BY a.id, a.list")
def rank_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By gain over cost, compared by cross products, so exactly; ties by id."""
    p = adapters.pieces(spark, sf_dir).select("id", F.floor(F.col("id") / 64).alias("list"), (F.col("bytes") % 37).alias("gain"), (1 + F.col("priority") % 12).alias("cost"))

    def order(a: Column, b: Column) -> Column:
        left, right = a["gain"] * b["cost"], b["gain"] * a["cost"]
        return F.when(left > right, -1).when(left < right, 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)

    ranked = p.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("id", "gain", "cost")), order).alias("a"))
    return ranked.select("list", F.posexplode("a").alias("k", "t")).select("t.id", "list", (F.col("k") + 1).cast("bigint").alias("place"))


@query("keypad_prefix", "WITH c AS (SELECT DISTINCT CAST(bytes AS VARCHAR) AS code FROM {pieces} UNION SELECT DISTINCT CAST(bytes // 10 AS VARCHAR) FROM {pieces} WHERE id % 3 = 0) SELECT code, NOT EXISTS (SELECT 1 FROM c b WHERE length(b.code) > length(c.code) AND starts_with(b.code, c.code)) AS at_once FROM c")
def keypad_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code fires at once unless it begins a longer one: its proper prefixes are looked up, no pair is compared."""
    p = adapters.pieces(spark, sf_dir)
    codes = p.select(F.col("bytes").cast("string").alias("code")).union(p.filter("id % 3 = 0").select(F.floor(F.col("bytes") / 10).cast("string"))).distinct()
    begun = codes.filter(F.length("code") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda n: F.left("code", n))).alias("code")).distinct().withColumn("begun", F.lit(True))
    return codes.join(begun, "code", "left").select("code", F.col("begun").isNull().alias("at_once"))


@query("gesture_guard", """WITH t AS (SELECT user_id, event_id, epoch(ts) AS at, event_type FROM {feed}) SELECT c.user_id, c.event_id, coalesce(c.at - max(v.at), 800) >= 800 AS accepted
  FROM t c LEFT JOIN t v ON v.user_id = c.user_id AND v.event_type = 'view' AND (v.at < c.at OR (v.at = c.at AND v.event_id < c.event_id)) WHERE c.event_type = 'click' GROUP BY c.user_id, c.event_id, c.at""")
def gesture_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within 800 seconds of the user's last touch (a view) are refused."""
    f = adapters.feed(spark, sf_dir).select("user_id", "event_id", "event_type", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "view", F.col("at")), ignorenulls=True).over(order)
    return f.withColumn("last", last).filter("event_type = 'click'").select("user_id", "event_id", (F.col("last").isNull() | (F.col("at") - F.col("last") >= 800)).alias("accepted"))


@query("switch_latency", """WITH e AS (SELECT channel, event_id, event_type, epoch(ts) AS at FROM {feed}) SELECT s.channel, s.event_id AS began, coalesce(round(min(p.at) - s.at, 3), -1) AS latency
  FROM e s LEFT JOIN e p ON p.channel = s.channel AND p.event_type = 'purchase' AND p.at > s.at AND p.at <= s.at + 86400 WHERE s.event_type = 'signup' GROUP BY s.channel, s.event_id, s.at""")
def switch_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from a switch (a signup) to the first progress (a purchase), -1 after a day: the next one in descending time."""
    f = adapters.feed(spark, sf_dir).select("channel", "event_id", "event_type", F.unix_micros("ts").alias("at"))
    back = Window.partitionBy("channel").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)  # a microsecond on, or more
    ahead = F.min(F.when(F.col("event_type") == "purchase", F.col("at"))).over(back)
    wait = (F.col("ahead") - F.col("at")) / 1e6
    return f.withColumn("ahead", ahead).filter("event_type = 'signup'").select("channel", F.col("event_id").alias("began"), F.when(wait <= 86400, F.round(wait, 3)).otherwise(-1.0).alias("latency"))


@query("ring_sequence", "WITH o AS (SELECT channel, event_id, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS k FROM {feed}) SELECT channel, event_id, CASE WHEN k % 7 = 0 THEN 7 ELSE k % 7 END AS piece, (k - 1) // 7 AS lap FROM o")
def ring_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that a ring of seven appends, one an event of the channel."""
    k = F.row_number().over(Window.partitionBy("channel").orderBy("ts", "event_id")) - 1
    return adapters.feed(spark, sf_dir).select("channel", "event_id", (1 + k % 7).cast("bigint").alias("piece"), F.floor(k / 7).alias("lap"))


RADIO = {"mp3": ("mp3", "audio/mpeg"), "aac": ("m4a", "audio/mp4")}


@query("radio_plan", f"WITH {PART} SELECT id, CASE id % 4 WHEN 0 THEN 'mp3' WHEN 3 THEN NULL ELSE 'm4a' END AS ext, CASE id % 4 WHEN 0 THEN 'audio/mpeg' WHEN 3 THEN NULL ELSE 'audio/mp4' END AS mime, id % 4 IN (0, 1) AS copied FROM p")
def radio_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of a sound track by codec: copied if it is known, else made anew; none where there is no track."""
    codec = pick(("mp3", "aac", "opus", None), F.col("id"))
    known = F.create_map(*[x for n, (e, m) in RADIO.items() for x in (F.lit(n), F.struct(F.lit(e).alias("ext"), F.lit(m).alias("mime")))])
    other = F.struct(F.lit("m4a").alias("ext"), F.lit("audio/mp4").alias("mime"))
    p = part(spark, sf_dir).withColumn("codec", codec)
    plan = F.when(F.col("codec").isNotNull(), F.coalesce(F.try_element_at(known, F.col("codec")), other))
    return p.select("id", plan["ext"].alias("ext"), plan["mime"].alias("mime"), F.coalesce(F.col("codec").isin(*RADIO), F.lit(False)).alias("copied"))


@query("variant_parse", """WITH v AS (SELECT id, id // 64 AS list, id % 6 AS k, priority FROM {pieces}), n AS (SELECT *, CASE k WHEN 0 THEN 'c4' WHEN 1 THEN 'c3' WHEN 2 THEN 'none' WHEN 3 THEN 'none' END AS known FROM v)
  SELECT id, coalesce(known, 'f' || sum((known IS NULL)::INT) OVER (PARTITION BY list ORDER BY id)) AS name, CASE WHEN k IN (1, 3, 4) THEN priority ELSE 22 END AS crf FROM n""")
def variant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`name@crf`, `name` or free text, which is numbered f1, f2 within its list; the crf stands after the last @ if it is digits."""
    i, q = F.col("id"), F.col("priority").cast("string")
    text = F.when(i % 6 == 0, "C4 ").when(i % 6 == 1, F.concat(F.lit("c3@"), q)).when(i % 6 == 2, "None").when(i % 6 == 3, F.concat(F.lit("@"), q)).when(i % 6 == 4, F.concat(F.lit("hqdn3d=3:2@x@ "), q)).otherwise("unsharp@5:5")
    p = adapters.pieces(spark, sf_dir).select("id", F.floor(i / 64).alias("list"), F.trim(text).alias("t"))
    crf = F.regexp_extract("t", r"@\s*([0-9]+)$", 1)
    body = F.lower(F.trim(F.when(crf != "", F.regexp_replace("t", r"@\s*[0-9]+$", "")).otherwise(F.col("t"))))
    name = F.when(body.isin("", "none"), "none").when(body.isin("c3", "c4"), body)
    free = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).over(Window.partitionBy("list").orderBy("id"))
    return p.select("id", "list", name.alias("known"), F.coalesce(F.nullif(crf, F.lit("")).cast("bigint"), F.lit(22)).alias("crf")).select("id", F.coalesce("known", F.concat(F.lit("f"), free.cast("string"))).alias("name"), "crf")


@query("frame_sample", "SELECT DISTINCT c.clip * 250 + (2 * i * (n - 1) + 6) // 12 AS frame FROM (SELECT CAST(floor(vec_id / 250) AS BIGINT) AS clip, count(*) AS n FROM {embeddings} GROUP BY 1) c, (SELECT unnest(range(0, 7)) AS i)")
def frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven frames of each clip, evenly spaced, first and last among them, by integer rounding."""
    k = 7
    clips = adapters.frame(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / adapters.CLIP).alias("clip")).agg(F.count("*").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((2 * i * (F.col("n") - 1) + k - 1) / (2 * (k - 1))))
    return clips.select("clip", F.explode(F.array_distinct(at)).alias("at")).select((F.col("clip") * adapters.CLIP + F.col("at")).alias("frame"))


@query("sample_grid", "SELECT frame, cell, x, y, value FROM {cells} WHERE x IN (SELECT i * 7 // 3 FROM (SELECT unnest(range(0, 4)) AS i)) AND y IN (0, 3, 7)")
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns and three rows of the eight, evenly spaced from edge to edge, cut to integers; looked up in the packed frame."""
    spaced = lambda n: [k * 7 // (n - 1) for k in range(n)]
    at = F.array(*[F.lit(y * 8 + x) for y in spaced(3) for x in spaced(4)])
    p = adapters.packed(spark, sf_dir).select("frame", "cells", F.explode(at).alias("c"))
    return p.select("frame", F.col("c").cast("bigint").alias("cell"), (F.col("c") % 8).cast("bigint").alias("x"), F.floor(F.col("c") / 8).alias("y"), F.get("cells", F.col("c")).cast("bigint").alias("value"))


@query("colour_range_check", "SELECT frame, count_if(r3 < 0 OR r3 > 255 OR g3 < 0 OR g3 > 255 OR b3 < 0 OR b3 > 255) AS refused, count(*) AS n FROM (SELECT frame, r * 3 - 250 AS r3, g * 3 - 250 AS g3, b * 3 - 250 AS b3 FROM {pixels}) GROUP BY frame")
def colour_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, made three times as contrasting, that are no bytes; they are refused, not wrapped."""
    bad = F.exists(F.array(*[F.col(c) * 3 - 250 for c in "rgb"]), lambda v: (v < 0) | (v > 255))
    return adapters.pixels(spark, sf_dir).groupBy("frame").agg(F.count_if(bad).alias("refused"), F.count("*").alias("n"))


@query("bilinear_sample", """WITH c AS (SELECT a.frame, a.cell, a.value + r.value + d.value + rd.value AS four FROM {cells} a JOIN {cells} r ON r.frame = a.frame AND r.y = a.y AND r.x = least(7, a.x + 1) JOIN {cells} d ON d.frame = a.frame AND d.x = a.x AND d.y = least(7, a.y + 1)
  JOIN {cells} rd ON rd.frame = a.frame AND rd.x = r.x AND rd.y = d.y) SELECT frame, cell, four / 4 AS mixed FROM c""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a cell on in both directions: the mean of four, the edge standing for what is beyond it."""
    at = lambda i, dx, dy: F.get("cells", i + F.when(i % 8 < 7, dx).otherwise(0) + F.when(i < 56, 8 * dy).otherwise(0))
    mix = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (at(i, 0, 0) + at(i, 1, 0) + at(i, 0, 1) + at(i, 1, 1)) / 4)
    return adapters.packed(spark, sf_dir).select("frame", F.posexplode(mix).alias("c", "mixed")).select("frame", F.col("c").cast("bigint").alias("cell"), "mixed")


@query("bit_packing", """SELECT frame, bits, CAST(cell // (8 // bits) AS BIGINT) AS byte_, CAST(sum((value % (1 << bits)) << ((cell % (8 // bits)) * bits)) AS BIGINT) AS packed FROM {cells}, (VALUES (1), (2), (4)) AS t(bits) GROUP BY ALL""")
def bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 1, 2 and 4 bits, the first in the lowest bits."""
    def packed(bits: int) -> Column:
        per = 8 // bits
        code = lambda b, k: (F.get("cells", b * per + k) % (1 << bits)) * (1 << (k * bits))
        one = lambda b: sum((code(b, k) for k in range(1, per)), code(b, 0))
        return F.transform(F.sequence(F.lit(0), F.lit(64 // per - 1)), lambda b: F.struct(F.lit(bits).alias("bits"), b.cast("bigint").alias("byte_"), one(b).cast("bigint").alias("packed")))

    return adapters.packed(spark, sf_dir).select("frame", F.inline(F.concat(packed(1), packed(2), packed(4))))
