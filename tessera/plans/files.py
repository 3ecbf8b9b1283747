"""Files made of the tables and read back: headers, bundles, raw video, sidecars, box files, noise, inflating, dither, palettes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import colour, tiles
from tessera.operators import folds, frames, loops
from tessera.plans.registry import query
from tessera.session import ship
from tessera.sources import adapters, boxes, clips, media, sidecars


def clip_files(spark: SparkSession, sf_dir: str, version: int = 3) -> DataFrame:
    return clips.encoded(clips.packed_cells(adapters.cells(spark, sf_dir)), 8, 8, version, tile_size=4)


def little(content: Column, at: int, size: int) -> Column:
    """An unsigned little-endian number in a binary column."""
    return F.conv(F.hex(F.reverse(F.substring(content, at + 1, size))), 16, 10).cast("bigint") if size == 1 else sum(
        (F.conv(F.hex(F.substring(content, at + 1 + k, 1)), 16, 10).cast("bigint") * 256**k for k in range(1, size)), F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("bigint")
    )


@query("header_fields", "SELECT CAST(vec_id // 50 AS VARCHAR) AS path, 'ASCL' AS magic, 3 AS version, 3 AS mode, 15 AS fps, 8 AS cols, 8 AS rows_, 256 AS pal_size, count(*) AS n_frames, 32 AS data_off, 4 AS tile_size, 1 AS codec_flags FROM {embeddings} GROUP BY vec_id // 50")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the headers of real clips, taken from the bytes by column functions."""
    f = clip_files(spark, sf_dir)
    at = {"version": (4, 1), "mode": (5, 1), "fps": (7, 1), "cols": (8, 2), "rows_": (10, 2), "pal_size": (12, 2), "n_frames": (14, 4), "data_off": (20, 2), "tile_size": (24, 2), "codec_flags": (26, 1)}
    where = {n: spec for n, spec in zip(clips.NAMES, zip(offsets(), sizes_of(), strict=True), strict=True)}
    names = {"rows_": "rows"}
    return f.select("path", F.substring("content", 1, 4).cast("string").alias("magic"), *[little(F.col("content"), *where[names.get(n, n)]).alias(n) for n in at])


def sizes_of() -> list[int]:
    return [struct.calcsize("<" + c) for c in ("4s", *"BBBBHHHIBBIHBBI")]


def offsets() -> list[int]:
    return np.concatenate([[0], np.cumsum(sizes_of())[:-1]]).astype(int).tolist()


@query("frame_directory", "SELECT CAST(vec_id // 50 AS VARCHAR) AS path, vec_id % 50 AS frame, true AS ruled, true AS joined FROM {embeddings}")
def frame_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of the clips, no cells. Joined: a block begins where the one before ends; ruled: a key
    frame is there when it is due, and key frames alone have the palette."""
    d = clips.decoded(clip_files(spark, sf_dir), with_cells=False)
    end = F.lag(F.col("offset") + F.col("block_bytes")).over(Window.partitionBy("path").orderBy("frame"))
    big = lambda c: F.col(c).cast("bigint").alias(c)
    ruled = ((F.col("frame") % adapters.KEYINT != 0) | F.col("keyframe")) & (F.col("pal_count") == F.when(F.col("keyframe"), 256).otherwise(0))
    return d.select("path", big("frame"), ruled.alias("ruled"), F.coalesce(F.col("offset") == end, F.lit(True)).alias("joined"))


@query("bundle_parts", "SELECT CAST(vec_id // 50 AS VARCHAR) AS path, count(*) * 3 AS sound_bytes, count(*) AS meta_bytes, true AS same FROM {embeddings} GROUP BY vec_id // 50")
def bundle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips put in envelopes with sound and overlay data, and taken out again."""
    ship(spark)

    @F.pandas_udf("sound_bytes bigint, meta_bytes bigint, same boolean")
    def there_and_back(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            n = clips.header(c)["n_frames"]
            clip, sound, meta = clips.unbundle(clips.bundle(c, b"abc" * n, b"m" * n))
            out.append((len(sound), len(meta), clip == c and clips.unbundle(c)[0] == c))
        return pd.DataFrame(out, columns=["sound_bytes", "meta_bytes", "same"])

    return clip_files(spark, sf_dir).select("path", there_and_back("content").alias("b")).select("path", "b.*")


@query("raw_video_planes", "SELECT frame // 50 AS file, frame % 50 AS frame, CAST(sum(value) AS BIGINT) AS luma, CAST(sum(CASE WHEN x < 4 AND y < 4 THEN value ELSE 0 END) AS BIGINT) AS cb FROM {cells} GROUP BY frame")
def raw_video_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw video files made of the frames (the upper left quarter as chroma), with half a frame at the end, and read back."""
    ship(spark)

    def run(clip: int, first: int, m: np.ndarray) -> pd.DataFrame:
        out = []
        for k in range(0, len(m), 50):
            grid = m[k : k + 50].reshape(-1, 8, 8).astype(np.uint8)
            body = b"".join(b"FRAME\n" + g.tobytes() + g[:4, :4].tobytes() + bytes(16) for g in grid)
            w, h, planes = media.y4m_frames(b"YUV4MPEG2 W8 H8 F15:1 C420jpeg\n" + body + b"FRAME\nhalf")
            out += [((first + k) // 50, n, int(np.frombuffer(y, np.uint8).sum()), int(np.frombuffer(cb, np.uint8).sum())) for n, (y, cb, _) in enumerate(planes) if (w, h) == (8, 8)]
        return pd.DataFrame(out, columns=["file", "frame", "luma", "cb"])

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "file bigint, frame bigint, luma bigint, cb bigint")


@query("thumbnail_scan", "WITH n AS (SELECT CAST(floor(frame / 250) AS BIGINT) AS clip, frame % 250 * 64 + cell AS spot, value FROM {cells}), m AS (SELECT clip, count(*) // 48 AS whole FROM n GROUP BY clip) SELECT n.clip, spot // 48 AS thumb, spot % 48 AS place, value FROM n JOIN m ON m.clip = n.clip WHERE spot // 48 < whole")
def thumbnail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bytes of a clip as thumbnails of 48 bytes; a last one that is cut short goes."""
    byte = F.transform("cells", lambda v: F.lpad(F.hex(v), 2, "0"))
    raw = adapters.packed(spark, sf_dir).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", F.concat_ws("", byte).alias("h")))).alias("f"))
    raw = raw.select("clip", F.unhex(F.array_join(F.col("f.h"), "")).alias("content"))
    whole = F.floor(F.octet_length("content") / 48).cast("int")
    thumbs = raw.filter(whole > 0).select("clip", "content", F.explode(F.sequence(F.lit(0), whole - 1)).alias("thumb"))
    thumbs = thumbs.select("clip", "thumb", F.substring("content", F.col("thumb") * 48 + 1, F.lit(48)).alias("t"))
    each = thumbs.select("clip", F.col("thumb").cast("bigint").alias("thumb"), "t", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("place"))
    return each.select("clip", "thumb", F.col("place").cast("bigint").alias("place"), F.conv(F.hex(F.substring("t", F.col("place") + 1, F.lit(1))), 16, 10).cast("bigint").alias("value"))


@query("sidecar_slots", """WITH s AS (SELECT l_orderkey // 20 AS scene, CAST(row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) - 1 AS slot, l_orderkey % 500 AS start, l_linenumber AS n, l_suppkey % 2 AS flags FROM {lineitem})
  SELECT scene, slot, slot % 20 * 8 AS x, slot // 20 * 8 AS y, 2 + n % 3 AS w, 2 + n % 3 AS h, start, start + n AS stop, flags FROM s WHERE slot < 400""")
def sidecar_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots written as binary sidecars, one a scene of 160 x 160 cells (its first 400), and read back under all rules."""
    ship(spark)
    l = adapters.frame(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 20).alias("scene"), "l_orderkey", F.col("l_linenumber").cast("bigint").alias("n"), "l_partkey", "l_suppkey", "l_extendedprice")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["l_orderkey", "n", "l_partkey", "l_suppkey", "l_extendedprice"]).head(400)
        slots = [(k % 20 * 8, k // 20 * 8, 2 + n % 3, 2 + n % 3, o % 500, o % 500 + n, s % 2) for k, (o, n, s) in enumerate(zip(pdf["l_orderkey"].tolist(), pdf["n"].tolist(), pdf["l_suppkey"].tolist(), strict=True))]
        patches = [(w, w, bytes([250] * (w * w))) for w in (2, 3, 4)]
        file = sidecars.pack(patches, slots, [{"field": 1, "kind": sidecars.CHOICE, "slots": [0], "low": 0, "high": 2, "pad": 0, "patch_base": 0}], bytes(30))
        rows = sidecars.parse(file, 160, 160, 600)["slots"]
        scene = int(pdf["scene"].iloc[0])
        return pd.DataFrame([(scene, r["slot"], r["x"], r["y"], r["w"], r["h"], r["start"], r["stop"], r["flags"]) for r in rows], columns=["scene", "slot", "x", "y", "w", "h", "start", "stop", "flags"])

    return l.groupBy("scene").applyInPandas(run, "scene bigint, slot bigint, x bigint, y bigint, w bigint, h bigint, start bigint, stop bigint, flags bigint")


@query("box_samples", """WITH s AS (SELECT doc_id // 50 AS file, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS k, octet_length(encode(coalesce(text, ''))) AS size FROM {documents})
  SELECT file, k AS sample, CAST(16 + 8 + 4 * (k // 7 + 1) + coalesce(sum(size) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position, size FROM s""")
def box_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box files of 50 documents, seven samples a chunk, and the places that their indices tell."""
    ship(spark)
    d = adapters.frame(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("file"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = boxes.build([bytes(c) for c in pdf.sort_values("doc_id")["content"]], 7)
        return pd.DataFrame({"path": [str(pdf["file"].iloc[0])], "content": [made]})

    got = boxes.sample_index(d.groupBy("file").applyInPandas(run, "path string, content binary"))
    return got.select(F.col("path").cast("bigint").alias("file"), F.col("sample").cast("bigint").alias("sample"), "position", "size")


NOISE = 4096


@query("noise_bytes", f"WITH RECURSIVE r AS (SELECT 0 AS k, 2463534242::BIGINT AS x UNION ALL SELECT k + 1, CAST(CAST(x::DOUBLE * 1103515245::DOUBLE + 12345::DOUBLE AS HUGEINT) % 2147483648 AS BIGINT) FROM r WHERE k < {NOISE}) SELECT CAST(k - 1 AS BIGINT) AS place, (x >> 16) & 255 AS value FROM r WHERE k > 0")
def noise_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-noise: a congruence in double precision, as each number is the next one's seed made in one task."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            for n in pdf["n"]:
                x, out = 2463534242, []
                for _ in range(int(n)):
                    x = int(float(x) * 1103515245.0 + 12345.0) % 2147483648
                    out.append((x >> 16) & 255)
                yield pd.DataFrame({"place": range(len(out)), "value": out})

    return spark.createDataFrame([(NOISE,)], "n bigint").mapInPandas(run, "place bigint, value bigint")


@query("inflate_bounded", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) <= 2000 AND doc_id % 7 <> 0 AS accepted, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 2000 AND doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS digest FROM {documents}")
def inflate_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated texts, every seventh with a byte too many, inflated up to 2000 bytes: more, or what follows, is refused."""
    ship(spark)

    @F.pandas_udf("string")
    def digest(ids: pd.Series, texts: pd.Series) -> pd.Series:
        import hashlib

        def one(i: int, t: str | None) -> str | None:
            try:
                return hashlib.sha256(tiles.inflate(zlib.compress((t or "").encode()) + b"x" * (i % 7 == 0), 2000)).hexdigest()
            except ValueError:
                return None

        return pd.Series([one(i, t) for i, t in zip(ids, texts, strict=True)], dtype=object)

    return adapters.frame(spark, sf_dir, "documents").select("doc_id", digest("doc_id", "text").alias("digest")).select("doc_id", F.col("digest").isNotNull().alias("accepted"), "digest")


def byte_cost(spark: SparkSession):
    """The callback of encoders: deflated bytes of a frame of indices."""
    ship(spark)

    @F.pandas_udf("bigint")
    def cost(content: pd.Series) -> pd.Series:
        return content.map(lambda c: len(zlib.compress(bytes(c), 9)))

    return cost


@query("dither_dispatch")
def dither_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered dither of each frame to 16 levels, taken only if it costs at most `budget` bytes more than the plain frame.

    Modes by frame: off, selective (all or nothing under the budget), auto (the cheaper one).
    """
    matrix = F.array(*[F.lit(v) for v in (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)])
    level = lambda v, i: F.least(F.lit(15), F.floor(v / 16) + F.when(v % 16 > F.get(matrix, (F.floor(i / 8) % 4 * 4 + i % 8 % 4).cast("int")), 1).otherwise(0))
    packed = lambda c: F.unhex(F.array_join(F.transform(c, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    cost = byte_cost(spark)
    p = adapters.packed(spark, sf_dir).select("frame", packed(F.transform("cells", lambda v: F.floor(v / 16))).alias("plain"), packed(F.transform("cells", level)).alias("dithered"))
    p = p.select("frame", cost("plain").alias("plain_bytes"), cost("dithered").alias("dithered_bytes"))
    mode = F.get(F.array(F.lit("off"), F.lit("selective"), F.lit("auto")), (F.col("frame") % 3).cast("int"))
    more = F.col("dithered_bytes") - F.col("plain_bytes")
    return p.select("frame", mode.alias("mode"), "plain_bytes", "dithered_bytes", F.when(mode == "selective", more <= 3).when(mode == "auto", more < 0).otherwise(False).alias("dithered"))


@query("dither_hysteresis", """WITH q AS (SELECT c.clip, c.frame, c.tile, c.q, e.label, CASE WHEN e.label = lag(e.label) OVER (PARTITION BY c.clip, c.tile ORDER BY c.frame) THEN 0 ELSE 1 END AS resets
    FROM (SELECT CAST(floor(frame / 250) AS BIGINT) AS clip, frame, y // 4 * 2 + x // 4 AS tile, CASE WHEN max(value) - min(value) >= 60 THEN 1 ELSE 0 END AS q FROM {cells} GROUP BY ALL) c JOIN (SELECT vec_id, label // 4 AS label FROM {embeddings}) e ON e.vec_id = c.frame),
  g AS (SELECT *, sum(resets) OVER (PARTITION BY clip, tile ORDER BY frame) AS part FROM q),
  f AS (SELECT a.frame, a.tile, a.clip, a.part, coalesce(sum(b.q), 0) / 4 AS share FROM g a JOIN g b ON b.clip = a.clip AND b.tile = a.tile AND b.part = a.part AND b.frame BETWEEN a.frame - 3 AND a.frame GROUP BY ALL)
  SELECT a.frame, a.tile, a.share, coalesce(arg_max(b.share >= 0.7, b.frame), false) AS active FROM f a LEFT JOIN f b ON b.clip = a.clip AND b.tile = a.tile AND b.part = a.part AND b.frame <= a.frame AND b.frame > a.frame - 250 AND (b.share >= 0.7 OR b.share < 0.45) GROUP BY a.frame, a.tile, a.share""")
def dither_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles switch on when 0.7 of their last four frames qualify and off under 0.45; a change of context starts anew."""
    c = adapters.cells(spark, sf_dir).groupBy("frame", (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).alias("tile")).agg(F.when(F.max("value") - F.min("value") >= 60, 1).otherwise(0).alias("q"))
    e = adapters.frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.floor(F.col("label") / 4).alias("context"))
    rows = c.join(e, "frame").withColumn("clip", F.floor(F.col("frame") / adapters.CLIP))
    order = Window.partitionBy("clip", "tile").orderBy("frame")
    rows = rows.withColumn("resets", F.when(F.col("context") == F.lag("context").over(order), 0).otherwise(1)).withColumn("part", F.sum("resets").over(order))
    own = Window.partitionBy("clip", "tile", "part").orderBy("frame")
    rows = rows.withColumn("share", F.sum("q").over(own.rowsBetween(-3, 0)) / 4)
    decided = F.when(F.col("share") >= 0.7, True).when(F.col("share") < 0.45, False)
    rows = rows.withColumn("active", F.coalesce(F.last(decided, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    return rows.select("frame", "tile", "share", "active")


@query("base_quantizer", "WITH c AS (SELECT frame, px, k, row_number() OVER (PARTITION BY frame, px ORDER BY (r - 85 * (k // 16 % 4)) * (r - 85 * (k // 16 % 4)) + (g - 85 * (k // 4 % 4)) * (g - 85 * (k // 4 % 4)) + (b - 85 * (k % 4)) * (b - 85 * (k % 4)), k) AS n FROM {pixels}, (SELECT unnest(range(0, 64)) AS k)) SELECT frame, px, k AS idx FROM c WHERE n = 1")
def base_quantizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callback that turns colours into indices of a palette of 64, a vectorised function whose result is checked."""
    ship(spark)
    palette = np.array([(85 * (k // 16 % 4), 85 * (k // 4 % 4), 85 * (k % 4)) for k in range(64)])

    @F.pandas_udf("bigint")
    def quantize(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        colours = np.stack([r, g, b], 1)
        found = ((colours[:, None] - palette[None]) ** 2).sum(2).argmin(1) if len(colours) else np.zeros(0, np.int64)
        if len(found) != len(colours) or (len(found) and (found.min() < 0 or found.max() >= len(palette))):
            raise ValueError("the quantiser gave no index for each colour")
        return pd.Series(found)

    return adapters.pixels(spark, sf_dir).select("frame", "px", quantize("r", "g", "b").alias("idx"))


@query("sliding_windows", "SELECT event_type, strftime(h - to_minutes(CAST(k * 20 AS INTEGER)), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 20 MINUTE, ts) AS h FROM {feed}), (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type in windows of an hour that begin every 20 minutes."""
    w = adapters.feed(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour", "20 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("yuv_to_rgb", """WITH c AS (SELECT frame, px, (r - 16) * 255 / 219::DOUBLE AS l, (g - 128) * 255 / 224::DOUBLE AS u, (b - 128) * 255 / 224::DOUBLE AS v FROM {pixels})
  SELECT frame, px, CAST(least(255, greatest(0, round_even(l + 1.5748::DOUBLE * v, 0))) AS BIGINT) AS r, CAST(least(255, greatest(0, round_even(l - (2 * 0.0722::DOUBLE * 0.9278::DOUBLE / 0.7152::DOUBLE) * u - (2 * 0.2126::DOUBLE * 0.7874::DOUBLE / 0.7152::DOUBLE) * v, 0))) AS BIGINT) AS g, CAST(least(255, greatest(0, round_even(l + 1.8556::DOUBLE * u, 0))) AS BIGINT) AS b FROM c""")
def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limited-range planes (the three channels stand for them) to bytes of colour, halves to even, clipped."""
    p = adapters.pixels(spark, sf_dir)
    return p.select("frame", "px", *[c.alias(n) for c, n in zip(colour.from_yuv(F.col("r"), F.col("g"), F.col("b")), "rgb", strict=True)])


@query("trellis_temporal_fold", """
WITH RECURSIVE r AS (SELECT frame, cell, value AS emitted FROM {cells} WHERE frame % 250 = 0
  UNION ALL SELECT c.frame, c.cell, CASE WHEN abs(c.value - r.emitted) <= 6 THEN r.emitted ELSE c.value END FROM r JOIN {cells} c ON c.cell = r.cell AND c.frame = r.frame + 1 WHERE c.frame % 250 <> 0)
SELECT frame, cell, emitted FROM r""")
def trellis_temporal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the emitted value while the new one is within 6 of it: a fold over the frames of a clip, all cells at once."""

    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        out = m.copy()
        for k in range(1, len(m)):
            out[k] = np.where(np.abs(m[k] - out[k - 1]) <= 6, out[k - 1], m[k])
        return pd.DataFrame({"frame": np.repeat(first + np.arange(len(m)), 64), "cell": np.tile(np.arange(64), len(m)), "emitted": out.ravel()})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, cell bigint, emitted bigint")


@query("palette_stabilise")
def palette_stabilise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clip the mean colours by label of its later half, given the places of the nearest ones of its first half and drawn to them by a quarter."""
    ship(spark)
    e = adapters.frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("bigint").alias("label"))
    late = (F.col("frame") % adapters.CLIP >= adapters.CLIP // 2).alias("late")
    means = adapters.pixels(spark, sf_dir).join(e, "frame").groupBy(F.floor(F.col("frame") / adapters.CLIP).alias("clip"), late, "label").agg(*[F.rint(F.avg(c)).alias(c) for c in "rgb"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["late"] == s].sort_values("label")[list("rgb")].to_numpy() for s in (False, True)]
        got = folds.stabilise(sides[1], sides[0], 0.25)
        return pd.DataFrame([(int(pdf["clip"].iloc[0]), k, *map(int, c)) for k, c in enumerate(got)], columns=["clip", "idx", *"rgb"])

    return means.groupBy("clip").applyInPandas(run, "clip bigint, idx bigint, r bigint, g bigint, b bigint")  # palettes have 256 entries at most


@query("global_palette")
def global_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes: all colours with their weights, then weighted k-means in Oklab over them; sorted bytes of colour."""
    p = adapters.pixels(spark, sf_dir).groupBy("r", "g", "b").agg(F.count("*").alias("weight"))
    lab = colour.with_oklab(p, ["r", "g", "b", "weight"], ("ok_l", "ok_a", "ok_b")).drop("r", "g", "b")
    centres = folds.kmeans(lab, ["ok_l", "ok_a", "ok_b"], 8, 5, spread=True)
    mapped = colour.gamut_factor(centres, ("ok_l", "ok_a", "ok_b")).select("n", "ok_l", (F.col("ok_a") * F.col("factor")).alias("ok_a"), (F.col("ok_b") * F.col("factor")).alias("ok_b"))
    rgb = colour.from_oklab(mapped, ("ok_l", "ok_a", "ok_b"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r", "g", "b", "n")) - 1  # at most 256 rows
    return rgb.select(place.alias("idx"), "r", "g", "b", "n")


@query("decode_timing")
def decode_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clip the median of five timed decodes after one that isn't, in milliseconds a frame."""
    ship(spark)

    @F.pandas_udf("frames bigint, ms_per_frame double")
    def timed(content: pd.Series) -> pd.DataFrame:
        import statistics
        import time

        out = []
        for c in content:
            took = []
            for _ in range(6):
                began = time.perf_counter()
                n = len(clips.frames_of(c)[1])
                took.append(time.perf_counter() - began)
            out.append((n, 1000 * statistics.median(took[1:]) / max(1, n)))
        return pd.DataFrame(out, columns=["frames", "ms_per_frame"])

    return clip_files(spark, sf_dir).select("path", timed("content").alias("t")).select("path", "t.*")


@query("frame_rate_resample", """WITH o AS (SELECT vec_id, vec_id // 250 AS clip, vec_id % 250 AS i FROM {embeddings}), s AS (SELECT *, CAST(floor(CASE clip % 3 WHEN 0 THEN i * 24 / 15 WHEN 2 THEN i * 12.5 / 15 ELSE i END) AS BIGINT) AS source FROM o)
  SELECT s.clip, s.i AS out_frame, source, CAST(e.label AS BIGINT) AS label FROM s JOIN {embeddings} e ON e.vec_id = s.clip * 250 + source AND source < 250""")
def frame_rate_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output frame shows the source's frame of its moment: frames repeat or drop. A rate that is none, or
    not between 0 and 1000, counts as the wanted one."""
    wanted = 15.0
    e = adapters.frame(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / adapters.CLIP).alias("clip"), (F.col("vec_id") % adapters.CLIP).alias("i"), F.col("label").cast("bigint").alias("label"))
    told = F.when(F.col("clip") % 3 == 0, 24.0).when(F.col("clip") % 3 == 1, F.lit(float("nan"))).otherwise(12.5)
    fps = F.when(F.isnan(told) | (told <= 0) | (told >= 1000), wanted).otherwise(told)
    out = e.select("clip", F.col("i").alias("out_frame"), F.floor(F.col("i") * fps / wanted).alias("source"))
    return out.join(e.select("clip", F.col("i").alias("source"), "label"), ["clip", "source"]).select("clip", "out_frame", "source", "label")


@query("weighted_quantile_sample", """
WITH a AS (SELECT r * 65536 + g * 256 + b AS k, count(*) AS w FROM {pixels} GROUP BY r * 65536 + g * 256 + b),
c AS (SELECT k, w, CAST(sum(w) OVER (ORDER BY k) AS BIGINT) AS upto, CAST(sum(w) OVER () AS BIGINT) AS total FROM a)
SELECT k AS key24, w AS weight, CAST(ceil(upto * 64 / total - 0.5) - ceil((upto - w) * 64 / total - 0.5) AS BIGINT) AS draws FROM c WHERE ceil(upto * 64 / total - 0.5) - ceil((upto - w) * 64 / total - 0.5) > 0""")
def weighted_quantile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 draws at even places of the cumulative weight. The running sum is taken over ranges of keys, then within each."""
    a = adapters.pixels(spark, sf_dir).groupBy(colour.key24(F.col("r"), F.col("g"), F.col("b")).alias("k")).agg(F.count("*").alias("w")).withColumn("part_", F.floor(F.col("k") / 65536))
    parts = a.groupBy("part_").agg(F.sum("w").alias("sum_"))  # 256 ranges at most
    base = F.sum("sum_").over(Window.orderBy("part_")) - F.col("sum_")
    before = parts.withColumn("base_", base).withColumn("total", F.sum("sum_").over(Window.partitionBy(F.lit(0))))
    upto = F.col("base_") + F.sum("w").over(Window.partitionBy("part_").orderBy("k"))
    c = a.join(F.broadcast(before.select("part_", "base_", "total")), "part_").withColumn("upto", upto)
    place = lambda x: F.ceil(x * 64 / F.col("total") - 0.5)
    return c.withColumn("draws", place(F.col("upto")) - place(F.col("upto") - F.col("w"))).filter("draws > 0").select(F.col("k").alias("key24"), F.col("w").alias("weight"), "draws")


@query("clip_difference", """SELECT frame, count(*) AS cells, CASE WHEN frame % 10 = 7 THEN 0 ELSE count(*) END AS others, CASE WHEN frame % 10 = 7 THEN 0 ELSE count_if(value % 4 = 0) END AS equal_cells,
  min(CASE WHEN frame % 10 = 7 OR value % 4 <> 0 THEN cell END) AS first_difference FROM {cells} GROUP BY frame""")
def clip_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clips frame by frame: the cells, and a decoded coarser clip that lacks one frame of ten."""
    a = adapters.packed(spark, sf_dir).select("frame", F.posexplode("cells").alias("cell", "v"))
    coarse = adapters.cells(spark, sf_dir).filter("frame % 10 <> 7").withColumn("value", F.col("value") - F.col("value") % 4)
    decoded_ = clips.decoded(clips.encoded(clips.packed_cells(coarse), 8, 8, 3, tile_size=4))
    # a clip's frames are numbered from 0, so the frames that are there are put beside their numbers
    there = coarse.select("frame").distinct().withColumn("path", F.floor(F.col("frame") / 50).cast("string"))
    there = there.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("frame")) - 1)
    frames_ = decoded_.select("path", F.col("frame").alias("k"), "cells").join(there, ["path", "k"])
    b = frames_.select("frame", "cells", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cell")).select("frame", "cell", F.conv(F.hex(F.substring("cells", F.col("cell") + 1, F.lit(1))), 16, 10).cast("int").alias("w"))
    both = a.join(b, ["frame", "cell"], "full_outer")
    same = F.col("v").eqNullSafe(F.col("w"))
    return both.groupBy("frame").agg(F.count("v").alias("cells"), F.count("w").alias("others"), F.count_if(same).alias("equal_cells"), F.min(F.when(~same, F.col("cell").cast("bigint"))).alias("first_difference"))


@query("alpha_clean_crop", """WITH p AS (SELECT frame, px % 7 AS x, px // 7 AS y, CASE WHEN g >= 140 THEN r ELSE 16 END AS r, g >= 140 AS seen FROM {pixels}), e AS (SELECT frame, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM p WHERE seen GROUP BY frame),
  c AS (SELECT frame, x0 // 2 * 2 AS x0, y0 // 2 * 2 AS y0, least((x1 + 1) // 2 * 2, 7) AS x1, least((y1 + 1) // 2 * 2, 3) AS y1 FROM e)
  SELECT c.frame, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, CAST(sum(r) AS BIGINT) AS red FROM c JOIN p ON p.frame = c.frame AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL""")
def alpha_clean_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green as alpha, all or nothing at 140; what is not seen gets a flat colour; the rectangle of the rest, made even, is cut out."""
    seen, x, y = F.col("g") >= 140, F.col("px") % 7, F.floor(F.col("px") / 7)
    rows = adapters.pixels(spark, sf_dir).groupBy("frame").agg(
        F.min(F.when(seen, x)).alias("x0"), F.min(F.when(seen, y)).alias("y0"), F.max(F.when(seen, x + 1)).alias("x1"), F.max(F.when(seen, y + 1)).alias("y1"),
        F.collect_list(F.struct(x.alias("x"), y.alias("y"), F.when(seen, F.col("r")).otherwise(16).alias("r"))).alias("p"),
    ).filter("x0 IS NOT NULL")
    even = rows.select("frame", (F.col("x0") - F.col("x0") % 2).alias("x"), (F.col("y0") - F.col("y0") % 2).alias("y"), F.least(F.col("x1") + F.col("x1") % 2, F.lit(7)).alias("x1"), F.least(F.col("y1") + F.col("y1") % 2, F.lit(3)).alias("y1"), "p")
    inside = F.filter("p", lambda q: (q["x"] >= F.col("x")) & (q["x"] < F.col("x1")) & (q["y"] >= F.col("y")) & (q["y"] < F.col("y1")))
    return even.select("frame", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, q: s + q["r"]).alias("red"))


@query("manifest_rows", "SELECT id, codec || '-' || id AS name, CASE WHEN id % 4 > 0 THEN bytes END AS bytes, CASE WHEN priority > 25 THEN 'wide' ELSE 'narrow' END AS note FROM {pieces}")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as tab-separated text under comments, a dash for what is not known, and read back strictly."""
    import uuid

    from pyspark.sql import types as T

    from tessera.session import checkpoint_dir

    p = adapters.pieces(spark, sf_dir).select("id", F.concat("codec", F.lit("-"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 4 > 0, F.col("bytes")).alias("bytes"), F.when(F.col("priority") > 25, "wide").otherwise("narrow").alias("note"))
    path = f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    media.tsv_lines(p, ["master 0", "made by rule"]).write.text(path)
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("note", T.StringType())])
    return media.read_tsv(spark, path, kinds)
