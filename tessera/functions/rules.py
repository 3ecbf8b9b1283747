"""Rules on options, lines, pointers, ranges, fields and limits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns and palette size of the profiles.
PROFILES = {"detail": (960, 64), "balanced": (640, 128), "graphic": (640, 256), "graphic-hq": (768, 256), "graphic-ultra": (960, 256), "color": (320, 256)}
#: Level, macroblocks a second, of a frame, and of the buffer.
LEVELS = (
    ("3.0", 40500, 1620, 8100), ("3.1", 108000, 3600, 18000), ("3.2", 216000, 5120, 20480), ("4.0", 245760, 8192, 32768), ("4.1", 245760, 8192, 32768),
    ("4.2", 522240, 8704, 34816), ("5.0", 589824, 22080, 110400), ("5.1", 983040, 36864, 184320), ("5.2", 2073600, 36864, 184320),
)
#: Content types by extension.
TYPES = {
    "html": "text/html; charset=utf-8", "js": "application/javascript; charset=utf-8", "png": "image/png", "asclv": "application/octet-stream", "slots": "application/octet-stream",
    "txt": "text/plain; charset=utf-8", "json": "application/json", "mp4": "video/mp4", "webm": "video/webm", "tsv": "text/plain; charset=utf-8",
    "m3u8": "application/vnd.apple.mpegurl", "mpd": "application/dash+xml", "ts": "video/mp2t", "m4s": "video/iso.segment",
}
OTHER_TYPE, POINTER = "application/octet-stream", r"^clip\.[0-9a-f]{8,64}\.asclv$"
#: The order of the stages, and modes, palettes, algorithms and dither modes that there are.
STAGES = ("quantize", "dither", "trellis", "emit")
MODES, PALETTES, ALGORITHMS, DITHERS = ("bw", "color", "pixel", "rgb"), ("per-frame", "global", "block", "adaptive"), ("median-cut", "fast-octree", "kmeans-rgb", "kmeans-oklab"), ("off", "selective", "auto")


def grid_rows(width: Column, height: Column, columns: Column, rows: Column, pixel: Column, aspect: float) -> Column:
    """The given rows, else those of the source's shape, halves to even, at least one; null over 65535 or for no size."""
    auto = F.greatest(F.lit(1), F.rint(columns * (height / width) * F.when(pixel, 1.0).otherwise(aspect))).cast("bigint")
    out = F.when(rows > 0, rows.cast("bigint")).otherwise(auto)
    return F.when((columns > 0) & (columns <= 65535) & (width > 0) & (height > 0) & (out <= 65535), out)


def rate(text: Column) -> Column:
    """Frames a second of `a/b` or `a`."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).cast("double") / F.get(parts, F.lit(1)).cast("double")).otherwise(text.cast("double"))


def metrics(log: Column) -> dict[str, Column]:
    """What a log tells of SSIM, PSNR and frames; a dash, and no frames, where it doesn't."""
    part = r"(?: \([^)]*\))?"
    ssim = rf"SSIM Y:([0-9.]+){part} U:([0-9.]+){part} V:([0-9.]+){part} All:([0-9.]+)"
    found = lambda pattern, group: F.coalesce(F.nullif(F.regexp_extract(log, pattern, group), F.lit("")), F.lit("-"))
    count = F.regexp_extract_all(log, F.lit(r"frame=\s*(\d+)"), F.lit(1))
    return {"ssim_y": found(ssim, 1), "ssim_all": found(ssim, 4), "psnr": found(r"PSNR y:[0-9.inf]+ u:[0-9.inf]+ v:[0-9.inf]+ average:([0-9.inf]+)", 1), "frames": F.coalesce(F.get(count, F.size(count) - 1).cast("bigint"), F.lit(0).cast("bigint"))}


def byte_range(header: Column, total: Column) -> dict[str, Column]:
    """Status, first and last byte of a range request: 200 whole where the header is no range, 416 where nothing is left."""
    bare = F.regexp_replace(header, r"\s", "")
    form, number = r"^bytes=(\d*)-(\d*)$", lambda k: F.nullif(F.regexp_extract(bare, form, k), F.lit("")).cast("bigint")
    suffix = F.greatest(F.coalesce(number(2), F.lit(0)), F.lit(0))
    first = F.coalesce(number(1), F.when(suffix >= total, 0).otherwise(total - suffix))
    last = F.when(number(1).isNull(), total - 1).otherwise(F.least(F.coalesce(number(2), total - 1), total - 1))
    is_range = F.coalesce(F.regexp_like(bare, F.lit(form)), F.lit(False))
    good = (last >= first) & (first < total)
    status = F.when(~is_range, 200).when(good, 206).otherwise(416)
    return {"status": status, "first": F.when(status == 206, first).when(status == 200, 0), "last": F.when(status == 206, last).when(status == 200, total - 1)}


def pointer(text: Column) -> Column:
    """The first line that is neither empty nor a comment if it names a clip, else the empty text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    first = F.get(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), F.lit(0))
    good = (F.length(text) > 0) & (F.length(text) <= 4096) & F.regexp_like(first, F.lit(POINTER))
    return F.when(good, first).otherwise("")


def clean(text: Column, most: int) -> Column:
    """Not empty, not too long, no control characters."""
    return (F.length(text) > 0) & (F.length(text) <= most) & ~F.regexp_like(text, F.lit(r"[\x00-\x1f]"))


def content_type(key: Column) -> Column:
    dot = F.when(F.contains(key, F.lit(".")), F.lower(F.substring_index(key, ".", -1))).otherwise("")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[dot], F.lit(OTHER_TYPE))


def level(width: Column, height: Column, fps: Column, refs: Column) -> Column:
    """(refs, level): the first level that takes size, rate and references, the references lowered until one does."""
    blocks = F.floor((width + 15) / 16) * F.floor((height + 15) / 16)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("rate"), F.lit(s).alias("size"), F.lit(d).alias("dpb")) for n, a, s, d in LEVELS])
    fits = lambda r: F.filter(table, lambda x: (blocks <= x["size"]) & (blocks * fps <= x["rate"]) & (F.least(F.lit(16), F.floor(x["dpb"] / blocks)) >= r))
    tries = F.transform(F.sequence(refs, F.lit(1), F.lit(-1)), lambda r: F.struct(r.cast("bigint").alias("refs"), F.get(fits(r), F.lit(0))["name"].alias("level")))
    return F.get(F.filter(tries, lambda t: t["level"].isNotNull()), F.lit(0))


def glyphs(value: Column, places: int, pad: Column, base: int = 0, empty: int = 10) -> Column:
    """Glyphs of a number's digits from left to right; leading places are empty unless padded."""
    def one(k: int) -> Column:
        rest = F.floor(value / 10 ** (places - 1 - k))
        blank = ~pad & (rest == 0) & F.lit(k < places - 1)
        return (F.when(blank, empty).otherwise(rest % 10) + base).cast("bigint")

    return F.array(*[one(k) for k in range(places)])


def near_lossless(both: Column, temporal: Column, spatial: Column) -> dict[str, Column]:
    """One budget sets both; an explicit budget beside it, or one under zero, is an error."""
    error = F.when(both < 0, "negative").when((both > 0) & ((temporal > 0) | (spatial > 0)), "mixed")
    return {"temporal": F.when(error.isNull(), F.when(both > 0, both).otherwise(temporal)), "spatial": F.when(error.isNull(), F.when(both > 0, both).otherwise(spatial)), "error": error}


def option_faults(o: dict[str, Column]) -> Column:
    """The names of the rules that a row of encoder options breaks."""
    among = lambda c, names: ~o[c].isin(*names)
    out = lambda c, lo, hi: (o[c] < lo) | (o[c] > hi)
    broken = {
        "mode": among("mode", MODES), "cols": out("cols", 1, 65535), "rows": out("rows", 0, 65535), "fps": out("fps", 1, 255), "palette_size": out("palette_size", 1, 256), "aspect": o["aspect"] <= 0,
        "palette": among("palette", PALETTES), "block": o["block"] < 0, "algorithm": among("algorithm", ALGORITHMS), "dither": among("dither", DITHERS), "matrix": ~o["matrix"].isin(2, 4),
        "dither_mode": (o["dither"] != "off") & (o["mode"] != "pixel"), "lut_bits": (o["lut_bits"] != 0) & out("lut_bits", 3, 7), "budget": out("budget", 0, 1), "improvement": o["improvement"] < 0, "window": o["window"] <= 0,
        "refit": out("refit", 0, 10), "refine": out("refine", 0, 10), "refine_algorithm": (o["refine"] != 0) & (o["algorithm"] != "kmeans-oklab"), "exact": o["exact"] & (o["dither"] == "off"),
        "byte_budget_mode": o["byte_budget"].isNotNull() & (o["dither"] == "off"), "byte_budget": o["byte_budget"] < 0, "reserved": o["reserved"] < 0, "reserved_size": (o["reserved"] > 0) & (o["palette_size"] < o["reserved"] + 22),
    }
    return F.filter(F.array(*[F.when(c, n) for n, c in broken.items()]), lambda n: n.isNotNull())
