"""Clips and bundles as Spark sources and sinks.

A clip is a header of 32 bytes, a ramp, a table of offsets and a block for each frame; a bundle is an
envelope around a clip, its sound and its overlay data. Files are read as binary files, wherever
Spark reads, and each is checked as a whole before any of its frames is returned.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tiles
from tessera.session import ship

# Fixed values of the format: magics, the header's layout, bytes a cell by mode, flags.
CLIP_MAGIC = b"ASCL"
BUNDLE_MAGICS = {b"ASCLVID1": 1, b"ASCLVID2": 2, b"ASCLVID3": 3}
HEADER = struct.Struct("<4sBBBBHHHIBBIHBBI")
NAMES = ("magic", "version", "mode", "flags", "fps", "cols", "rows", "pal_size", "n_frames", "ramp_len", "cell_fmt", "data_off", "char_aspect_x1000", "tile_size", "codec_flags", "crc32")
DEPTH = {0: 1, 1: 2, 2: 4, 3: 1}
PAL_PER_SCENE, PAL_GLOBAL, HAS_OFFSET_TABLE = 2, 4, 8
FRAMES = "path string, version int, cols int, rows int, fps int, frame int, tag int, keyframe boolean, pal_count int, palette binary, payload binary, offset bigint, block_bytes bigint, cells binary"


def header(data: bytes) -> dict:
    if len(data) < HEADER.size or data[:4] != CLIP_MAGIC:
        raise ValueError("not a clip")
    h = dict(zip(NAMES, HEADER.unpack_from(data), strict=True))
    if h["version"] not in (1, 2, 3) or h["mode"] not in DEPTH or not h["cols"] or not h["rows"]:
        raise ValueError("unknown version or mode, or an empty grid")
    if h["version"] > 1 and (h["mode"] != 3 or not 4 <= h["tile_size"] <= 32 or h["codec_flags"] != 1):
        raise ValueError("bad tile settings")
    if h["cols"] * h["rows"] * DEPTH[h["mode"]] > 64 << 20:
        raise ValueError("the grid is too large")
    return h


def checksum(data: bytes, version: int) -> int:
    return zlib.crc32(data[32:], zlib.crc32(data[:28]) if version > 1 else 0)


def frames_of(data: bytes):
    """(header, [(frame, tag, palette, payload, offset, block bytes, cells)]) of a clip."""
    h = header(data)
    if (h["crc32"] or h["version"] > 1) and checksum(data, h["version"]) != h["crc32"]:
        raise ValueError("the checksum differs")
    at = h["data_off"]
    if at != 32 + h["ramp_len"] or at + 4 * h["n_frames"] > len(data):
        raise ValueError("the offset table leaves the file")
    offsets = struct.unpack_from(f"<{h['n_frames']}I", data, at)
    expected, before, palette, out = at + 4 * h["n_frames"], None, b"", []
    how = {"rows": h["rows"], "cols": h["cols"], "depth": DEPTH[h["mode"]], "size": h["tile_size"] if h["version"] > 1 else 0, "differential": h["version"] == 3}
    for k, offset in enumerate(offsets):
        if offset != expected or offset + 7 > len(data):
            raise ValueError("blocks are not one after the other")
        size, tag, count = struct.unpack_from("<IBH", data, offset)
        expected = offset + 4 + size
        if expected > len(data) or size < 3 + 3 * count or count > h["pal_size"]:
            raise ValueError("a block leaves the file or has too many colours")
        own, payload = data[offset + 7 : offset + 7 + 3 * count], data[offset + 7 + 3 * count : expected]
        if count and tag not in tiles.KEY_TAGS and h["version"] > 1:
            raise ValueError("a delta frame has a palette")
        if h["flags"] & PAL_GLOBAL and count and k:
            raise ValueError("a second palette in a clip with one")
        palette = own or palette
        before = tiles.decode(tag, payload, before, **how)
        colours = before.reshape(-1, how["depth"])[:, -1] if h["mode"] in (1, 3) else None
        if colours is not None and len(colours) and int(colours.max()) >= max(1, len(palette) // 3):
            raise ValueError("a cell is past the palette")
        out.append((k, tag, own, payload, offset, 4 + size, before.tobytes()))
    if expected != len(data):
        raise ValueError("more follows the last frame")
    return h, out


def build(cells: list[bytes], cols: int, rows: int, palettes: list[bytes], fps: int = 15, version: int = 1, tile_size: int = 16, keyint: int = 15) -> bytes:
    """A clip of mode 3. palettes: of each frame its palette, b"" to go on with the last one.

    Every keyint-th frame and every frame with a palette is a key frame, which repeats the palette.
    """
    how = {"rows": rows, "cols": cols, "size": tile_size if version > 1 else 0, "differential": version == 3}
    blocks, before, palette = [], None, b""
    for k, (content, own) in enumerate(zip(cells, palettes, strict=True)):
        frame = np.frombuffer(content, np.uint8)
        key = before is None or bool(own) or k % keyint == 0
        palette = own or palette
        tag, payload = tiles.encode(frame, before, key, **how)
        carried = palette if tag in tiles.KEY_TAGS else b""
        body = struct.pack("<BH", tag, len(carried) // 3) + carried + payload
        blocks.append(struct.pack("<I", len(body)) + body)
        before = frame
    sizes = np.cumsum([32 + 4 * len(blocks), *map(len, blocks)])
    if sizes[-1] >= 1 << 32:
        raise ValueError("a clip is limited to 4 GiB")
    tail = b"".join(struct.pack("<I", int(s)) for s in sizes[:-1]) + b"".join(blocks)
    most = max((len(p) // 3 for p in palettes), default=0)
    fields = [CLIP_MAGIC, version, 3, PAL_PER_SCENE | HAS_OFFSET_TABLE, fps, cols, rows, most, len(blocks), 0, 3, 32, 1000, tile_size if version > 1 else 0, 1 if version > 1 else 0, 0]
    fields[-1] = checksum(HEADER.pack(*fields) + tail, version)
    return HEADER.pack(*fields) + tail


def bundle(clip: bytes, sound: bytes = b"", meta: bytes = b"") -> bytes:
    version = clip[4]
    if meta and version != 3:
        raise ValueError("overlay data needs version 3")
    magic = next(m for m, v in BUNDLE_MAGICS.items() if v == version)
    lengths = struct.pack("<II", len(clip), len(sound)) + (struct.pack("<I", len(meta)) if version == 3 else b"")
    return magic + lengths + clip + sound + meta


def unbundle(data: bytes) -> tuple[bytes, bytes, bytes]:
    """Clip, sound and overlay data; a bare clip is a bundle without the others."""
    version = BUNDLE_MAGICS.get(data[:8])
    if version is None:
        return data, b"", b""
    size = 20 if version == 3 else 16
    lengths = struct.unpack_from("<III" if version == 3 else "<II", data, 8)
    if size + sum(lengths) != len(data):
        raise ValueError("the envelope has another length than the file")
    ends = np.cumsum([size, *lengths]).tolist()
    parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] + [b""] * (3 - len(lengths))
    if len(parts[0]) < 5 or parts[0][4] != version:
        raise ValueError("the envelope and the clip differ in version")
    return parts[0], parts[1], parts[2]


def decoded(files: DataFrame, with_cells: bool = True) -> DataFrame:
    """(path, content) rows of clips or bundles as rows of frames; without cells only the directory's
    columns are filled, though the whole file is checked all the same."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, found = frames_of(unbundle(content)[0])
                rows = [(path, h["version"], h["cols"], h["rows"], h["fps"], k, tag, tag in tiles.KEY_TAGS, len(pal) // 3, pal, payload if with_cells else None, at, size, cells if with_cells else None) for k, tag, pal, payload, at, size, cells in found]
                kinds = [pa.string(), *[pa.int32()] * 6, pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in FRAMES.split(", ")])

    return files.select("path", "content").mapInArrow(run, FRAMES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The frames of all clips and bundles below a path."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def encoded(frames: DataFrame, cols: int, rows: int, version: int = 1, tile_size: int = 16, keyint: int = 15) -> DataFrame:
    """(path, content) of a clip for each `clip` of rows (clip, frame, cells binary, palette binary).

    A clip's frames refer to one another, so each clip is one group; the format bounds it to 4 GiB.
    """
    ship(frames.sparkSession)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("frame")
        clip = build([bytes(c) for c in pdf["cells"]], cols, rows, [bytes(p) if p is not None else b"" for p in pdf["palette"]], version=version, tile_size=tile_size, keyint=keyint)
        return pd.DataFrame({"path": [str(pdf["clip"].iloc[0])], "content": [clip]})

    return frames.select("clip", "frame", "cells", "palette").groupBy("clip").applyInPandas(run, "path string, content binary")


def packed_cells(cells: DataFrame, per_clip: int = 50) -> DataFrame:
    """(clip, frame, cells, palette) of rows (frame, cell, value): clips of per_clip frames, gray palettes."""
    one = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda s: F.lpad(F.hex(s["value"]), 2, "0")))
    gray = F.unhex(F.lit("".join(f"{v:02X}" * 3 for v in range(256))))
    packed = cells.groupBy("frame").agg(F.unhex(one).alias("cells"))
    return packed.select(F.floor(F.col("frame") / per_clip).alias("clip"), "frame", "cells", F.when(F.col("frame") % per_clip == 0, gray).alias("palette"))
