"""Raw video files and tab-separated manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship

PLANES = "path string, frame int, width int, height int, y binary, cb binary, cr binary"


def y4m_frames(data: bytes):
    """(width, height, [(Y, Cb, Cr)]) of 4:2:0 8-bit frames; a last frame that is cut short is dropped."""
    line, _, body = data.partition(b"\n")
    tokens = line.decode("ascii", "replace").split()
    if not tokens or tokens[0] != "YUV4MPEG2":
        raise ValueError("not a y4m file")
    by = {t[0]: t[1:] for t in tokens[1:]}
    width, height, chroma = int(by.get("W") or 0), int(by.get("H") or 0), by.get("C", "420")
    if not width or not height or width % 2 or height % 2 or not chroma.startswith("420") or "p1" in chroma:
        raise ValueError("only even 4:2:0 frames of 8 bits are read")
    size, mark = width * height * 3 // 2, b"FRAME\n"
    out = []
    for k in range(len(body) // (len(mark) + size)):
        at = k * (len(mark) + size)
        if body[at : at + len(mark)] != mark:
            raise ValueError(f"frame {k} has no mark")
        at += len(mark)
        luma, quarter = width * height, width * height // 4
        out.append((body[at : at + luma], body[at + luma : at + luma + quarter], body[at + luma + quarter : at + size]))
    return width, height, out


def read_y4m(spark: SparkSession, path: str) -> DataFrame:
    """The planes of all frames of the y4m files below a path."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, h, frames = y4m_frames(data)
                cols = [[name] * len(frames), list(range(len(frames))), [w] * len(frames), [h] * len(frames), *([f[k] for f in frames] for k in range(3))]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PLANES.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, PLANES)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a tab-separated manifest; lines that begin with # are comments.

    Strict: a row with another number of columns is an error. Else it is dropped, and of rows with
    the same first column one is kept, that with the least text.
    """
    lines = spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select("value", F.split("value", "\t", -1).alias("p"))
    whole = F.size("p") == len(schema)
    if strict:
        parts = parts.withColumn("p", F.when(whole, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("a row has another number of columns: "), "value"))))
    else:
        parts = parts.filter(whole).groupBy(F.element_at("p", 1).alias("k")).agg(F.min_by("p", "value").alias("p"))
    cell = lambda k, f: F.when(F.element_at("p", k + 1) != "-", F.element_at("p", k + 1)).try_cast(f.dataType).alias(f.name)
    return parts.select(*[cell(k, f) for k, f in enumerate(schema)])


def tsv_lines(rows: DataFrame, comments: list[str]) -> DataFrame:
    """One column of text lines: comments, the names, then the rows in the order of all columns."""
    names = rows.columns
    spark = rows.sparkSession
    head = spark.createDataFrame([(k, f"# {c}") for k, c in enumerate([*comments, "\t".join(names)])], "n int, value string")
    body = rows.select(F.lit(1 << 30).alias("n"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names]).alias("value"))
    return head.unionByName(body).orderBy("n", "value").select("value")
