"""Queries through the container, the tile codec and stateful folds."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import ship
from tessera.sources import adapters, clips

CELLS = "SELECT frame, cell, value FROM {cells}"


def round_trip(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Cells written as clips and read back."""
    packed = clips.packed_cells(adapters.cells(spark, sf_dir))
    frames = clips.decoded(clips.encoded(packed, 8, 8, version, tile_size=4))
    each = frames.select((F.col("path").cast("bigint") * 50 + F.col("frame")).alias("frame"), "cells", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cell"))
    return each.select("frame", F.col("cell").cast("bigint").alias("cell"), F.conv(F.hex(F.substring("cells", F.col("cell") + 1, F.lit(1))), 16, 10).cast("bigint").alias("value"))


for number in (1, 2, 3):
    query(f"container_round_trip_v{number}", CELLS)(lambda spark, sf_dir, v=number: round_trip(spark, sf_dir, v))




@query("zlib_size")
def zlib_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated size of each text, by a vectorised function."""
    ship(spark)

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(zlib.compress((t or "").encode(), 9)))

    return adapters.frame(spark, sf_dir, "documents").select("doc_id", size("text").alias("bytes"))


