"""Work within a frame, on its packed cells: no row is dealt out and no window is sorted.

The SQL of these queries, by windows over single cells, stands in the modules of their subjects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import plan
from tessera.sources import adapters

SIDE = 8


def at(i: Column, dx: int, dy: int, edge: Column | None = None, of: str = "cells") -> Column:
    """The cell dx to the right of and dy below place i; beyond the frame `edge`, or null."""
    x, y = i % SIDE + dx, F.floor(i / SIDE).cast("int") + dy
    inside = (x >= 0) & (x < SIDE) & (y >= 0) & (y < SIDE)
    value = F.when(inside, F.get(of, i + dx + dy * SIDE))
    return value if edge is None else F.coalesce(value, edge)


def each(spark: SparkSession, sf_dir: str, name: str, value: Callable[[Column], Column], *more: tuple[str, Callable[[Column], Column]], kind: str = "bigint") -> DataFrame:
    """(frame, cell, name, more) of value(place) of all cells."""
    columns = ((name, value), *more)
    p = adapters.packed(spark, sf_dir)
    cells = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.struct(i.cast("bigint").alias("cell"), *[f(i).cast(kind).alias(n) for n, f in columns]))
    return p.select("frame", F.inline(cells))


def byte(x: Column) -> Column:
    return F.pmod(x, F.lit(256))


def gradient(i: Column) -> Column:
    none = F.lit(0)
    return at(i, -1, 0, none) + at(i, 0, -1, none) - at(i, -1, -1, none)


@plan("predictor_left")
def predictor_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, "residual", lambda i: byte(at(i, 0, 0) - at(i, -1, 0, F.lit(0))))


@plan("predictor_top")
def predictor_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, "residual", lambda i: byte(at(i, 0, 0) - at(i, 0, -1, F.lit(0))))


@plan("predictor_gradient")
def predictor_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, "residual", lambda i: byte(at(i, 0, 0) - gradient(i)))


@plan("predictor_choice")
def predictor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor with the least sum of residuals as distances from zero; of equals the first."""
    def cost(predicted: Callable[[Column], Column]) -> Column:
        def one(s: Column, i: Column) -> Column:
            r = byte(at(i, 0, 0) - predicted(i))
            return s + F.least(r, 256 - r)

        return F.aggregate(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), F.lit(0), one).cast("bigint")

    none = F.lit(0)
    costs = adapters.packed(spark, sf_dir).select("frame", cost(lambda i: at(i, -1, 0, none)).alias("left_cost"), cost(lambda i: at(i, 0, -1, none)).alias("top_cost"), cost(gradient).alias("gradient_cost"))
    options = F.array(*[F.struct(F.col(f"{n.lower()}_cost").alias("c"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(("LEFT", "TOP", "GRADIENT"))])
    return costs.withColumn("chosen", F.array_min(options)["n"])


@plan("gradient_weights")
def gradient_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    def weight(i: Column) -> Column:
        own = at(i, 0, 0)
        dx, dy = at(i, 1, 0, own) - at(i, -1, 0, own), at(i, 0, 1, own) - at(i, 0, -1, own)
        return F.round(1 + 4 * F.least(F.lit(1.0), F.sqrt((dx * dx + dy * dy).cast("double")) / 64), 6)

    return each(spark, sf_dir, "weight", weight, kind="double")


def around(f: Callable[[int, int], Column], radius: int = 1) -> list[Column]:
    return [f(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


@plan("box_sum")
def box_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(i: Column) -> Column:
        near = around(lambda dx, dy: at(i, dx, dy, F.lit(0)))
        return sum(near[1:], near[0])

    return each(spark, sf_dir, "box", box)


@plan("edge_mask_dilated")
def edge_mask_dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of 24 or more from the left or from above, and what stands beside one."""
    p = adapters.packed(spark, sf_dir)
    places = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))

    def edge(i: Column) -> Column:
        own = at(i, 0, 0)
        return F.when((F.abs(own - at(i, -1, 0, own)) >= 24) | (F.abs(own - at(i, 0, -1, own)) >= 24), 1).otherwise(0)

    p = p.select("frame", F.inline(F.array(F.struct(F.transform(places, edge).alias("edges")))))
    wide = lambda i: F.greatest(*around(lambda dx, dy: at(i, dx, dy, F.lit(0), "edges")))
    return p.select("frame", F.inline(F.transform(places, lambda i: F.struct(i.cast("bigint").alias("cell"), F.get("edges", i).alias("edge"), wide(i).alias("dilated")))))


@plan("banding_plateaus")
def banding_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(F.filter(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: i % SIDE < SIDE - 1), lambda i: F.struct(F.get("cells", i).alias("a"), F.get("cells", i + 1).alias("b")))
    smooth = F.filter(steps, lambda s: F.abs(s["b"] - s["a"]).between(1, 8))
    flat = F.filter(smooth, lambda s: s["b"] - s["b"] % 16 == s["a"] - s["a"] % 16)
    return adapters.packed(spark, sf_dir).select("frame", F.size(smooth).cast("bigint").alias("smooth"), F.size(flat).cast("bigint").alias("plateau"))


@plan("planes_to_cells")
def planes_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE // 2 - 1)), lambda k: F.struct(k.cast("bigint").alias("place"), F.get("cells", 2 * k).cast("bigint").alias("glyph"), F.get("cells", 2 * k + 1).cast("bigint").alias("colour")))
    return adapters.packed(spark, sf_dir).select("frame", F.inline(pairs))


@plan("luma_bias")
def luma_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("cells", F.lit(0), lambda s, v: s - v % 8)
    return adapters.packed(spark, sf_dir).select("frame", F.round(total.cast("double") / F.size("cells"), 2).alias("bias"))


@plan("psnr_vs_quantized")
def psnr_vs_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    sse = F.aggregate("cells", F.lit(0), lambda s, v: s + (v % 8) * (v % 8)).cast("bigint")
    p = adapters.packed(spark, sf_dir).select("frame", F.inline(F.array(F.struct(sse.alias("sse")))))
    return p.select("frame", "sse", F.round(F.when(F.col("sse") > 0, 10 * F.log10(65025.0 * 64 / F.col("sse"))), 6).alias("psnr"))


@plan("tile_geometry")
def tile_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of three cells, the last ones cut at the border: worked out, not counted."""
    tiles = -(-SIDE // 3)
    side = lambda t: F.least(F.lit(3), F.lit(SIDE) - t * 3)
    big = lambda c, n: c.cast("bigint").alias(n)
    all_ = F.transform(F.sequence(F.lit(0), F.lit(tiles * tiles - 1)), lambda t: F.struct(
        big(t, "tile"), big(side(t % tiles) * side(F.floor(t / tiles)), "cells"), big(t % tiles * 3, "x0"), big(F.floor(t / tiles) * 3, "y0"), big(side(t % tiles), "w"), big(side(F.floor(t / tiles)), "h")))
    return adapters.packed(spark, sf_dir).select("frame", F.inline(all_))


@plan("bayer_dither")
def bayer_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ("00081002", "12041406", "13031101", "15071309")
    table = F.array(*[F.lit(int(r[2 * k : 2 * k + 2])) for r in rows for k in range(4)])

    def dithered(i: Column) -> Column:
        v = F.get("cells", i)
        limit = F.get(table, (F.floor(i / SIDE) % 4 * 4 + i % SIDE % 4).cast("int"))
        return v - v % 16 + F.when(v % 16 > limit, 16).otherwise(0)

    return each(spark, sf_dir, "dithered", dithered)
