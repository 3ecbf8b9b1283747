"""Operators over cells by frame and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.adapters import CLIP


def previous(cells: DataFrame, by: list[str | Column] | None = None, order: str = "frame", value: str = "value") -> DataFrame:
    """Each cell with its value in the frame before, as `before` (null in the first of a clip)."""
    by = by or [F.floor(F.col("frame") / CLIP), "cell"]
    return cells.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def change_report(cells: DataFrame, keyint: int = 15) -> DataFrame:
    """Of each frame: changed cells, key flag, place in its group, sizes of the codings and the least.

    A full frame is its cells; a list of changes is a count of 2 bytes and 3 bytes a change; a mask a
    bit a cell and a byte a change. Ties: FULL before DELTA before MASK. Key frames are full.
    """
    per = previous(cells).groupBy("frame").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("value")), 1).otherwise(0)).cast("bigint").alias("changed"),
    )
    key = F.col("frame") % keyint == 0
    full, delta, mask = F.col("n"), 2 + 3 * F.col("changed"), F.ceil(F.col("n") / 8) + F.col("changed")
    options = F.array(*[F.struct(size.cast("bigint").alias("bytes"), F.lit(k).alias("rank"), F.lit(tag).alias("tag")) for k, (size, tag) in enumerate(((full, "FULL"), (delta, "DELTA"), (mask, "MASK")))])
    best = F.when(key, options[0]).otherwise(F.array_min(options))
    return per.select("frame", "n", "changed", F.round(F.col("changed") / F.col("n"), 6).alias("share"), key.alias("keyframe"), (F.col("frame") % keyint).alias("chain"), full.alias("full_bytes"), delta.alias("delta_bytes"), mask.cast("bigint").alias("mask_bytes"), best["tag"].alias("tag"), best["bytes"].alias("bytes"))


def islands(rows: DataFrame, by: list[str], at: str, gap: int = 1) -> DataFrame:
    """Runs of rows whose places are at most `gap` apart: by, run, first, last, n."""
    w = Window.partitionBy(*by).orderBy(at)
    opens = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    numbered = rows.withColumn("opens_", opens).withColumn("run", F.sum("opens_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def asof(left: DataFrame, right: DataFrame, on: str, carry: list[str], by: list[str] | None = None) -> DataFrame:
    """Each left row with the carried columns of the last right row at or before it.

    Both sides are united and the last known value is carried on: one sort by key, no range join.
    """
    by = by or []
    both = left.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(f"{c}_") for c in carry], F.lit(1).alias("left_")).unionByName(
        right.select(*by, on, *[F.col(c).alias(f"{c}_") for c in carry], F.lit(0).alias("left_")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(on, "left_").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("*", *[F.last(f"{c}_", ignorenulls=True).over(w).alias(c) for c in carry]).filter("left_ = 1").drop("left_", *[f"{c}_" for c in carry])


def nearest(points: DataFrame, centres: DataFrame, of: list[str], centre: str = "centre", most: int = 256) -> DataFrame:
    """Each point with the centre of least squared distance, of equal ones the lowest.

    Centres (at most `most`, which is checked) become one array beside every point, so that points
    are neither multiplied nor dealt out.
    """
    if centres.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centres")
    packed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(centre).alias("id"), *of))).alias("centres_"))

    def distance(c: Column) -> Column:
        return sum(((F.col(k) - c[k]) * (F.col(k) - c[k]) for k in of[1:]), (F.col(of[0]) - c[of[0]]) * (F.col(of[0]) - c[of[0]]))

    best = F.array_min(F.transform("centres_", lambda c: F.struct(distance(c).alias("d"), c["id"].alias("id"))))
    return points.join(F.broadcast(packed)).select(*points.columns, best["id"].alias(centre), best["d"].alias("distance"))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, stop: str, width: int = 16) -> DataFrame:
    """Each point with every interval that holds it, ends included: an equi-join on bins of `width`, then the exact test.

    An interval stands once in each bin that it meets, a point in one, so no pair comes twice.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    left = points.withColumn("bin_", F.floor(F.col(at) / width))
    right = intervals.filter(F.col(start) <= F.col(stop)).withColumn("bin_", F.explode(bins))
    return left.join(right, "bin_").filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))).drop("bin_")


def overlaps(slots: DataFrame, by: str, key: str, width: int = 8) -> DataFrame:
    """Pairs (by, a, b), a < b, of slots that share cells and frames: an equi-join on bins of time.

    A pair meets in several bins and counts in the first that both are in.
    """
    first = F.floor(F.col("start") / width)
    binned = slots.withColumn("first_", first).withColumn("bin_", F.explode(F.sequence(first, F.floor(F.col("stop") / width))))
    side = lambda s: binned.select(by, "bin_", *[F.col(c).alias(f"{s}_{c}") for c in (key, "x", "y", "w", "h", "start", "stop", "first_")])
    both = side("a").join(side("b"), [by, "bin_"])
    meet = lambda lo, size: (F.col(f"a_{lo}") < F.col(f"b_{lo}") + F.col(f"b_{size}")) & (F.col(f"b_{lo}") < F.col(f"a_{lo}") + F.col(f"a_{size}"))
    when = (F.col("a_start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("a_stop"))
    own = F.col("bin_") == F.greatest("a_first_", "b_first_")
    return both.filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & meet("x", "w") & meet("y", "h") & when & own).select(by, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))


def covered_cells(rects: DataFrame, columns: int, rows: int, *keep: str) -> DataFrame:
    """(keep, cell, dx, dy) of each cell of a grid that a rectangle (x, y, w, h) holds; what is outside goes."""
    inside = lambda at, size, most: F.sequence(F.greatest(F.col(at), F.lit(0)), F.least(F.col(at) + F.col(size), F.lit(most)) - 1)
    some = rects.filter((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < columns) & (F.col("y") < rows) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0))
    each = some.withColumn("cx_", F.explode(inside("x", "w", columns))).withColumn("cy_", F.explode(inside("y", "h", rows)))
    return each.select(*keep, (F.col("cy_") * columns + F.col("cx_")).cast("bigint").alias("cell"), (F.col("cx_") - F.col("x")).alias("dx"), (F.col("cy_") - F.col("y")).alias("dy"))
