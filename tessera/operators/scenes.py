"""Frames described by colour, their change, blocks of like frames, merging of rare tile values, bleeding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import colour
from tessera.session import ship

#: Bins of L, a and b; weights of distribution, mean and gradient; their full scales.
BINS, WEIGHTS, SCALES = (12, 10, 10), (0.68, 0.27, 0.05), (0.55, 0.25)
#: Hard cut, drift, frames of a block, and the strength of the palette before by change.
CUT, DRIFT, LEAST, MOST, STABLE, FREE, STRONGEST = 0.58, 0.20, 5, 10, 0.06, 0.42, 0.25
#: Numbers of distinct values in a tile that one value less makes cheaper.
CROSSINGS = (3, 5, 17)


def histogram(pixels: DataFrame) -> DataFrame:
    """(frame, bin, share): Oklab bins, each pixel shared out among the 8 around it."""
    lab = colour.with_oklab(pixels, ["frame"])
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    at = [clip(F.col("l")) * (BINS[0] - 1), clip((F.col("a") + 0.4) / 0.8) * (BINS[1] - 1), clip((F.col("b") + 0.4) / 0.8) * (BINS[2] - 1)]
    placed = colour.once(lab, ["frame"], **{f"p{k}": p for k, p in enumerate(at)})
    placed = colour.once(placed, ["frame"], **{f"i{k}": F.floor(f"p{k}") for k in range(3)}, **{f"f{k}": F.col(f"p{k}") - F.floor(f"p{k}") for k in range(3)})

    def corner(mask: int) -> Column:
        up = [mask >> k & 1 for k in range(3)]
        i = [F.least(F.col(f"i{k}") + up[k], F.lit(BINS[k] - 1)) for k in range(3)]
        w = [F.col(f"f{k}") if up[k] else 1 - F.col(f"f{k}") for k in range(3)]
        return F.struct(((i[0] * BINS[1] + i[1]) * BINS[2] + i[2]).alias("bin"), (w[0] * w[1] * w[2]).alias("w"))

    each = placed.select("frame", F.explode(F.array(*[corner(m) for m in range(8)])).alias("c"))
    total = each.groupBy("frame", "c.bin").agg(F.sum("c.w").alias("w"))
    n = pixels.groupBy("frame").agg(F.count("*").alias("n"))
    return total.join(n, "frame").select("frame", "bin", (F.col("w") / F.col("n")).alias("share")).filter("share > 0")


def described(pixels: DataFrame, columns: int) -> DataFrame:
    """(frame, l, a, b, gradient): mean colour, and mean step of luma to the right and down."""
    luma = pixels.withColumn("luma", colour.luma(F.col("r"), F.col("g"), F.col("b")))
    rows = colour.with_oklab(luma, ["frame", "px", "luma"]).groupBy("frame").agg(F.avg("l").alias("l"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.transform(F.array_sort(F.collect_list(F.struct("px", "luma"))), lambda s: s["luma"]).alias("y"))
    step = lambda i, j: F.abs(F.get("y", i) - F.get("y", j))
    places = F.sequence(F.lit(0), F.size("y") - 1)
    right = F.transform(F.filter(places, lambda i: i % columns < columns - 1), lambda i: step(i, i + 1))
    down = F.transform(F.filter(places, lambda i: i + columns < F.size("y")), lambda i: step(i, i + columns))
    steps = F.concat(right, down)
    return rows.select("frame", "l", "a", "b", (F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(steps) / 255).alias("gradient"))


def change(hist: DataFrame, desc: DataFrame, clip: int) -> DataFrame:
    """(frame, distribution, mean, gradient, score) of each frame against the one before in its clip of `clip` frames."""
    now = hist.select("frame", "bin", F.sqrt("share").alias("now"), F.lit(0.0).alias("was"))
    was = hist.select((F.col("frame") + 1).alias("frame"), "bin", F.lit(0.0).alias("now"), F.sqrt("share").alias("was"))
    far = now.unionByName(was).groupBy("frame", "bin").agg(F.sum("now").alias("now"), F.sum("was").alias("was")).groupBy("frame").agg(F.sqrt(F.sum((F.col("now") - F.col("was")) ** 2)).alias("far"))
    before = desc.select((F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"{c}_") for c in ("l", "a", "b", "gradient")])
    both = desc.join(before, "frame").join(far, "frame").filter(F.col("frame") % clip != 0)
    step = F.sqrt(sum(((F.col(c) - F.col(f"{c}_")) ** 2 for c in "ab"), (F.col("l") - F.col("l_")) ** 2))
    parts = [F.least(F.lit(1.0), F.col("far") / F.sqrt(F.lit(2.0))), F.least(F.lit(1.0), step / SCALES[0]), F.least(F.lit(1.0), F.abs(F.col("gradient") - F.col("gradient_")) / SCALES[1])]
    return both.select("frame", *[p.alias(n) for p, n in zip(parts, ("distribution", "mean", "gradient"), strict=True)]).withColumn("score", sum((F.col(n) * w for n, w in zip(("mean", "gradient"), WEIGHTS[1:], strict=True)), F.col("distribution") * WEIGHTS[0]))


def stability(score: float, reason: str) -> float:
    """How much of the palette before a new block keeps."""
    if reason == "hard-cut":
        return 0.0
    return STRONGEST * min(1.0, max(0.0, 1 - (min(1.0, max(0.0, score)) - STABLE) / (FREE - STABLE)))


def blocks(hist: DataFrame, desc: DataFrame, clip: int, cut: float = CUT, drift: float = DRIFT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(clip, first, frames, reason, score, stability) of blocks of like frames; reason and score tell why a block began.

    A block's first frame is its anchor, so a clip is folded in order, as one group.
    """
    ship(hist.sparkSession)
    packed = hist.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("bin", "share"))).alias("h")).select("frame", F.col("h.bin").alias("bins"), F.col("h.share").alias("shares"))
    rows = packed.join(desc, "frame").withColumn("clip", F.floor(F.col("frame") / clip))
    size = BINS[0] * BINS[1] * BINS[2]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        roots = np.zeros((len(pdf), size))
        for k, (b, s) in enumerate(zip(pdf["bins"], pdf["shares"], strict=True)):
            roots[k, b] = np.sqrt(s)
        lab, gradient, frame = pdf[["l", "a", "b"]].to_numpy(), pdf["gradient"].to_numpy(), pdf["frame"].to_numpy()

        def score(i: int, j: int) -> float:
            parts = np.linalg.norm(roots[i] - roots[j]) / np.sqrt(2), np.linalg.norm(lab[i] - lab[j]) / SCALES[0], abs(gradient[i] - gradient[j]) / SCALES[1]
            return float(sum(w * min(1.0, p) for w, p in zip(WEIGHTS, parts, strict=True)))

        out, first = [[0, "start-of-stream", 1.0]], 0
        for k in range(1, len(pdf)):
            near, far = score(k - 1, k), score(first, k)
            reason = "hard-cut" if near >= cut else "max-frames" if k - first >= most else "color-drift" if k - first >= least and far >= drift else None
            if reason:
                out.append([k, reason, near if reason == "hard-cut" else far])
                first = k
        ends = [x[0] for x in out[1:]] + [len(pdf)]
        c = int(pdf["clip"].iloc[0])
        return pd.DataFrame([(c, frame[a], e - a, why, s, stability(s, why) if a else 0.0) for (a, why, s), e in zip(out, ends, strict=True)], columns=["clip", "first", "frames", "reason", "score", "stability"])

    return rows.groupBy("clip").applyInPandas(run, "clip bigint, first bigint, frames bigint, reason string, score double, stability double")


def merge_rare(tiles: DataFrame, palette: Column, budget: float) -> DataFrame:
    """Tiles (.., values: array of (index, target)) with the merge of their rarest index, if it has CROSSINGS distinct ones.

    The other index is that of the least worst extra error over the rarest one's cells, of equals the lowest;
    over the budget nothing is merged. Adds rare, into, worst and cells. palette: index to target, an array.
    """
    error = lambda k, t: F.abs(F.get(palette, k) - t)
    kinds = F.array_sort(F.array_distinct(F.transform("values", lambda v: v["index"])))
    rows = tiles.withColumn("kinds_", kinds).filter(F.size("kinds_").isin(*CROSSINGS))
    count = lambda k: F.size(F.filter("values", lambda v: v["index"] == k))
    rows = rows.withColumn("rare", F.array_min(F.transform("kinds_", lambda k: F.struct(count(k).alias("n"), k.alias("k"))))["k"])
    rows = rows.withColumn("targets_", F.transform(F.filter("values", lambda v: v["index"] == F.col("rare")), lambda v: v["target"]))
    worst = lambda k: F.array_max(F.transform("targets_", lambda t: error(k, t) - error(F.col("rare"), t)))
    best = F.array_min(F.transform(F.filter("kinds_", lambda k: k != F.col("rare")), lambda k: F.struct(worst(k).alias("worst"), k.alias("k"))))
    return rows.withColumn("best_", best).filter(F.col("best_.worst") <= budget).withColumns({"into": F.col("best_.k"), "worst": F.col("best_.worst"), "cells": F.size("targets_")}).drop("kinds_", "targets_", "best_", "values")


def bleed(values: Column, columns: int, steps: int = 8) -> Column:
    """An array of cells whose nulls took, step by step, the rounded mean of their known neighbours (4 of them)."""
    size = F.size(values)

    def grown(now: Column, i: Column) -> Column:
        near = F.filter(F.array(
            F.when(i % columns > 0, F.get(now, i - 1)), F.when(i % columns < columns - 1, F.get(now, i + 1)),
            F.when(i >= columns, F.get(now, i - columns)), F.when(i + columns < size, F.get(now, i + columns))), lambda v: v.isNotNull())
        mean = F.floor((F.aggregate(near, F.lit(0), lambda s, v: s + v) + F.floor(F.size(near) / 2)) / F.size(near)).cast("int")
        return F.coalesce(F.get(now, i), F.when(F.size(near) > 0, mean))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), values, lambda now, _: F.transform(F.sequence(F.lit(0), size - 1), lambda i: grown(now, i)))
