"""Operators whose next state depends on what was decided before: ordered folds by group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.frames import nearest
from tessera.session import ship


def fold(rows: DataFrame, by: str, order: list[str], step: Callable, state, schema: str) -> DataFrame:
    """Each group's rows in order through step(state, row) -> (state, outputs); outputs replace rows.

    A group is one task: fold by clip, channel or cell, never over a whole table.
    """
    ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = state, []
        for row in pdf.sort_values(order).itertuples(index=False):
            now, got = step(now, row)
            out.append(got)
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy(by).applyInPandas(run, schema)


def segment(cut: float, drift: float, least: int, most: int) -> Callable:
    """Adaptive blocks of rows (clip, frame, score): a hard cut, the greatest length, or a drift from
    the block's first row once the block has the least length."""

    def step(state, row):
        block, first, anchor, before = state
        length = row.frame - first
        reason = None
        if anchor is None:
            reason = "start"
        elif abs(row.score - before) >= cut:
            reason = "cut"
        elif length >= most:
            reason = "length"
        elif length >= least and abs(row.score - anchor) >= drift:
            reason = "drift"
        if reason:
            block, first, anchor = block + 1, row.frame, row.score
        return (block, first, anchor, row.score), (row.clip, row.frame, block, reason or "")

    return step


def assign_greedily(costs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, the cheapest first with both free; of equals the first in row order."""
    rows, cols, out = set(), set(), []
    for k in np.argsort(costs, axis=None, kind="stable").tolist():
        r, c = divmod(k, costs.shape[1])
        if r not in rows and c not in cols:
            out.append((r, c))
            rows.add(r)
            cols.add(c)
    return sorted(out)


def stabilise(palette: np.ndarray, before: np.ndarray, strength: float) -> np.ndarray:
    """A palette in the order of the one before, each entry where its nearest was, drawn to that by `strength`.

    Palettes of another size than the one before stay as they are.
    """
    if palette.shape != before.shape or not len(palette):
        return np.clip(np.rint(palette), 0, 255).astype(np.int64)
    costs = ((before[:, None] - palette[None]) ** 2).sum(2)
    order = np.array([c for _, c in assign_greedily(costs)])
    return np.clip(np.rint((1 - strength) * palette[order] + strength * before), 0, 255).astype(np.int64)


def kmeans(points: DataFrame, of: list[str], k: int, steps: int, weight: str = "weight", spread: bool = False) -> DataFrame:
    """Weighted k-means of aggregated points: farthest-point start, `steps` Lloyd rounds.

    Only the k centres (k at most 256) come to the driver in a round. The start is the point of the
    greatest weight, with `spread` that of the greatest weight times squared distance from the mean, and
    distances count times the weight; ties go to the least values. An empty cluster keeps its centre.
    """
    spark = points.sparkSession
    mean = points.agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in of]).first()
    far_off = sum(((F.col(c) - F.lit(mean[c])) ** 2 for c in of[1:]), (F.col(of[0]) - F.lit(mean[of[0]])) ** 2) * F.col(weight)
    first = points.orderBy(F.desc(far_off) if spread else F.desc(weight), *of).select(*of).first()
    if first is None:
        return spark.createDataFrame([], "centre bigint, " + ", ".join(f"{c} double" for c in of) + ", n bigint")
    centres = [tuple(float(v) for v in first)]
    frame = lambda: spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "centre bigint, " + ", ".join(f"{c} double" for c in of))
    while len(centres) < k:
        far = nearest(points, frame(), of).orderBy(F.desc(F.col("distance") * F.col(weight)) if spread else F.desc("distance"), *of).select(*of, "distance").first()
        if far["distance"] == 0:
            break
        centres.append(tuple(float(far[c]) for c in of))
    for _ in range(steps):
        near = nearest(points, frame(), of)
        sums = near.groupBy("centre").agg(F.sum(weight).alias("n"), *[F.sum(F.col(c) * F.col(weight)).alias(c) for c in of])
        for r in sums.collect():
            centres[r["centre"]] = tuple(r[c] / r["n"] for c in of)
    near = nearest(points, frame(), of).groupBy("centre").agg(F.sum(weight).alias("n"))
    return frame().join(near, "centre", "left").select("centre", *of, F.coalesce("n", F.lit(0)).alias("n"))


def bleed(values: np.ndarray, known: np.ndarray, steps: int = 8) -> np.ndarray:
    """Unknown places take the integer mean of their known neighbours (4 of them), step by step."""
    out, have = np.where(known, values, 0).astype(np.int64), known.copy()
    for _ in range(steps):
        p, h = np.pad(out * have, 1), np.pad(have.astype(np.int64), 1)
        around = lambda m: m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:]
        n, total = around(h), around(p)
        new = ~have & (n > 0)
        out[new] = total[new] // n[new]
        have |= new
    return out
