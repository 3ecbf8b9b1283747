"""Work along the frames of a clip, all cells at once; its SQL, by windows over single cells, stands in the modules of the subjects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import loops
from tessera.plans.registry import plan
from tessera.sources import adapters

KEY = adapters.KEYINT


@plan("change_mask_bytes")
def change_mask_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        changed = loops.changes(m)
        changed[0] = False
        return loops.numbered(first, m, mask=loops.bits(changed).astype(np.int64)).rename(columns={"place_": "byte_"})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, byte_ bigint, mask bigint")


@plan("sparse_offset_delta")
def sparse_offset_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed cells, each by the number of cells since the one before."""
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        frame, cell = np.nonzero(loops.changes(m))
        frame, cell = frame[frame > 0], cell[frame > 0]
        opens = np.r_[True, frame[1:] != frame[:-1]] if len(frame) else np.zeros(0, bool)
        before = np.where(opens, -1, np.r_[0, cell[:-1]]) if len(frame) else cell
        return pd.DataFrame({"frame": first + frame, "cell": cell, "delta": cell - before - 1, "value": m[frame, cell]})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, cell bigint, delta bigint, value bigint")


@plan("predictor_prev_sub")
def predictor_prev_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        return loops.numbered(first, m, residual=(m - np.concatenate([np.zeros_like(m[:1]), m[:-1]])) % 256).rename(columns={"place_": "cell"})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, cell bigint, residual bigint")


@plan("predictor_prev_xor")
def predictor_prev_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        return loops.numbered(first, m, residual=m ^ np.concatenate([np.zeros_like(m[:1]), m[:-1]])).rename(columns={"place_": "cell"})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, cell bigint, residual bigint")


@plan("delta_replay_last_value")
def delta_replay_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames and changes alone are kept, then played: each frame is the one before with its changes written over."""
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        key = (first + np.arange(len(m))) % KEY == 0
        written = [(k, np.flatnonzero(c), m[k][c]) for k, c in enumerate(loops.changes(m) | key[:, None])]
        shown, out = np.zeros(m.shape[1], np.int64), np.empty_like(m)
        for k, cells, values in written:
            shown[cells] = values
            out[k] = shown
        return loops.numbered(first, m, value=out).rename(columns={"place_": "cell"})

    got = loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, cell bigint, value bigint")
    return got.select("frame", "cell", F.floor(F.col("frame") / KEY).alias("key_group"), "value")


@plan("temporal_error")
def temporal_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        coarse = m - m % 8
        error = np.abs((coarse[1:] - coarse[:-1]) - (m[1:] - m[:-1])).mean(1)
        return pd.DataFrame({"frame": first + 1 + np.arange(len(error)), "temporal_error": error})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, temporal_error double").withColumn("temporal_error", F.round("temporal_error", 6))


@plan("keyframe_schedule")
def keyframe_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames where they are due and at hard cuts; frames count on from the last one."""
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        frame = first + np.arange(len(m))
        moved = np.r_[0, loops.differences(m, 1)]
        cut = moved > 1250
        key = cut | (frame % KEY == 0)
        at = np.maximum.accumulate(np.where(key, np.arange(len(m)), -1))
        return pd.DataFrame({"frame": frame, "moved": moved, "hard_cut": cut, "is_key": key, "key_group": np.cumsum(key), "chain": np.where(at < 0, np.arange(len(m)), np.arange(len(m)) - at)})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, moved bigint, hard_cut boolean, is_key boolean, key_group bigint, chain bigint")


@plan("white_frames")
def white_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        mean = m.mean(1)
        jump = pd.Series(np.abs(np.diff(mean, prepend=np.nan))).astype(object).where(lambda s: s.notna(), None)
        return pd.DataFrame({"frame": first + np.arange(len(m)), "mean": mean, "white": (m >= 140).mean(1), "jump": jump})

    got = loops.by_clip(adapters.packed(spark, sf_dir), run, "frame bigint, mean double, white double, jump double")
    return got.select("frame", F.round("mean", 6).alias("mean"), F.round("white", 6).alias("white"), (F.col("white") >= 0.3).alias("near_white"), F.round("jump", 6).alias("jump"))


@plan("empty_gaps")
def empty_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without a bright cell between two frames that have one."""
    def run(_: int, first: int, m: np.ndarray) -> pd.DataFrame:
        full = np.flatnonzero(m.max(1) >= 168)
        gap = np.diff(full) - 1
        return pd.DataFrame({"gap_start": first + full[:-1][gap > 0] + 1, "gap_frames": gap[gap > 0]})

    return loops.by_clip(adapters.packed(spark, sf_dir), run, "gap_start bigint, gap_frames bigint")
