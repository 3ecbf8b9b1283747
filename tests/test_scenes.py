"""Loops, rules, boxes and palettes against plain code and fixed cases."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import colour, rules
from tessera.operators import folds, frames, loops, scenes
from tessera.sources import boxes


def test_a_still_scene_is_no_loop_and_a_moving_one_is():
    r = np.random.default_rng(1)
    still = 100 + r.integers(0, 2, (60, 64))  # its copies are no more like than its neighbours
    assert loops.loop(still, 4, 40, 128, 0.35) is None
    noise = r.integers(0, 256, (60, 16))
    assert loops.loop(noise, 4, 40, 32, 0.35) is None
    lap = r.integers(0, 256, (10, 16))
    clip = np.concatenate([r.integers(0, 256, (7, 16)), lap, lap, lap, lap[:3]])
    got = loops.loop(clip, 4, 40, 32, 0.35)
    assert (got["intro"], got["period"], got["laps"], got["tail"]) == (7, 10, 3, 3)


def test_longest_run():
    def plain(equal, gap):
        best, start, last = (0, 0), None, None
        for i, v in enumerate([*equal, *[False] * (gap + 2)]):
            if v:
                start, last = i if start is None else start, i
            elif start is not None and i - last > gap:
                best = (start, last - start + 1) if last - start + 1 > best[1] else best
                start = None
        return best

    r = random.Random(2)
    for _ in range(500):
        equal = [r.random() < 0.5 for _ in range(r.randrange(30))]
        assert loops.longest_run(np.array(equal, bool)) == plain(equal, loops.GAP)


def test_bleed_rounds_the_mean(spark):
    got = spark.createDataFrame([([1, None, 2, None, None, None, None, None, 9],)], "v array<int>").select(scenes.bleed(F.col("v"), 3, 1).alias("v")).first()["v"]
    assert got == [1, 2, 2, 1, None, 6, None, 9, 9]  # 1.5 and 5.5 go up


def test_coverage_and_reserved(spark):
    from tessera.plans import scenes as plans

    assert [k for k, _ in plans.COVERAGE] == [21, 74, 127, 180, 233] and len(plans.RESERVED) == 31
    table = spark.createDataFrame([(224 + k, *c) for k, c in enumerate(plans.RESERVED)], "centre long, r long, g long, b long")
    points = spark.createDataFrame([(k, *c) for k, c in enumerate(plans.RESERVED)], "k long, r long, g long, b long")
    names = ("ok_l", "ok_a", "ok_b")
    near = frames.nearest(colour.with_oklab(points, ["k"], names), colour.with_oklab(table, ["centre"], names), list(names))
    assert {x["k"]: x["centre"] for x in near.collect()} == {k: 224 + k for k in range(31)}


def test_gamut_keeps_what_fits(spark):
    rows = spark.createDataFrame([(0.5, 0.0, 0.0), (0.5, 0.9, -0.4), (1.0, 0.3, 0.0)], "l double, a double, b double")
    got = colour.gamut_factor(rows, ("l", "a", "b")).collect()
    assert got[0]["fits"] and got[0]["factor"] == 1 and 0 < got[1]["factor"] < 0.5 and got[2]["factor"] < 0.01
    m = colour.gamut_factor(rows, ("l", "a", "b")).select(*[c.alias(n) for c, n in zip(colour.linear_rgb(F.col("l"), F.col("a") * F.col("factor"), F.col("b") * F.col("factor")), "rgb", strict=True)])
    assert all(-1e-9 <= v <= 1 + 1e-9 for x in m.collect() for v in x)


def test_spans_of_all_widths_join_once(spark):
    r = random.Random(3)
    points = [(k,) for k in range(200)]
    spans = [(k, a, a + r.choice([0, 1, 15, 16, 60, -3])) for k in range(120) for a in [r.randrange(-20, 220)]]
    got = frames.interval_join(spark.createDataFrame(points, "t long"), "t", spark.createDataFrame(spans, "id long, a long, b long"), "a", "b", 16).collect()
    want = sorted((t, k) for (t,) in points for k, a, b in spans if a <= t <= b)
    assert sorted((x["t"], x["id"]) for x in got) == want


def test_overlaps(spark):
    r = random.Random(4)
    slots = [(k % 3, k, r.randrange(12), r.randrange(6), r.randint(1, 4), r.randint(1, 4), a, a + r.randrange(30)) for k in range(150) for a in [r.randrange(60)]]
    got = {(x["scene"], x["a"], x["b"]) for x in frames.overlaps(spark.createDataFrame(slots, "scene long, slot long, x long, y long, w long, h long, start long, stop long"), "scene", "slot").collect()}
    want = {(p[0], p[1], q[1]) for p in slots for q in slots if p[0] == q[0] and p[1] < q[1] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5] and p[6] <= q[7] and q[6] <= p[7]}
    assert got == want


def test_boxes():
    payloads = [bytes([k]) * (k % 9) for k in range(40)]
    for per in (1, 3, 7, 40, 99):
        data = boxes.build(payloads, per)
        assert [data[p : p + s] for _, _, p, s in boxes.samples(data)] == payloads
    assert boxes.samples(boxes.build([], 3)) == []
    long = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert boxes.tree(long) == [(b"free", b"abcd"), (b"mdat", b"rest")]
    for bad in (b"abc", struct.pack(">I4s", 99, b"free"), struct.pack(">I4s", 7, b"free") + b"x", struct.pack(">I4s", 1, b"free")):
        with pytest.raises(ValueError):
            boxes.tree(bad)


def test_stabilise():
    before = np.array([[0, 0, 0], [100, 100, 100], [200, 200, 200]])
    assert folds.stabilise(np.array([[204, 200, 200], [0, 4, 0], [100, 100, 104]]), before, 0.25).tolist() == [[0, 3, 0], [100, 100, 103], [203, 200, 200]]
    assert folds.stabilise(np.array([[1, 2, 3]]), before, 0.25).tolist() == [[1, 2, 3]]


def test_kmeans_is_the_plain_one(spark):
    r = np.random.default_rng(5)
    points, weight = r.normal(size=(60, 2)).round(3), r.integers(1, 5, 60)
    df = spark.createDataFrame([(*map(float, p), int(w)) for p, w in zip(points, weight, strict=True)], "a double, b double, weight long")
    got = sorted((x["a"], x["b"], x["n"]) for x in folds.kmeans(df, ["a", "b"], 4, 3, spread=True).collect())
    mean = np.average(points, axis=0, weights=weight)
    centres = [points[int((((points - mean) ** 2).sum(1) * weight).argmax())]]
    while len(centres) < 4:
        near = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[int((near * weight).argmax())])
    centres = np.array(centres)
    label = lambda: ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    for _ in range(3):
        k = label()
        centres = np.array([np.average(points[k == c], axis=0, weights=weight[k == c]) for c in range(4)])
    k = label()
    want = sorted((*centres[c], weight[k == c].sum()) for c in range(4))
    assert np.allclose(got, want)


def test_rules_on_fixed_cases(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("v")).first()["v"]
    assert ask(rules.pointer(F.lit("# x\n\n clip.0123456789ab.asclv \nrest"))) == "clip.0123456789ab.asclv" and ask(rules.pointer(F.lit("x\nclip.0123456789ab.asclv"))) == "" and ask(rules.pointer(F.lit(""))) == ""
    for header, total, want in (("bytes=0-9", 100, (206, 0, 9)), ("bytes=90-200", 100, (206, 90, 99)), ("bytes=-5", 100, (206, 95, 99)), ("bytes=-500", 100, (206, 0, 99)), ("bytes=100-", 100, (416, None, None)), ("bytes=-0", 100, (416, None, None)), (None, 100, (200, 0, 99)), ("bytes=a-b", 100, (200, 0, 99))):
        r = rules.byte_range(F.lit(header), F.lit(total))
        assert tuple(one.select(*[c.alias(n) for n, c in r.items()]).first()) == want, header
    assert ask(rules.rate(F.lit("30000/1001"))) == pytest.approx(29.97003) and ask(rules.rate(F.lit("25"))) == 25
    assert ask(rules.glyphs(F.lit(0), 3, F.lit(False))) == [10, 10, 0] and ask(rules.glyphs(F.lit(70), 3, F.lit(False))) == [10, 7, 0] and ask(rules.glyphs(F.lit(7), 3, F.lit(True), base=20)) == [20, 20, 27]
    assert tuple(ask(rules.level(F.lit(1280), F.lit(720), F.lit(10), F.lit(16)))) == (16, "5.0") and ask(rules.grid_rows(F.lit(2), F.lit(1), F.lit(5), F.lit(0), F.lit(True), 0.5)) == 2
