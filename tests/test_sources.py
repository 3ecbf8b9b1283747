import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.operators import folds
from tessera.sources import media, sidecars

COLOURS = bytes(range(30))


def sample(**change):
    given = {
        "patches": [(2, 2, bytes([246, 247, 248, 255]))] * 12,
        "slots": [(0, 0, 2, 2, 0, 9, 1), (4, 4, 2, 2, 5, 9, 1)],
        "fields": [{"field": 7, "kind": 0, "slots": [0, 1], "low": 0, "high": 99, "pad": 1, "patch_base": 0}],
        "colours": COLOURS,
    } | change
    return sidecars.pack(given["patches"], given["slots"], given["fields"], given["colours"])


def test_sidecar_round_trip():
    got = sidecars.parse(sample(), 40, 30, 10)
    assert [(s["x"], s["start"], s["stop"]) for s in got["slots"]] == [(0, 0, 9), (4, 5, 9)]
    assert got["fields"][0]["slots"] == [0, 1] and got["patches"][0]["data"] == bytes([246, 247, 248, 255])


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("patch values", {"patches": [(1, 1, bytes([3]))]}),
        ("bounds", {"slots": [(39, 0, 2, 2, 0, 9, 1)] * 2}),
        ("interval", {"slots": [(0, 0, 2, 2, 5, 3, 1), (4, 4, 2, 2, 5, 9, 1)]}),
        ("overlap", {"slots": [(0, 0, 2, 2, 0, 9, 1), (1, 1, 2, 2, 9, 9, 1)]}),
        ("field", {"fields": [{"field": 7, "kind": 0, "slots": [5], "low": 0, "high": 9, "pad": 0, "patch_base": 0}]}),
        ("field range", {"fields": [{"field": 7, "kind": 0, "slots": [0], "low": 0, "high": 10, "pad": 0, "patch_base": 0}]}),
    ],
)
def test_sidecar_rules(rule, change):
    with pytest.raises(ValueError, match=rule):
        sidecars.parse(sample(**change), 40, 30, 10)


def test_sidecar_damage():
    data = bytearray(sample())
    data[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        sidecars.parse(bytes(data), 40, 30, 10)


def test_y4m(spark, tmp_path):
    rng = np.random.default_rng(7)
    frames = [rng.integers(0, 256, 8 * 4 * 3 // 2).astype(np.uint8).tobytes() for _ in range(3)]
    (tmp_path / "a.y4m").write_bytes(b"YUV4MPEG2 W8 H4 F15:1 C420jpeg\n" + b"".join(b"FRAME\n" + f for f in frames) + b"FRAME\nxx")
    got = media.read_y4m(spark, str(tmp_path)).orderBy("frame").collect()
    assert [bytes(r["y"]) + bytes(r["cb"]) + bytes(r["cr"]) for r in got] == frames
    with pytest.raises(ValueError):
        media.y4m_frames(b"YUV4MPEG2 W7 H4\n")


def test_tsv(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("ssim", T.DoubleType())])
    rows = spark.createDataFrame([("a", 5, 0.5), ("b", None, None)], schema)
    media.tsv_lines(rows, ["matrix"]).coalesce(1).write.text(str(tmp_path / "t"))
    got = media.read_tsv(spark, str(tmp_path / "t"), schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 5, 0.5), ("b", None, None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.tsv").write_text("# c\na\t1\nb\t2\t0.1\nb\t3\t0.2\n")
    assert [tuple(r) for r in media.read_tsv(spark, str(tmp_path / "bad"), schema, strict=False).collect()] == [("b", 2, 0.1)]
    with pytest.raises(Exception, match="number of columns"):
        media.read_tsv(spark, str(tmp_path / "bad"), schema).collect()


def test_greedy_assignment_and_bleed():
    assert folds.assign_greedily(np.array([[1, 1], [0, 5]])) == [(0, 1), (1, 0)]
    known = np.array([[True, False, False, True]])
    assert folds.bleed(np.array([[10, 0, 0, 40]]), known, 1).tolist() == [[10, 10, 40, 40]]
    assert folds.bleed(np.array([[8, 0, 0, 0]]), np.array([[True, False, False, False]]), 8).tolist() == [[8, 8, 8, 8]]


def test_segments():
    step = folds.segment(0.58, 0.20, 2, 4)

    class Row:
        def __init__(self, frame, score):
            self.clip, self.frame, self.score = 0, frame, score

    state, got = (-1, 0, None, None), []
    for k, s in enumerate([0, 0, 0, 0, 0, 0.9, 0.95, 1.15, 1.15]):
        state, out = step(state, Row(k, s))
        got.append(out[2:])
    assert got == [(0, "start"), (0, ""), (0, ""), (0, ""), (1, "length"), (2, "cut"), (2, ""), (3, "drift"), (3, "")]


def test_kmeans(spark):
    pts = spark.createDataFrame([(0, 0, 3), (1, 0, 1), (10, 10, 1), (11, 10, 1)], "r long, g long, weight long")
    got = folds.kmeans(pts, ["r", "g"], 2, 3).orderBy("centre").collect()
    assert [(r["r"], r["g"], r["n"]) for r in got] == [(0.25, 0.0, 4), (10.5, 10.0, 2)]
