import numpy as np
import pytest

from tessera.functions import tiles
from tessera.sources import clips

GRAY = bytes(v for k in range(256) for v in (k, k, k))


def scene(seed, frames, rows, cols):
    rng = np.random.default_rng(seed)
    out, now = [], rng.integers(0, 256, rows * cols).astype(np.uint8)
    for k in range(frames):
        now = now.copy()
        if k % 3:
            now[rng.integers(0, rows * cols, 5)] = rng.integers(0, 256, 5)
        if k % 4 == 3:
            now[: cols * 4] = rng.integers(0, 3)
        out.append(now)
    return out


@pytest.mark.parametrize("differential", [False, True])
@pytest.mark.parametrize("size", [4, 16])
def test_each_coding_decodes(size, differential):
    rows, cols = 19, 35
    before = None
    for frame in scene(812, 9, rows, cols):
        for tag, payload in tiles.codings(frame, before, rows, cols, size=size, differential=differential):
            assert (tiles.decode(tag, payload, before, rows, cols, size=size, differential=differential) == frame).all(), tag
        before = frame


@pytest.mark.parametrize("predictor", range(5))
def test_predictors_invert(predictor):
    a, b = scene(221, 2, 7, 11)
    assert (tiles.restored(tiles.residual(a, b, 7, 11, predictor), b, 7, 11, predictor) == a).all()


@pytest.mark.parametrize("version", [1, 2, 3])
def test_clip_round_trip(version):
    cells = scene(77, 8, 9, 13)
    clip = clips.build([c.tobytes() for c in cells], 13, 9, [GRAY] + [b""] * 7, version=version, tile_size=4, keyint=5)
    h, found = clips.frames_of(clip)
    assert [f[-1] for f in found] == [c.tobytes() for c in cells]
    assert h["n_frames"] == 8 and h["version"] == version
    assert clips.unbundle(clips.bundle(clip, b"sound", b"meta" if version == 3 else b""))[:2] == (clip, b"sound")


@pytest.mark.parametrize("version", [1, 2, 3])
def test_damage_is_found(version):
    cells = scene(5, 4, 6, 6)
    clip = bytearray(clips.build([c.tobytes() for c in cells], 6, 6, [GRAY] + [b""] * 3, version=version, tile_size=4))
    for at in (0, 4, len(clip) - 1, 40):
        bad = bytearray(clip)
        bad[at] ^= 0xFF
        with pytest.raises(ValueError):
            clips.frames_of(bytes(bad))
    with pytest.raises(ValueError):
        clips.frames_of(bytes(clip) + b"x")


def test_overlong_number():
    with pytest.raises(ValueError):
        tiles.Cursor(b"\x80\x00").uvarint()
    for v in (0, 127, 128, 16383, 16384, 2**32 - 1):
        assert tiles.Cursor(tiles.uvarint(v)).uvarint() == v


def test_files(spark, tmp_path):
    cells = scene(3, 4, 6, 6)
    for v in (1, 3):
        (tmp_path / f"c{v}.bin").write_bytes(clips.bundle(clips.build([c.tobytes() for c in cells], 6, 6, [GRAY] + [b""] * 3, version=v, tile_size=4)))
    got = clips.read(spark, str(tmp_path)).orderBy("path", "frame").collect()
    assert [bytes(r["cells"]) for r in got] == [c.tobytes() for c in cells] * 2
