"""Frame payloads: tile streams, change lists and masks, predictors; whole frames in, bytes out.

A frame is a bytes-like row-major matrix of one byte a cell (tile streams and predictors) or of
`depth` bytes a cell (change lists and masks). Decoders check all of a payload before they return,
and raise ValueError on what is out of bounds, overlong, left over or not canonical.
"""

from __future__ import annotations

import zlib

import numpy as np

# Fixed values of the format: frame tags and tile opcodes.
RAW, ZLIB, DELTA, DELTA_MASK = 0, 1, 2, 3
REGIONAL_KEY_RAW, REGIONAL_KEY_ZLIB, REGIONAL_DELTA_RAW, REGIONAL_DELTA_ZLIB = 4, 5, 6, 7
PREDICT_KEY_ZLIB, PREDICT_DELTA_ZLIB = 8, 9
SKIP_RUN, SOLID, SPARSE, MASK, PACK1, PACK2, PAL4, PAL8 = 0, 1, 2, 3, 4, 5, 6, 7
LEFT, TOP, GRADIENT, PREVIOUS_SUB, PREVIOUS_XOR = 0, 1, 2, 3, 4
#: Order in which equally short codings of a tile are preferred.
PREFERRED = (SOLID, SPARSE, MASK, PACK1, PACK2, PAL4, PAL8)


def inflate(data: bytes, most: int) -> bytes:
    """At most `most` bytes; more, or anything after the stream, is an error."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise ValueError(f"bad deflate stream: {e}") from None
    if len(out) > most or not d.eof or d.unused_data or d.unconsumed_tail:
        raise ValueError("the deflate stream is too long, cut short or followed by more")
    return out


def uvarint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes([*out, v])


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the stream is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def uvarint(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                if (shift and not b) or value > 0xFFFFFFFF:
                    raise ValueError("a number is overlong")
                return value
            shift += 7
            if shift > 28:
                raise ValueError("a number is overlong")


def packed(codes: np.ndarray, bits: int) -> bytes:
    """Codes of 1, 2 or 4 bits, the first in the lowest bits."""
    return np.packbits((codes[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    if flat[n * bits :].any():
        raise ValueError("padding bits are set")
    return (flat[: n * bits].reshape(n, bits) << np.arange(bits)).sum(1)


def tiles(rows: int, cols: int, size: int):
    """Flat cell numbers of each tile, row by row, clipped at the borders."""
    grid = np.arange(rows * cols).reshape(rows, cols)
    for y in range(0, rows, size):
        for x in range(0, cols, size):
            yield grid[y : y + size, x : x + size].ravel()


def tile_codings(new: np.ndarray, old: np.ndarray | None, differential: bool) -> dict[int, bytes]:
    """Every coding that a tile can have, without SKIP_RUN."""
    values = np.unique(new)
    out = {PAL8: bytes([PAL8]) + new.tobytes()}
    codes = np.searchsorted(values, new)
    if len(values) == 1:
        out[SOLID] = bytes([SOLID, values[0]])
    elif len(values) == 2:
        out[PACK1] = bytes([PACK1]) + values.tobytes() + packed(codes, 1)
    elif len(values) <= 4:
        out[PACK2] = bytes([PACK2, len(values)]) + values.tobytes() + packed(codes, 2)
    elif len(values) <= 16:
        out[PAL4] = bytes([PAL4, len(values)]) + values.tobytes() + packed(codes, 4)
    if old is not None:
        at = np.flatnonzero(new != old)
        if len(at):
            steps = np.diff(at, prepend=-1) - 1 if differential else at
            out[SPARSE] = bytes([SPARSE]) + uvarint(len(at)) + b"".join(uvarint(int(s)) + bytes([new[a]]) for s, a in zip(steps, at, strict=True))
            out[MASK] = bytes([MASK]) + packed((new != old).astype(np.int64), 1) + new[at].tobytes()
    return out


def encode_tiles(frame: np.ndarray, before: np.ndarray | None, rows: int, cols: int, size: int, differential: bool) -> bytes:
    out, skipped = bytearray(), 0
    for at in tiles(rows, cols, size):
        new, old = frame[at], None if before is None else before[at]
        if old is not None and (new == old).all():
            skipped += 1
            continue
        if skipped:
            out += bytes([SKIP_RUN]) + uvarint(skipped)
            skipped = 0
        found = tile_codings(new, old, differential)
        out += min((found[k] for k in PREFERRED if k in found), key=len)
    if skipped:
        out += bytes([SKIP_RUN]) + uvarint(skipped)
    return bytes(out)


def decode_tiles(data: bytes, before: np.ndarray | None, rows: int, cols: int, size: int, differential: bool) -> np.ndarray:
    c, places = Cursor(data), list(tiles(rows, cols, size))
    out = np.zeros(rows * cols, np.uint8) if before is None else before.copy()
    k = 0
    while k < len(places):
        op, at = c.take(1)[0], places[k]
        n = len(at)
        if op in (SKIP_RUN, SPARSE, MASK) and before is None:
            raise ValueError("a key frame refers to the frame before")
        if op == SKIP_RUN:
            run = c.uvarint()
            if not 0 < run <= len(places) - k:
                raise ValueError("a run leaves the grid")
            k += run
            continue
        if op == SOLID:
            out[at] = c.take(1)[0]
        elif op == SPARSE:
            count, last = c.uvarint(), -1
            if not 0 < count <= n:
                raise ValueError("bad number of changes")
            for _ in range(count):
                step = c.uvarint()
                place = last + 1 + step if differential else step
                value = c.take(1)[0]
                if not last < place < n or out[at[place]] == value:
                    raise ValueError("a change is out of order or none")
                out[at[place]], last = value, place
        elif op == MASK:
            mask = unpacked(c.take(-(-n // 8)), 1, n).astype(bool)
            values = np.frombuffer(c.take(int(mask.sum())), np.uint8)
            if not mask.any() or (out[at[mask]] == values).any():
                raise ValueError("a change is none")
            out[at[mask]] = values
        elif op in (PACK1, PACK2, PAL4):
            bits = {PACK1: 1, PACK2: 2, PAL4: 4}[op]
            count = 2 if op == PACK1 else c.take(1)[0]
            if not {PACK1: 2, PACK2: 3, PAL4: 5}[op] <= count <= 1 << bits:
                raise ValueError("bad size of a local map")
            values = np.frombuffer(c.take(count), np.uint8)
            codes = unpacked(c.take(-(-n * bits // 8)), bits, n)
            if (np.diff(values.astype(int)) <= 0).any() or codes.max() >= count:
                raise ValueError("a local map is out of order or too short")
            out[at] = values[codes]
        elif op == PAL8:
            out[at] = np.frombuffer(c.take(n), np.uint8)
        else:
            raise ValueError(f"no opcode {op}")
        k += 1
    if c.at != len(data):
        raise ValueError("more follows the last tile")
    return out


def residual(frame: np.ndarray, before: np.ndarray | None, rows: int, cols: int, predictor: int) -> np.ndarray:
    """What is left of a frame after a predictor, modulo 256."""
    if predictor in (PREVIOUS_SUB, PREVIOUS_XOR):
        return frame - before if predictor == PREVIOUS_SUB else frame ^ before
    m = np.pad(frame.reshape(rows, cols), ((1, 0), (1, 0)))
    left, top, corner = m[1:, :-1], m[:-1, 1:], m[:-1, :-1]
    guess = {LEFT: left, TOP: top, GRADIENT: left + top - corner}[predictor]
    return (m[1:, 1:] - guess).ravel()


def restored(left_over: np.ndarray, before: np.ndarray | None, rows: int, cols: int, predictor: int) -> np.ndarray:
    """The frame of a residual: sums along rows, columns or both."""
    if predictor in (PREVIOUS_SUB, PREVIOUS_XOR):
        return left_over + before if predictor == PREVIOUS_SUB else left_over ^ before
    m = left_over.reshape(rows, cols)
    if predictor in (LEFT, GRADIENT):
        m = np.cumsum(m, axis=1, dtype=np.uint8)
    if predictor in (TOP, GRADIENT):
        m = np.cumsum(m, axis=0, dtype=np.uint8)
    return m.ravel()


def codings(frame: np.ndarray, before: np.ndarray | None, rows: int, cols: int, depth: int = 1, size: int = 0, differential: bool = False, level: int = 9) -> list[tuple[int, bytes]]:
    """(tag, payload) of every coding of a frame, in order of preference; size 0: without tiles."""
    whole = frame.tobytes()
    out = [(RAW, whole), (ZLIB, zlib.compress(whole, level))]
    if before is not None:
        a, b = frame.reshape(-1, depth), before.reshape(-1, depth)
        changed = (a != b).any(1)
        out.append((DELTA, zlib.compress(np.flatnonzero(changed).astype("<u4").tobytes() + a[changed].tobytes(), level)))
        out.append((DELTA_MASK, zlib.compress(packed(changed.astype(np.int64), 1) + a[changed].tobytes(), level)))
    if size and depth == 1:
        for prior, tags, predictors, tag in ((None, (REGIONAL_KEY_RAW, REGIONAL_KEY_ZLIB), (LEFT, TOP, GRADIENT), PREDICT_KEY_ZLIB), (before, (REGIONAL_DELTA_RAW, REGIONAL_DELTA_ZLIB), (PREVIOUS_SUB, PREVIOUS_XOR), PREDICT_DELTA_ZLIB)):
            if tag == PREDICT_DELTA_ZLIB and before is None:
                continue
            stream = encode_tiles(frame, prior, rows, cols, size, differential)
            out += [(tags[0], stream), (tags[1], zlib.compress(stream, level))]
            out.append((tag, min((bytes([p]) + zlib.compress(residual(frame, prior, rows, cols, p).tobytes(), level) for p in predictors), key=len)))
    return out


KEY_TAGS = frozenset((RAW, ZLIB, REGIONAL_KEY_RAW, REGIONAL_KEY_ZLIB, PREDICT_KEY_ZLIB))


def encode(frame: np.ndarray, before: np.ndarray | None, key: bool, **how) -> tuple[int, bytes]:
    """The shortest coding, of equals the one preferred; a key frame doesn't refer to the one before."""
    return min((c for c in codings(frame, None if key else before, **how)), key=lambda c: len(c[1]))


def decode(tag: int, payload: bytes, before: np.ndarray | None, rows: int, cols: int, depth: int = 1, size: int = 0, differential: bool = False) -> np.ndarray:
    cells, n = rows * cols, rows * cols * depth
    if tag not in KEY_TAGS and before is None:
        raise ValueError("a delta frame has none before it")
    if tag == RAW:
        if len(payload) != n:
            raise ValueError("a raw frame has another size")
        return np.frombuffer(payload, np.uint8).copy()
    if tag == ZLIB:
        return decode(RAW, inflate(payload, n), before, rows, cols, depth)
    if tag == DELTA:
        data = inflate(payload, cells * (4 + depth))
        count, rest = divmod(len(data), 4 + depth)
        at = np.frombuffer(data[: 4 * count], "<u4").astype(np.int64)
        if rest or count > cells or (at >= cells).any():
            raise ValueError("a change list leaves the grid")
        out = before.reshape(-1, depth).copy()
        for k, v in zip(at.tolist(), np.frombuffer(data[4 * count :], np.uint8).reshape(-1, depth), strict=True):
            out[k] = v  # of repeated places the last wins
        return out.ravel()
    if tag == DELTA_MASK:
        data = inflate(payload, -(-cells // 8) + n)
        mask = unpacked(data[: -(-cells // 8)].ljust(-(-cells // 8), b"\0"), 1, cells).astype(bool)
        values = np.frombuffer(data[-(-cells // 8) :], np.uint8)
        if len(values) != int(mask.sum()) * depth:
            raise ValueError("a mask and its values differ in number")
        out = before.reshape(-1, depth).copy()
        out[mask] = values.reshape(-1, depth)
        return out.ravel()
    if not size:
        raise ValueError(f"tag {tag} needs tiles")
    if tag in (REGIONAL_KEY_RAW, REGIONAL_DELTA_RAW):
        return decode_tiles(payload, before if tag == REGIONAL_DELTA_RAW else None, rows, cols, size, differential)
    if tag in (REGIONAL_KEY_ZLIB, REGIONAL_DELTA_ZLIB):
        return decode(tag - 1, inflate(payload, 4 * n + 64), before, rows, cols, depth, size, differential)
    if tag in (PREDICT_KEY_ZLIB, PREDICT_DELTA_ZLIB):
        if not payload or payload[0] not in ((LEFT, TOP, GRADIENT) if tag == PREDICT_KEY_ZLIB else (PREVIOUS_SUB, PREVIOUS_XOR)):
            raise ValueError("no such predictor")
        left_over = np.frombuffer(inflate(payload[1:], n), np.uint8)
        if len(left_over) != n:
            raise ValueError("a residual has another size")
        return restored(left_over, before, rows, cols, payload[0])
    raise ValueError(f"no tag {tag}")
