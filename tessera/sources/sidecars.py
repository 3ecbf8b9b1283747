"""Overlay sidecars: patches, slots and fields in one binary file, versions 1 and 2.

`parse` checks a file as a whole and gives plain rows; `pack` writes version 2. All or nothing: a
file that breaks a rule gives no rows but a ValueError that names the rule.
"""

from __future__ import annotations

import struct
import zlib

# Fixed values of the format.
MAGIC = b"ASCLSLOT"
DIGITS, CHOICE = 0, 1
HEADERS = {1: struct.Struct("<8sBBBBHHHH30sI"), 2: struct.Struct("<8sBBBBHHHI")}
SLOTS = {1: struct.Struct("<HHIIB"), 2: struct.Struct("<HHHHIIB")}
MAX_SLOTS, MAX_PATCHES, MAX_PATCH_AREA, MAX_PATCH_BYTES, MAX_SPAN = 1024, 512, 4096, 262144, 511


def need(ok: bool, rule: str) -> None:
    if not ok:
        raise ValueError(rule)


def parse(data: bytes, cols: int, rows: int, n_frames: int) -> dict[str, list[dict]]:
    need(data[:8] == MAGIC and len(data) > 8 and data[8] in HEADERS, "magic")
    version = data[8]
    fixed = HEADERS[version]
    need(len(data) >= fixed.size, "length")
    h = fixed.unpack_from(data)
    at = fixed.size
    need(zlib.crc32(data[at:]) == h[-1], "checksum")
    reserved = h[3]
    if version == 1:
        sizes = [(h[5], h[6])] * h[4]
        n_slots, n_fields, colours = h[7], h[8], h[9]
    else:
        n_slots, n_fields = h[6], h[7]
        need(10 <= reserved <= 64 and len(data) >= at + 3 * reserved + 4 * h[5], "length")
        colours, at = data[at : at + 3 * reserved], at + 3 * reserved
        sizes = [struct.unpack_from("<HH", data, at + 4 * k) for k in range(h[5])]
        at += 4 * h[5]
    need(n_slots <= MAX_SLOTS and len(sizes) <= MAX_PATCHES, "counts")
    need(all(0 < w * ht <= MAX_PATCH_AREA for w, ht in sizes) and sum(w * ht for w, ht in sizes) <= MAX_PATCH_BYTES, "patch area")
    patches = []
    for k, (w, ht) in enumerate(sizes):
        need(at + w * ht <= len(data), "length")
        body = data[at : at + w * ht]
        need(min(body) >= 256 - reserved, "patch values")
        patches.append({"patch": k, "w": w, "h": ht, "data": body})
        at += w * ht
    slots = []
    for k in range(n_slots):
        need(at + SLOTS[version].size <= len(data), "length")
        v = SLOTS[version].unpack_from(data, at)
        at += SLOTS[version].size
        x, y, w, ht, start, stop, flags = v if version == 2 else (*v[:2], h[5], h[6], *v[2:])
        need(w > 0 and ht > 0 and x + w <= cols and y + ht <= rows, "bounds")
        need(start <= stop < n_frames, "interval")
        slots.append({"slot": k, "x": x, "y": y, "w": w, "h": ht, "start": start, "stop": stop, "flags": flags})
    fields = []
    for _ in range(n_fields):
        head = struct.Struct("<HBB" if version == 2 else "<HB")
        need(at + head.size <= len(data), "length")
        v = head.unpack_from(data, at)
        field, kind, count = (v[0], v[1], v[2]) if version == 2 else (v[0], DIGITS, v[1])
        at += head.size
        tail = struct.Struct(f"<{count}HIIB" + "H" * (version == 2))
        need(count > 0 and at + tail.size <= len(data), "length")
        v = tail.unpack_from(data, at)
        at += tail.size
        low, high, pad = v[count : count + 3]
        base = v[count + 3] if version == 2 else 0
        need(all(s < n_slots for s in v[:count]) and low <= high, "field")
        need(kind in (DIGITS, CHOICE) and (high < 10**count if kind == DIGITS else count == 1 and high - low <= MAX_SPAN and base + high - low < len(sizes)), "field range")
        fields.append({"field": field, "kind": kind, "slots": list(v[:count]), "low": low, "high": high, "pad": pad, "patch_base": base})
    need(at == len(data), "length")
    areas(slots, cols, rows, version)
    return {"patches": patches, "slots": slots, "fields": fields, "colours": [{"rgb": colours}]}


def areas(slots: list[dict], cols: int, rows: int, version: int) -> None:
    """Overlap and area rules: an event sweep over the starts and ends of the active slots."""
    for k, a in enumerate(slots):
        for b in slots[k + 1 :]:
            space = a["x"] < b["x"] + b["w"] and b["x"] < a["x"] + a["w"] and a["y"] < b["y"] + b["h"] and b["y"] < a["y"] + a["h"]
            need(not (space and (version == 1 or (a["start"] <= b["stop"] and b["start"] <= a["stop"]))), "overlap")
    total = sum(s["w"] * s["h"] for s in slots)
    if version == 1:
        need(20 * total <= cols * rows, "area")
        return
    need(4 * total <= cols * rows, "total area")
    events = sorted(e for s in slots for e in ((s["start"], s["w"] * s["h"]), (s["stop"] + 1, -s["w"] * s["h"])))
    now = 0
    for _, change in sorted(events):
        now += change
        need(20 * now <= cols * rows, "active area")


def pack(patches: list[tuple[int, int, bytes]], slots: list[tuple], fields: list[dict], colours: bytes) -> bytes:
    reserved = len(colours) // 3
    body = bytearray(colours)
    for w, h, _ in patches:
        body += struct.pack("<HH", w, h)
    for _, _, data in patches:
        body += data
    for s in slots:
        body += SLOTS[2].pack(*s)
    for f in fields:
        ids = f["slots"]
        body += struct.pack(f"<HBB{len(ids)}HIIBH", f["field"], f["kind"], len(ids), *ids, f["low"], f["high"], f["pad"], f["patch_base"])
    return HEADERS[2].pack(MAGIC, 2, 0, reserved, 0, len(patches), len(slots), len(fields), zlib.crc32(bytes(body))) + bytes(body)
