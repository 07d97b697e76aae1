"""Vector tile bytes (the public protobuf format), encoded and decoded."""

from __future__ import annotations

import math
import struct

import numpy as np

from geoloom.functions.shapes import twice_area

POINT, LINE, POLYGON = 1, 2, 3
GTYPES = {"point": POINT, "line": LINE, "polygon": POLYGON}
NAMES = {v: k for k, v in GTYPES.items()}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def unzigzag(n: int) -> int:
    return n // 2 if n % 2 == 0 else -(n + 1) // 2


def _field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def to_local(points: np.ndarray, z: int, x: int, y: int, extent: int) -> np.ndarray:
    """Longitudes and latitudes in the units of a tile, not rounded."""
    n = 2.0**z
    lat = np.radians(np.clip(points[:, 1], -85.051129, 85.051129))
    px = ((points[:, 0] + 180) / 360 * n - x) * extent
    py = ((1 - np.log(np.tan(lat) + 1 / np.cos(lat)) / math.pi) / 2 * n - y) * extent
    return np.column_stack([px, py])


def to_degrees(points: np.ndarray, z: int, x: int, y: int, extent: int) -> np.ndarray:
    n = 2.0**z
    lon = (x + points[:, 0] / extent) / n * 360 - 180
    lat = np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (y + points[:, 1] / extent) / n))))
    return np.column_stack([lon, lat])


def _rounded(points: np.ndarray) -> np.ndarray:
    return (np.sign(points) * np.floor(np.abs(points) + 0.5)).astype(np.int64)


def _commands(gtype: str, parts: list[list[np.ndarray]]) -> list[int]:
    """Geometry commands of tile-local parts; degenerate rings and lines are left out."""
    out: list[int] = []
    cursor = np.zeros(2, dtype=np.int64)
    for rings in parts:
        for k, ring in enumerate(rings):
            p = _rounded(ring)
            if gtype != "point":
                p = p[np.append(True, (p[1:] != p[:-1]).any(1))]
            if gtype == "polygon":
                if len(p) and (p[0] == p[-1]).all():
                    p = p[:-1]
                if len(p) < 3:
                    if k == 0:
                        break
                    continue
                area = twice_area(np.vstack([p, p[:1]]).astype(np.float64))
                if (area < 0) == (k == 0) and area != 0:  # in tile space outer rings have positive area
                    p = p[::-1]
            elif gtype == "line" and len(p) < 2:
                continue
            steps = np.diff(np.vstack([cursor, p]), axis=0)
            flat = [zigzag(int(v)) for v in steps.ravel()]
            out += [1 | 1 << 3, *flat[:2]]
            if len(p) > 1:
                out += [2 | (len(p) - 1) << 3, *flat[2:]]
            if gtype == "polygon":
                out.append(7 | 1 << 3)
            cursor = p[-1]
    return out


def encode_tile(layers: dict[str, list[tuple[int, str, list[list[np.ndarray]], dict[str, str]]]], extent: int = 4096) -> bytes | None:
    """Tile of layers of (id, gtype, tile-local parts, tags); None if nothing can be drawn."""
    tile: list[bytes] = []
    for name, features in layers.items():
        keys: dict[str, int] = {}
        values: dict[str, int] = {}
        body: list[bytes] = []
        for fid, gtype, parts, tags in features:
            commands = _commands(gtype, parts)
            if not commands:
                continue
            marks = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(v, len(values))) for k, v in tags.items())
            body.append(_field(2, _number(1, fid % (1 << 64)) + _field(2, marks) + _number(3, GTYPES[gtype]) + _field(4, b"".join(map(varint, commands)))))
        if body:
            tile.append(_field(3, _field(1, name.encode()) + b"".join(body) + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _field(1, v.encode())) for v in values) + _number(5, extent) + _number(15, 2)))
    return b"".join(tile) or None


def _read(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        shift += 7
        if b < 0x80:
            return value, at


def fields(data: bytes):
    """(number, wire type, value) of a message; a cut-off message ends the walk."""
    at = 0
    try:
        while at < len(data):
            key, at = _read(data, at)
            wire = key & 7
            if wire == 0:
                value, at = _read(data, at)
            elif wire == 2:
                size, at = _read(data, at)
                value, at = data[at : at + size], at + size
            elif wire == 5:
                value, at = data[at : at + 4], at + 4
            elif wire == 1:
                value, at = data[at : at + 8], at + 8
            else:
                return
            yield key >> 3, wire, value
    except IndexError:
        return


def value_text(data: bytes) -> str:
    """A tag value as text."""
    for number, _, v in fields(data):
        if number == 1:
            return v.decode("utf-8", "replace")
        if number in (2, 3):
            return repr(struct.unpack("<f" if number == 2 else "<d", v)[0])
        if number in (4, 5):
            return str(v - (1 << 64) if number == 4 and v >= 1 << 63 else v)
        if number == 6:
            return str(unzigzag(v))
        if number == 7:
            return "true" if v else "false"
    return ""


def _numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _read(data, at)
        out.append(v)
    return out


def _parts(gtype: str, commands: list[int]) -> list[list[np.ndarray]]:
    lines: list[list[tuple[int, int]]] = []
    x = y = i = 0
    while i < len(commands):
        command, count = commands[i] & 7, commands[i] >> 3
        i += 1
        if command == 7:
            if lines:
                lines[-1].append(lines[-1][0])
            continue
        for _ in range(count):
            x, y = x + unzigzag(commands[i]), y + unzigzag(commands[i + 1])
            i += 2
            if command == 1:
                lines.append([])
            lines[-1].append((x, y))
    rings = [np.array(line, dtype=np.float64) for line in lines]
    if gtype != "polygon":
        return [[r] for r in rings]
    out: list[list[np.ndarray]] = []
    for r in rings:
        if twice_area(r) > 0 or not out:
            out.append([r])
        else:
            out[-1].append(r)
    return out


def decode_tile(data: bytes, z: int, x: int, y: int) -> list[dict]:
    """Features of a tile: layer, id, class, name, tags (the others), gtype, parts in degrees (outer rings open new polygons)."""
    out = []
    for number, _, layer in fields(data):
        if number != 3:
            continue
        name, extent, keys, values, features = "", 4096, [], [], []
        for n, _, v in fields(layer):
            if n == 1:
                name = v.decode("utf-8", "replace")
            elif n == 2:
                features.append(v)
            elif n == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif n == 4:
                values.append(value_text(v))
            elif n == 5:
                extent = v
        for f in features:
            fid, marks, kind, commands = 0, [], 0, []
            for n, _, v in fields(f):
                if n == 1:
                    fid = v
                elif n == 2:
                    marks = _numbers(v)
                elif n == 3:
                    kind = v
                elif n == 4:
                    commands = _numbers(v)
            if kind not in NAMES:
                continue
            tags = {keys[a]: values[b] for a, b in zip(marks[::2], marks[1::2], strict=False) if a < len(keys) and b < len(values)}
            parts = [[to_degrees(r, z, x, y, extent) for r in rings] for rings in _parts(NAMES[kind], commands)]
            out.append({"layer": name, "id": fid - (1 << 64) if fid >= 1 << 63 else fid, "class": tags.pop("class", None), "name": tags.pop("name", None), "tags": tags, "gtype": NAMES[kind], "parts": parts})
    return out
