"""The compact device format: delta bit streams, area blobs, bundles of a region's grid cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import shapes, vocab
from geoloom.functions import tags as T
from geoloom.functions import text as X
from geoloom.operators.streamed import by_group

# The header and its limits.
MAGIC, VERSION, HEADER = b"TMAP", 3, 32
POI_CELL, LABEL_CELL, POI_NAME, LABEL_NAME, MOST_DELTAS = 6, 24, 32, 24, 254
BUNDLE_HEADER, BUNDLE_ENTRY = 20, 14
BUNDLE_MAGIC = b"TPAK"


def half_up(v: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.floor(np.abs(v) + 0.5)


def to_pixels(points: np.ndarray, box: shapes.Box, width: int, height: int) -> np.ndarray:
    """Pixels of longitudes and latitudes, north up, clamped to the display."""
    w, h = box[2] - box[0], box[3] - box[1]
    sx, sy = ((width - 1) / w if w > 0 else 0.0), ((height - 1) / h if h > 0 else 0.0)
    px = half_up((points[:, 0] - box[0]) * sx)
    py = height - 1 - half_up((points[:, 1] - box[1]) * sy)
    return np.column_stack([np.clip(px, 0, width - 1), np.clip(py, 0, height - 1)]).astype(np.int64)


def _bits(n: int) -> int:
    return min(max(int(n).bit_length(), 1), 8)


def pack_points(pixels: np.ndarray) -> bytes | None:
    """Count, first point, info byte and bit stream of a pixel line; None below two points.

    Per axis the deltas take the fewest bits; an axis whose deltas never change
    sign stores the sign once. A delta beyond eight bits with changing signs
    does not fit the format and is refused.
    """
    if len(pixels) < 2:
        return None
    d = np.diff(pixels, axis=0)
    if len(d) > MOST_DELTAS:
        raise ValueError("a record holds 254 deltas at most")
    bits: list[tuple[int, int]] = []
    info, widths, one_sign, magnitude = 0, [0, 0], [False, False], [0, 0]
    for axis in (0, 1):
        magnitude[axis] = _bits(np.abs(d[:, axis]).max())
        one_sign[axis] = bool((d[:, axis] >= 0).all() or (d[:, axis] <= 0).all())
        widths[axis] = magnitude[axis] + (not one_sign[axis])
        if widths[axis] > 8:
            raise ValueError("a delta with changing signs needs more than eight bits")
        info |= (widths[axis] - 1) << 3 * axis | one_sign[axis] << 6 + axis
    for axis in (0, 1):
        if one_sign[axis]:
            bits.append((int((d[:, axis] <= 0).all() and not (d[:, axis] >= 0).all()), 1))
    for row in d.tolist():
        for axis in (0, 1):
            sign = 0 if one_sign[axis] else int(row[axis] < 0) << magnitude[axis]
            bits.append((abs(row[axis]) | sign, widths[axis]))
    value = at = 0
    for v, n in bits:
        value |= v << at
        at += n
    return bytes([len(d) + 1, int(pixels[0, 0]), int(pixels[0, 1]), info]) + value.to_bytes((at + 7) // 8, "little")


def line_records(pixels: np.ndarray) -> Iterator[bytes]:
    """A pixel line as records that fit the format, one after another with a common point."""
    at = 0
    while at < len(pixels) - 1:
        n = min(MOST_DELTAS, len(pixels) - 1 - at)
        while True:
            try:
                yield pack_points(pixels[at : at + n + 1])
                break
            except ValueError:  # too wide with changing signs: a single step never is
                n = n // 2
        at += n


def unpack_points(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels of a packed line and the bytes it took."""
    count, x, y, info = data[:4]
    one_sign = [bool(info >> 6 & 1), bool(info >> 7 & 1)]
    widths = [(info & 7) + 1, (info >> 3 & 7) + 1]
    total = sum(one_sign) + (count - 1) * sum(widths)
    size = 4 + (total + 7) // 8
    value, at = int.from_bytes(data[4:size], "little"), 0

    def take(n: int) -> int:
        nonlocal at
        out = value >> at & ((1 << n) - 1)
        at += n
        return out

    negative = [bool(take(1)) if one_sign[a] else False for a in (0, 1)]
    points = [(x, y)]
    for _ in range(count - 1):
        step = []
        for a in (0, 1):
            raw = take(widths[a])
            if not one_sign[a]:
                top = widths[a] - 1
                raw = -(raw & ((1 << top) - 1)) if raw >> top else raw
            step.append(-raw if negative[a] else raw)
        points.append((points[-1][0] + step[0], points[-1][1] + step[1]))
    return np.array(points, dtype=np.int64), size


def header_bytes(box: shapes.Box, width: int, height: int, interval: int, features: int, pois: int, labels: int) -> bytes:
    for n in (features, pois, labels):
        if n > 0xFFFF:
            raise ValueError("more than 65535 records in one blob")
    return MAGIC + struct.pack(">4B4i3H2x", VERSION, width, height, interval, *(int(v * 1_000_000) for v in box), features, pois, labels)


def read_header(blob: bytes) -> dict | None:
    """The header's fields; None for anything that is no blob."""
    if len(blob) < HEADER or blob[:4] != MAGIC:
        return None
    names = "version display_width display_height contour_interval min_lon min_lat max_lon max_lat features pois labels".split()
    return dict(zip(names, struct.unpack(">4B4i3H", blob[4:30]), strict=True))


def marked(features: DataFrame) -> DataFrame:
    """Adds what the blob needs of each feature: shown, poi, labelled, category, subcategory, poi_type, area, elevation, name, short_name."""
    layer, cls, t = F.col("layer"), F.col("class"), F.col("tags")
    name = F.coalesce(T.tag(t, "name"), F.lit(""))
    return features.withColumns({
        "shown": T.trail_relevant(layer, cls, t), "poi": T.is_poi(layer, cls), "labelled": T.is_labelled(layer, cls), "category": T.category(layer, cls), "subcategory": T.subcategory(layer, cls),
        "poi_type": T.poi_type(layer, cls), "area": T.is_area(layer, cls), "elevation": F.coalesce(X.elevation(T.tag(t, "ele")), F.lit(0)), "name": name, "short_name": X.short_road(name),
    }).filter("shown")


def build_blob(rows: list[dict], box: shapes.Box, width: int = 176, height: int = 176, interval: int = 20, labels: bool = True) -> bytes:
    """The blob of an area from marked features in order; parts are arrays."""
    lines, pois, texts = b"", b"", b""
    n_lines = n_pois = n_labels = 0
    poi_cells: set[tuple] = set()
    label_cells: set[tuple] = set()
    tolerance = (box[2] - box[0]) / (width / 2)
    for r in rows:
        parts = r["parts"]
        every = np.vstack([rings[0] for rings in parts])
        if every[:, 0].min() > box[2] or every[:, 0].max() < box[0] or every[:, 1].min() > box[3] or every[:, 1].max() < box[1]:
            continue
        if r["poi"]:
            if r["gtype"] != "point" or not r["name"]:
                continue
            px, py = to_pixels(every[:1], box, width, height)[0].tolist()
            cell = (px // POI_CELL, py // POI_CELL, r["poi_type"])
            if cell not in poi_cells:
                poi_cells.add(cell)
                name = r["name"].encode()[:POI_NAME]
                pois += struct.pack(">3BHB", r["poi_type"], px, py, r["elevation"], len(name)) + name
                n_pois += 1
            continue
        if r["gtype"] == "point":
            continue
        drawn = shapes.simplify_parts(r["gtype"], parts, tolerance, holes=False)
        polygon = r["gtype"] == "polygon" and (r["area"] or len(parts) > 1)
        category = r["category"] if polygon or r["category"] != vocab.CATEGORY_CODES["water_area"] else vocab.CATEGORY_CODES["water_line"]
        for rings in drawn:
            pixels = to_pixels(rings[0], box, width, height)
            # A ring has to stay one record, so it is cut at the format's limit.
            for packed in [pack_points(pixels[: MOST_DELTAS + 1])] if polygon else line_records(pixels):
                if packed:
                    lines += bytes([polygon << 7 | category << 4 | r["subcategory"] & 15]) + packed
                    n_lines += 1
        if labels and r["labelled"] and r["name"] and r["gtype"] == "line" and len(every) >= 2:
            k = len(every) // 2
            at, a, b = to_pixels(every[[k, max(k - 1, 0), min(k + 1, len(every) - 1)]], box, width, height)
            cell = (int(at[0]) // LABEL_CELL, int(at[1]) // LABEL_CELL)
            if cell not in label_cells:
                label_cells.add(cell)
                angle = int((np.arctan2(b[1] - a[1], b[0] - a[0]) * 128 / np.pi + 256) % 256)
                name = r["short_name"].encode()[:LABEL_NAME]
                texts += struct.pack("5B", r["category"], int(at[0]), int(at[1]), angle, len(name)) + name
                n_labels += 1
    return header_bytes(box, width, height, interval, n_lines, n_pois, n_labels) + lines + pois + texts


def read_blob(blob: bytes) -> dict:
    """Header, lines (type byte, pixels), points and labels of a blob."""
    head = read_header(blob)
    if head is None:
        raise ValueError("not a compact blob")
    at, lines, pois, labels = HEADER, [], [], []
    for _ in range(head["features"]):
        points, size = unpack_points(blob[at + 1 :])
        lines.append((blob[at], points))
        at += 1 + size
    for _ in range(head["pois"]):
        kind, x, y, elevation, n = struct.unpack(">3BHB", blob[at : at + 6])
        pois.append((kind, x, y, elevation, blob[at + 6 : at + 6 + n].decode("utf-8", "replace")))
        at += 6 + n
    for _ in range(head["labels"]):
        category, x, y, angle, n = blob[at : at + 5]
        labels.append((category, x, y, angle, blob[at + 5 : at + 5 + n].decode("utf-8", "replace")))
        at += 5 + n
    return {"header": head, "lines": lines, "pois": pois, "labels": labels}


def grid_cells(features: DataFrame, region: shapes.Box, step: float) -> DataFrame:
    """Each feature with every grid cell of the region that its box touches (cx, cy by integer index)."""
    x0, x1, y0, y1 = (int(np.floor(v / step)) for v in (region[0], region[2] - 1e-9, region[1], region[3] - 1e-9))
    span = lambda low, high, a, b: F.sequence(F.greatest(F.floor(F.col(low) / step), F.lit(a)), F.least(F.floor(F.col(high) / step), F.lit(b)))
    meets = (F.floor(F.col("max_lon") / step) >= x0) & (F.floor(F.col("min_lon") / step) <= x1) & (F.floor(F.col("max_lat") / step) >= y0) & (F.floor(F.col("min_lat") / step) <= y1)
    return features.filter(meets).withColumn("cx", F.explode(span("min_lon", "max_lon", x0, x1))).withColumn("cy", F.explode(span("min_lat", "max_lat", y0, y1)))


def _cell_blob(step: float, labels: bool, size: tuple[int, int, int]):
    def build(rows: list[dict]) -> list[dict]:
        cx, cy = rows[0]["cx"], rows[0]["cy"]
        box = (cx * step, cy * step, (cx + 1) * step, (cy + 1) * step)
        blob = build_blob(rows, box, *size, labels=labels)
        return [{"cx": cx, "cy": cy, "blob": blob}] if len(blob) > HEADER else []

    return build


def cell_blobs(features: DataFrame, region: shapes.Box, step: float = 0.05, labels: bool = False, size: tuple[int, int, int] = (176, 176, 20)) -> DataFrame:
    """cx, cy, blob of every grid cell with something to show. ``features`` carry box columns, tags, parts and ordinal."""
    cells = grid_cells(marked(features), region, step).drop("tags")
    arrow = pa.schema([("cx", pa.int64()), ("cy", pa.int64()), ("blob", pa.binary())])
    return by_group(cells, ["cx", "cy"], ["ordinal"], _cell_blob(step, labels, size), "cx long, cy long, blob binary", arrow)


def bundle(cells: Iterator, region: shapes.Box, step: float, version: int) -> bytes:
    """A bundle file: header, index by (latitude, longitude), blobs. ``cells`` are rows of ``cell_blobs``."""
    rows = sorted(cells, key=lambda r: (r["cy"], r["cx"]))
    index, body = b"", b""
    offset = BUNDLE_HEADER + BUNDLE_ENTRY * len(rows)
    for r in rows:
        blob = bytes(r["blob"])
        if len(blob) > 0xFFFF:
            raise ValueError("a cell's blob exceeds 65535 bytes")
        index += struct.pack("<2fIH", r["cy"] * step, r["cx"] * step, offset + len(body), len(blob))
        body += blob
    return BUNDLE_MAGIC + struct.pack("<2I4h", len(rows), version, *(int(v * 100) for v in (region[1], region[0], region[3], region[2]))) + index + body


def bundle_cells(data: bytes) -> pd.DataFrame:
    """lat, lon, blob of a bundle file."""
    if data[:4] != BUNDLE_MAGIC:
        raise ValueError("not a bundle")
    (n,) = struct.unpack("<I", data[4:8])
    rows = [struct.unpack("<2fIH", data[BUNDLE_HEADER + BUNDLE_ENTRY * i : BUNDLE_HEADER + BUNDLE_ENTRY * (i + 1)]) for i in range(n)]
    return pd.DataFrame([(round(lat, 4), round(lon, 4), data[at : at + size]) for lat, lon, at, size in rows], columns=["lat", "lon", "blob"])
