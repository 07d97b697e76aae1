"""Vector tiles: fan-out by ids, then geometry per tile, then bytes; the archive as a table and as a file."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import struct
import tempfile
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import shapes, tilecodec, vocab
from geoloom.functions import tags as T
from geoloom.functions.tilecodec import varint
from geoloom.operators import spatial
from geoloom.operators.streamed import by_group

EXTENT, BUFFER = 4096, 0.05
PARTS = "array<array<array<struct<x:double,y:double>>>>"


def as_arrays(parts) -> list[list[np.ndarray]]:
    return [[np.array([(p["x"], p["y"]) for p in ring], dtype=np.float64).reshape(-1, 2) for ring in rings] for rings in parts]


def as_rows(parts: list[list[np.ndarray]]) -> list:
    return [[[{"x": float(a), "y": float(b)} for a, b in ring] for ring in rings] for rings in parts]


def part_arrays(column: pa.Array | pa.ChunkedArray) -> list[list[list[np.ndarray]] | None]:
    """The parts of every row as arrays of vertices, cut from the column's flat coordinates."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = lambda a: np.append(0, np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    parts = column.flatten()
    rings = parts.flatten()
    points = rings.flatten()
    xy = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) if len(points) else np.zeros((0, 2))
    of_row, of_part, of_ring = sizes(column).tolist(), sizes(parts).tolist(), sizes(rings).tolist()
    missing = column.is_null().to_pylist()
    return [None if missing[i] else [[xy[of_ring[r] : of_ring[r + 1]] for r in range(of_part[p], of_part[p + 1])] for p in range(of_row[i], of_row[i + 1])] for i in range(len(column))]


def part_column(rows: list[list[list[np.ndarray]]]) -> pa.Array:
    """The inverse of ``part_arrays``."""
    stops = lambda lengths: pa.array(np.append(0, np.cumsum(np.array(lengths, dtype=np.int64))), pa.int32())
    parts = [p for row in rows for p in row]
    rings = [np.asarray(r, dtype=np.float64).reshape(-1, 2) for p in parts for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    lines = pa.ListArray.from_arrays(stops([len(r) for r in rings]), points)
    return pa.ListArray.from_arrays(stops([len(row) for row in rows]), pa.ListArray.from_arrays(stops([len(p) for p in parts]), lines))


def with_parts(batch: pa.RecordBatch, rows: list[list[list[np.ndarray]]]) -> pa.RecordBatch:
    """The batch with other parts."""
    at = batch.schema.get_field_index("parts")
    return pa.RecordBatch.from_arrays([part_column(rows).cast(c.type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def _simplified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, zooms = batch.column("gtype").to_pylist(), batch.column("z").to_pylist()
        yield with_parts(batch, [shapes.simplify_parts(k, p, 360.0 / 2 ** min(z, 22) / 4096) for k, z, p in zip(kinds, zooms, part_arrays(batch.column("parts")), strict=True)])


def _tile_box(z: int, x: int, y: int) -> shapes.Box:
    corners = tilecodec.to_degrees(np.array([[0.0, 1.0], [1.0, 0.0]]), z, x, y, 1)
    return corners[0, 0], corners[0, 1], corners[1, 0], corners[1, 1]


#: layers of (id, gtype, tile-local parts, tags) and the extent in, a tile's bytes or None out.
Encoder = Callable[[dict[str, list], int], bytes | None]


def _encoder(all_tags: bool, encode: Encoder):
    def build(rows: list[dict]) -> list[dict]:
        z, x, y = rows[0]["z"], rows[0]["x"], rows[0]["y"]
        box = _tile_box(z, x, y)
        layers: dict[str, list] = {}
        for r in rows:
            parts = shapes.clip_parts(r["gtype"], r["parts"], box, BUFFER)
            if parts is None:
                continue
            local = [[tilecodec.to_local(ring, z, x, y, EXTENT) for ring in rings] for rings in parts]
            own = dict(r["tags"] or ())
            wanted = [k for k in own if k and k != "class"] if all_tags else [k for k in ("name", *vocab.TILE_TAGS) if k in own]
            layers.setdefault(r["layer"], []).append((r["id"], r["gtype"], local, {"class": r["class"], **{k: own[k] for k in wanted}}))
        data = encode(layers, EXTENT)
        return [{"z": z, "x": x, "y": y, "features": sum(map(len, layers.values())), "data": data}] if data else []

    return build


def generate(features: DataFrame, min_zoom: int, max_zoom: int, all_tags: bool = False, encode: Encoder = tilecodec.encode_tile) -> DataFrame:
    """z, x, y, features, data of every non-empty tile, its bytes as ``encode`` makes them.

    ``features``: id, layer, class, gtype, parts, tags, min_lon .. max_lat,
    ordinal. ``ordinal`` tells features apart and orders them; ids may repeat, as
    they do across nodes, ways and relations. Only ordinals take part in the
    fan-out and in the cap per tile; geometry is simplified once per feature and
    zoom and joined afterwards, so a crowded low-zoom tile never carries more
    than its cap.
    """
    lowest = F.greatest(T.min_zoom(F.col("layer"), F.col("class")), F.lit(min_zoom))
    boxes = features.select("layer", "class", "ordinal", "min_lon", "min_lat", "max_lon", "max_lat")
    cover = spatial.tiles_of_boxes(boxes, lowest, max_zoom).select("ordinal", "z", "x", "y")
    kept = spatial.capped(cover, ["ordinal"], spatial.tile_cap(F.col("z")))
    zooms = F.explode(F.when(lowest <= max_zoom, F.sequence(lowest, F.lit(max_zoom))).otherwise(F.array().cast("array<int>")))
    each = features.select("ordinal", "id", "layer", "class", "gtype", F.col("parts").cast(PARTS).alias("parts"), F.col("tags").cast("map<string,string>").alias("tags"), zooms.alias("z"))
    simple = each.mapInArrow(_simplified, each.schema)
    rows = kept.join(simple, ["ordinal", "z"])
    arrow = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("features", pa.int32()), ("data", pa.binary())])
    return by_group(rows, ["z", "x", "y"], ["ordinal"], _encoder(all_tags, encode), "z int, x int, y int, features int, data binary", arrow)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("layer", pa.string()), ("id", pa.int64()), ("class", pa.string()), ("name", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("gtype", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])
    for batch in batches:
        rows, parts = [], []
        for r in batch.to_pylist():
            data = gzip.decompress(r["data"]) if r["data"][:2] == b"\x1f\x8b" else r["data"]
            for f in tilecodec.decode_tile(data, r["z"], r["x"], r["y"]):
                parts.append(f["parts"])
                rows.append({"z": r["z"], "x": r["x"], "y": r["y"], **f, "tags": list(f["tags"].items()), "parts": None})
        yield with_parts(pa.RecordBatch.from_pylist(rows, schema=schema), parts)


def decode(tiles: DataFrame) -> DataFrame:
    """The features of tiles (z, x, y, data), geometry in degrees."""
    return tiles.select("z", "x", "y", "data").mapInArrow(_decoded, f"z int, x int, y int, layer string, id long, class string, name string, tags map<string,string>, gtype string, parts {PARTS}")


def in_view(tiles: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, zoom: int) -> DataFrame:
    """The tiles of a zoom that a box touches; the range reaches the scan of a tile table."""
    one = tiles.sparkSession.range(1)
    r = one.select(G.tile_x(F.lit(min_lon), zoom), G.tile_x(F.lit(max_lon), zoom), G.tile_y(F.lit(max_lat), zoom), G.tile_y(F.lit(min_lat), zoom)).first()
    return tiles.filter((F.col("z") == zoom) & F.col("x").between(r[0], r[1]) & F.col("y").between(r[2], r[3]))


def each(tiles: DataFrame, write: Callable[[int, int, int, bytes], None]) -> None:
    """Hands every tile to ``write`` (z, x, y, bytes) on the executors; a repeated task hands its tiles over again."""

    def run(rows) -> None:
        for r in rows:
            write(r["z"], r["x"], r["y"], bytes(r["data"]))

    tiles.select("z", "x", "y", "data").foreachPartition(run)


def write_table(tiles: DataFrame, path: str) -> None:
    """The tile table, one folder per zoom, sorted by place within files."""
    tiles.repartitionByRange("z", "x", "y").sortWithinPartitions("x", "y").write.mode("overwrite").partitionBy("z").parquet(path)


def lookup(spark: SparkSession, path: str, z: int, x: int, y: int) -> tuple[int, bytes | None]:
    """(status, bytes) as a tile server answers: 400 for a place off the map, 204 for none, 200."""
    if not (0 <= z <= 22 and 0 <= x < 2**z and 0 <= y < 2**z):
        return 400, None
    row = spark.read.parquet(path).filter((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).select("data").first()
    return (200, bytes(row["data"])) if row else (204, None)


def hilbert_id(z: int, x: int, y: int) -> int:
    """Place of a tile in the archive's order: zooms one after another, each along a Hilbert curve."""
    base, d = (4**z - 1) // 3, 0
    s = 2**z // 2
    while s > 0:
        rx, ry = int((x & s) > 0), int((y & s) > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx == 1:
                x, y = 2**z - 1 - x, 2**z - 1 - y
            x, y = y, x
        s //= 2
    return base + d


def metadata(min_zoom: int, max_zoom: int, name: str = "geoloom") -> dict:
    """Archive metadata with one entry per layer and the zooms its classes start at."""
    layers = [{"id": layer, "minzoom": min(vocab.MIN_ZOOM[layer].values()), "maxzoom": max_zoom, "fields": {k: "String" for k in ("class", "name", *vocab.TILE_TAGS)}} for layer in vocab.LAYERS]
    return {"name": name, "format": "pbf", "minzoom": min_zoom, "maxzoom": max_zoom, "vector_layers": layers}


#: Bytes that readers fetch first, header and root directory together; entries of a leaf directory.
FIRST_FETCH, LEAF_ENTRIES = 16_384, 4096
HEADER_BYTES = 127


def hilbert_place(tile: int) -> tuple[int, int, int]:
    """(z, x, y) of a place in the archive's order."""
    z, first = 0, 0
    while tile >= first + 4**z:
        first, z = first + 4**z, z + 1
    d, x, y, s = tile - first, 0, 0, 1
    while s < 2**z:
        rx = 1 & (d // 2)
        ry = 1 & (d ^ rx)
        if ry == 0:
            if rx == 1:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, d, s = x + s * rx, y + s * ry, d // 4, s * 2
    return z, x, y


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Compressed directory of (tile, offset, length, run) entries; run 0 points to a leaf."""
    tiles = [e[0] for e in entries]
    out = [varint(len(entries)), *(varint(b - a) for a, b in zip([0, *tiles], tiles, strict=False)), *(varint(e[3]) for e in entries), *(varint(e[2]) for e in entries)]
    after = -1
    for _, offset, length, _ in entries:
        out.append(varint(0 if offset == after else offset + 1))
        after = offset + length
    return gzip.compress(b"".join(out), mtime=0)


def _entries(data: bytes) -> list[tuple[int, int, int, int]]:
    """The inverse of ``_directory``."""
    raw, at = gzip.decompress(data), 0

    def take() -> int:
        nonlocal at
        value, at = tilecodec._read(raw, at)
        return value

    n = take()
    tiles = list(accumulate(take() for _ in range(n)))
    runs, lengths = [take() for _ in range(n)], [take() for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        said = take()
        offsets.append(said - 1 if said else offsets[-1] + lengths[i - 1])
    return list(zip(tiles, offsets, lengths, runs, strict=True))


def write_archive(tiles: DataFrame, path: str, bounds: shapes.Box, min_zoom: int, max_zoom: int) -> int:
    """A single-file archive (PMTiles version 3) on the driver's disk; returns the number of tiles.

    Tiles arrive one at a time in the archive's order, compressed by the
    executors, and go straight to a file; only their directory entries are
    held. Directories that do not fit into the first fetch are cut into leaves.
    """
    packed = tiles.select("z", "x", "y", "data").mapInArrow(_compressed, "tile long, data binary")
    entries: list[tuple[int, int, int, int]] = []
    size = 0
    with tempfile.TemporaryFile(dir=os.path.dirname(os.path.abspath(path))) as body:
        for r in packed.orderBy("tile").toLocalIterator():
            entries.append((r["tile"], size, len(r["data"]), 1))
            size += body.write(bytes(r["data"]))
        root, leaves, step = _directory(entries), b"", LEAF_ENTRIES
        while HEADER_BYTES + len(root) > FIRST_FETCH:
            parts, at, top = [], 0, []
            for a in range(0, len(entries), step):
                parts.append(_directory(entries[a : a + step]))
                top.append((entries[a][0], at, len(parts[-1]), 0))
                at += len(parts[-1])
            root, leaves, step = _directory(top), b"".join(parts), step * 2
        meta = gzip.compress(json.dumps(metadata(min_zoom, max_zoom)).encode(), mtime=0)
        n, at_meta = len(entries), HEADER_BYTES + len(root)
        at_leaves = at_meta + len(meta)
        e7 = [int(v * 1e7) for v in bounds]
        header = b"PMTiles\x03" + struct.pack("<11Q", HEADER_BYTES, len(root), at_meta, len(meta), at_leaves, len(leaves), at_leaves + len(leaves), size, n, n, n)
        header += struct.pack("<6B", 1, 2, 2, 1, min_zoom, max_zoom) + struct.pack("<4i", *e7) + struct.pack("<B2i", min_zoom, (e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2)
        body.seek(0)
        with open(path, "wb") as f:
            f.write(header + root + meta + leaves)
            shutil.copyfileobj(body, f)
    return n


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z, x, y, data = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(list(map(hilbert_id, z, x, y)), pa.int64()), pa.array([gzip.compress(d, mtime=0) for d in data], pa.binary())], ["tile", "data"])


class Archive:
    """Random reads of an archive file: the directories that a range needs, then the tiles themselves."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(HEADER_BYTES)
        if head[:8] != b"PMTiles\x03":
            raise ValueError(f"not a tile archive: {path}")
        self.at_root, self.root_size, _, _, self.at_leaves, _, self.at_data, _, self.tiles = struct.unpack("<9Q", head[8:80])
        self.min_zoom, self.max_zoom = head[100], head[101]

    def _fetch(self, at: int, size: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(at)
            return f.read(size)

    def entries(self, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """The tiles (place, offset, length, run) between two places of the order, both included."""
        pending = [self._fetch(self.at_root, self.root_size)]
        while pending:
            found = _entries(pending.pop())
            first = max(bisect_right(found, (low, 1 << 63)) - 1, 0)
            for tile, offset, size, run in found[first:]:
                if tile > high:
                    break
                if run == 0:
                    pending.insert(0, self._fetch(self.at_leaves + offset, size))
                elif tile + run > low:
                    yield tile, offset, size, run

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        """The bytes of one tile, None where there is none."""
        place = hilbert_id(z, x, y)
        for _, offset, size, _ in self.entries(place, place):
            return gzip.decompress(self._fetch(self.at_data + offset, size))
        return None

    def in_range(self, spark: SparkSession, zoom: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
        """z, x, y, data of the tiles of a zoom in a range of columns and rows, both ends included."""
        first = (4**zoom - 1) // 3
        rows = []
        for tile, offset, size, run in self.entries(first, first + 4**zoom - 1):
            for place in range(max(tile, first), min(tile + run, first + 4**zoom)):
                z, x, y = hilbert_place(place)
                if x0 <= x <= x1 and y0 <= y <= y1:
                    rows.append((z, x, y, bytearray(gzip.decompress(self._fetch(self.at_data + offset, size)))))
        return spark.createDataFrame(rows, "z int, x int, y int, data binary")

    def in_view(self, spark: SparkSession, min_lon: float, min_lat: float, max_lon: float, max_lat: float, zoom: int) -> DataFrame:
        """The tiles of a zoom that a box touches."""
        corner = lambda lon, lat: (G.tile_x(F.lit(lon), zoom), G.tile_y(F.lit(lat), zoom))
        x0, y0, x1, y1 = spark.range(1).select(*corner(min_lon, max_lat), *corner(max_lon, min_lat)).first()
        return self.in_range(spark, zoom, x0, y0, x1, y1)
