"""Map extracts in the public OSM PBF format, as a batch data source with one partition per byte range.

``spark.dataSource.register(PbfSource)``; then
``spark.read.format("osm_pbf").option("elements", "node,way,relation").load(path)``
gives osm_type, id, lon, lat, refs, members, tags. Only the file's size is read
on the driver: a task finds the first blob header of its byte range itself and
decodes the blobs that start there; ids, positions and references are delta
sums in numpy. ``elements`` is pushed into the reader: other groups are not
decoded. Paths are files that every node sees, or addresses that pyarrow opens.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoloom.functions.tilecodec import fields, unzigzag

SCHEMA = "osm_type string, id long, lon double, lat double, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
MEMBER_TYPES = ("node", "way", "relation")
#: Bytes of compressed blobs that one partition reads, about.
PARTITION_BYTES = 32 << 20
#: Bytes of a blob header at most, bytes that are searched for one at a time, and how one begins after its length.
MOST_HEADER, WINDOW = 64 << 10, 1 << 20
_MARK = re.compile(rb"\n(?:\x07OSMData|\x09OSMHeader)")


def varints(data: bytes) -> np.ndarray:
    """All varints of a packed field, vectorised over its bytes."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(b < 0x80)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def opened(path: str):
    """A file to seek and read in, of a local path or of any address that pyarrow can open, and its size."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return open(path, "rb"), os.path.getsize(path)
    from pyarrow import fs

    found, inner = fs.FileSystem.from_uri(path)
    f = found.open_input_file(inner)
    return f, f.size()


def _header(f, at: int, size: int) -> tuple[str, int, int] | None:
    """(kind, offset, size) of the blob whose header starts at a position; None if none does."""
    f.seek(at)
    start = f.read(4)
    if len(start) < 4 or not 0 < (n := struct.unpack(">I", start)[0]) <= MOST_HEADER:
        return None
    head = {k: v for k, _, v in fields(f.read(n))}
    kind, length = head.get(1), head.get(3)
    if kind not in (b"OSMHeader", b"OSMData") or not isinstance(length, int) or at + 4 + n + length > size:
        return None
    return kind.decode(), at + 4 + n, length


def _first_header(f, start: int, stop: int, size: int) -> int | None:
    """Where the first blob header of a byte range starts: one that another header, or the end, follows."""
    at = start
    while at < stop:
        f.seek(at)
        window = f.read(WINDOW + 32)
        seen = 0
        while (hit := _MARK.search(window, seen)) and at + hit.start() - 4 < stop:
            place = at + hit.start() - 4
            seen = hit.start() + 1
            found = _header(f, place, size) if place >= start else None
            if found and (found[1] + found[2] == size or _header(f, found[1] + found[2], size)):
                return place
        at += WINDOW
    return None


def blobs(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(kind, offset, size) of every blob whose header starts in a byte range of a file."""
    f, size = opened(path)
    with f:
        stop = size if stop is None else min(stop, size)
        at = start if start == 0 else _first_header(f, start, stop, size)
        while at is not None and at < stop:
            found = _header(f, at, size)
            if found is None:
                raise ValueError(f"no blob at byte {at} of {path}")
            yield found
            at = found[1] + found[2]


def inflate(blob: bytes) -> bytes:
    parts = {k: v for k, _, v in fields(blob)}
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("a blob is neither raw nor zlib")


def _tags(keys: np.ndarray, values: np.ndarray, strings: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in zip(keys.tolist(), values.tolist(), strict=True):
        out.setdefault(strings[k], strings[v])
    return out


def decode_block(data: bytes, wanted: frozenset[str]) -> Iterator[tuple]:
    """Rows of a primitive block."""
    strings: list[str] = []
    groups: list[bytes] = []
    granularity, lat0, lon0 = 100, 0, 0
    for k, _, v in fields(data):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >= 1 << 63 else v
        elif k == 20:
            lon0 = v - (1 << 64) if v >= 1 << 63 else v
    degrees = lambda base, x: (base + granularity * x) * 1e-9
    for group in groups:
        for k, _, v in fields(group):
            if k == 1 and "node" in wanted:
                f = {n: x for n, _, x in fields(v)}
                yield "node", unzigzag(f[1]), degrees(lon0, unzigzag(f[9])), degrees(lat0, unzigzag(f[8])), None, None, _tags(varints(f.get(2, b"")), varints(f.get(3, b"")), strings)
            elif k == 2 and "node" in wanted:
                f = {n: x for n, _, x in fields(v)}
                ids, lat, lon = (np.cumsum(signed(varints(f[n]))) for n in (1, 8, 9))
                marks = varints(f.get(10, b"")).astype(np.int64)
                at = 0
                for i in range(len(ids)):
                    tags: dict[str, str] = {}
                    while at < len(marks) and marks[at]:
                        tags.setdefault(strings[marks[at]], strings[marks[at + 1]])
                        at += 2
                    at += 1
                    yield "node", int(ids[i]), float(degrees(lon0, lon[i])), float(degrees(lat0, lat[i])), None, None, tags
            elif k == 3 and "way" in wanted:
                f = {n: x for n, _, x in fields(v)}
                yield "way", f[1], None, None, np.cumsum(signed(varints(f.get(8, b"")))).tolist(), None, _tags(varints(f.get(2, b"")), varints(f.get(3, b"")), strings)
            elif k == 4 and "relation" in wanted:
                f = {n: x for n, _, x in fields(v)}
                refs, roles, kinds = np.cumsum(signed(varints(f.get(9, b"")))), varints(f.get(8, b"")), varints(f.get(10, b""))
                members = [(MEMBER_TYPES[int(t)], int(r), strings[int(s)]) for t, r, s in zip(kinds, refs, roles, strict=True)]
                yield "relation", f[1], None, None, None, members, _tags(varints(f.get(2, b"")), varints(f.get(3, b"")), strings)


class _Run(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(None)
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.wanted = frozenset(x.strip() for x in options.get("elements", "node,way,relation").split(","))
        self.step = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[_Run]:
        f, size = opened(self.path)
        f.close()
        return [_Run(self.path, a, a + self.step) for a in range(0, max(size, 1), self.step)]

    def read(self, partition: _Run) -> Iterator[tuple]:
        f, _ = opened(partition.path)
        with f:
            for kind, at, size in blobs(partition.path, partition.start, partition.stop):
                if kind == "OSMData":
                    f.seek(at)
                    yield from decode_block(inflate(f.read(size)), self.wanted)


class PbfSource(DataSource):
    """The ``osm_pbf`` format."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
