"""osmChange diffs: parsed from files by an XML reader that refuses document types and entities; batch and stream."""

from __future__ import annotations

import gzip
import io
import json
import os
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "sequence long, ordinal long, action string, osm_type string, id long, version long, visible boolean, lon double, lat double, node_refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
ACTIONS, TYPES = ("create", "modify", "delete"), ("node", "way", "relation")


def _int(text: str | None) -> int:
    try:
        return int(text or 0)
    except ValueError:
        return 0


def _float(text: str | None) -> float:
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def parse(data: bytes) -> list[dict]:
    """Changes of a diff in file order. A document type or an entity declaration is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out: list[dict] = []
    state: dict = {"action": None, "element": None}

    def refuse(*_):
        raise ValueError("DTD and entity declarations are not allowed in a diff")

    def begin(name: str, a: dict) -> None:
        element = state["element"]
        if name in ACTIONS:
            state["action"] = name
        elif name in TYPES and state["action"]:
            state["element"] = {"action": state["action"], "osm_type": name, "id": _int(a.get("id")), "version": _int(a.get("version")), "visible": a.get("visible") != "false", "lon": _float(a.get("lon")) if name == "node" else None, "lat": _float(a.get("lat")) if name == "node" else None, "node_refs": [], "members": [], "tags": {}}
        elif element is not None and name == "tag":
            element["tags"].setdefault(a.get("k", ""), a.get("v", ""))
        elif element is not None and name == "nd":
            element["node_refs"].append(_int(a.get("ref")))
        elif element is not None and name == "member":
            element["members"].append({"type": a.get("type", ""), "ref": _int(a.get("ref")), "role": a.get("role", "")})

    def end(name: str) -> None:
        if name in TYPES and state["element"] is not None:
            out.append(state["element"])
            state["element"] = None
        elif name in ACTIONS:
            state["action"] = None

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler = begin, end
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = refuse
    p.ParseFile(io.BytesIO(data))
    return out


def sequence_of(path: str) -> int:
    """The sequence number in a path of three-digit folders, or of a plain file name."""
    m = re.search(r"(\d{3})/(\d{3})/(\d{3})\.osc", path)
    if m:
        return int("".join(m.groups()))
    m = re.search(r"(\d+)\.osc", path)
    return int(m[1]) if m else 0


_ARROW = pa.schema([("sequence", pa.int64()), ("ordinal", pa.int64()), ("action", pa.string()), ("osm_type", pa.string()), ("id", pa.int64()), ("version", pa.int64()), ("visible", pa.bool_()), ("lon", pa.float64()), ("lat", pa.float64()), ("node_refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string()))])


def _rows(path: str, data: bytes) -> list[dict]:
    return [{"sequence": sequence_of(path), "ordinal": i, **c, "tags": list(c["tags"].items())} for i, c in enumerate(parse(data))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_pylist(_rows(path.as_py(), content.as_py()), schema=_ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All diffs below a path, one task per group of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.osc*").load(path)
    return files.select("path", "content").mapInArrow(_parsed, SCHEMA)


def sequences(spark: SparkSession, path: str) -> list[int]:
    """The sequence numbers of the diffs below a path, in order; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.osc*").load(path)
    return sorted(sequence_of(r["path"]) for r in files.select("path").collect())


class _Stream(SimpleDataSourceStreamReader):
    """Diffs in order of sequence; the offset is the last sequence that was read."""

    def __init__(self, options: dict):
        self.path, self.first = options["path"], int(options.get("startSequence", 0))

    def _files(self) -> list[tuple[int, str]]:
        return sorted((sequence_of(p), p) for d, _, names in os.walk(self.path) for n in names if ".osc" in n for p in [os.path.join(d, n)])

    def initialOffset(self) -> dict:
        return {"sequence": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files = [(s, p) for s, p in self._files() if s > start["sequence"]]
        end = {"sequence": files[-1][0] if files else start["sequence"]}
        return iter(list(self.readBetweenOffsets(start, end))), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for s, p in self._files():
            if start["sequence"] < s <= end["sequence"]:
                with open(p, "rb") as f:
                    for i, c in enumerate(parse(f.read())):
                        yield (s, i, c["action"], c["osm_type"], c["id"], c["version"], c["visible"], c["lon"], c["lat"], c["node_refs"], [tuple(m.values()) for m in c["members"]], c["tags"])

    def commit(self, end: dict) -> None:
        pass


class ChangeSource(DataSource):
    """The ``osm_changes`` stream format: a folder of diffs, read by sequence number."""

    @classmethod
    def name(cls) -> str:
        return "osm_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Stream:
        return _Stream(self.options)


class ReplicationState:
    """Sequence, timestamp and base address of a feed, kept as JSON."""

    def __init__(self, sequence: int, timestamp: str, base_url: str):
        self.sequence, self.timestamp, self.base_url = sequence, timestamp, base_url

    @classmethod
    def load(cls, path: str) -> ReplicationState:
        with open(path) as f:
            d = json.load(f)
        return cls(d["sequence"], d["timestamp"], d["base_url"])

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.__dict__, f, indent=2)

    def next_url(self) -> str:
        n = f"{self.sequence + 1:09d}"
        return f"{self.base_url.rstrip('/')}/{n[:-6]}/{n[-6:-3]}/{n[-3:]}.osc.gz"

    def advanced(self, timestamp: str | None = None) -> ReplicationState:
        return ReplicationState(self.sequence + 1, timestamp or self.timestamp, self.base_url)
