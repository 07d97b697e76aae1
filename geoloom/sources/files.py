"""GeoJSON, elevation grids, region indexes and bundles, read by Spark's own readers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import shapes, vocab
from geoloom.functions import tags as T
from geoloom.operators.compact import BUNDLE_MAGIC
from geoloom.operators.tiles import PARTS

_TOP = "type string, features array<string>"
_FEATURE = "type string, id string, geometry struct<type:string,coordinates:string>, properties map<string,string>"


def _points(coordinates: Column) -> Column:
    """array<array<double>> to points; pairs that are cut short are left out."""
    return F.transform(F.filter(coordinates, lambda c: F.coalesce(F.size(c) >= 2, F.lit(False))), lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))


def _rings(coordinates: Column) -> Column:
    """Rings of a polygon: null without an outer ring of three points, holes below three points left out."""
    rings = F.transform(coordinates, _points)
    holes = F.filter(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.size(r) >= 3)
    close = lambda r: F.when((F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.element_at(r, 1)["y"] == F.element_at(r, -1)["y"]), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    return F.when((F.size(rings) > 0) & (F.size(rings[0]) >= 3), F.transform(F.concat(F.slice(rings, 1, 1), holes), close))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, id, layer, class, gtype, parts, tags of a FeatureCollection or a Feature; anything else is an error.

    Features without a usable geometry are skipped; ids that are no integers
    are replaced by a counter and may repeat, ``ordinal`` does not; scalars among the properties become tags, and
    what does not classify is natural/other.
    """
    raw = spark.read.text(path, wholetext=True)
    top = raw.select("value", F.from_json("value", _TOP).alias("t"))
    known = F.col("t.type").isin("FeatureCollection", "Feature")
    checked = top.filter(F.when(F.coalesce(known, F.lit(False)), True).otherwise(F.raise_error(F.lit("neither a FeatureCollection nor a Feature")).cast("boolean")))
    one = F.explode(F.when(F.col("t.type") == "Feature", F.array("value")).otherwise(F.col("t.features")))
    f = checked.select(one.alias("raw")).select("raw", F.from_json("raw", _FEATURE).alias("f"), F.monotonically_increasing_id().alias("n"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    as_ = lambda shape: F.from_json(text, shape)
    line, polygon = _points(as_("array<array<double>>")), _rings(as_("array<array<array<double>>>"))
    multi = F.filter(F.transform(as_("array<array<array<array<double>>>>"), _rings), lambda p: p.isNotNull())
    point = _points(F.array(as_("array<double>")))
    parts = (
        F.when((kind == "Point") & (F.size(point) == 1), F.array(F.array(point))).when((kind == "LineString") & (F.size(line) >= 2), F.array(F.array(line)))
        .when((kind == "Polygon") & polygon.isNotNull(), F.array(polygon)).when((kind == "MultiPolygon") & (F.size(multi) > 0), multi)
    )
    gtype = F.when(kind == "Point", "point").when(kind == "LineString", "line").otherwise("polygon")
    scalars = F.map_filter(F.coalesce("f.properties", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    rows = f.withColumns({"parts": parts.cast(PARTS), "gtype": gtype, "tags": scalars}).filter("parts is not null")
    layer, cls = T.classify(F.col("tags"), vocab.LAYERS)
    return rows.select(F.col("n").alias("ordinal"), F.coalesce(F.col("f.id").try_cast("long"), F.col("n") + 1).alias("id"), F.coalesce(layer, F.lit("natural")).alias("layer"), F.coalesce(cls, F.lit("other")).alias("class"), "gtype", "parts", "tags")


def boxed(features: DataFrame) -> DataFrame:
    """Adds min_lon .. max_lat, from outer rings only."""
    outer = F.flatten(F.transform("parts", lambda p: p[0]))
    b = G.box_of(outer)
    return features.withColumns({c: b[c] for c in ("min_lon", "min_lat", "max_lon", "max_lat")})


def corner(path: str) -> tuple[int, int]:
    """South-west corner (lat, lon) in an elevation file's name."""
    m = re.search(r"([NS])(\d+)([EW])(\d+)\.hgt", path, re.I)
    if not m:
        raise ValueError(f"no corner in the name {path}")
    return int(m[2]) * (-1 if m[1] in "Ss" else 1), int(m[4]) * (-1 if m[3] in "Ww" else 1)


def grid_of(data: bytes) -> np.ndarray:
    """Square grid of a tile, north row first."""
    side = int(round((len(data) // 2) ** 0.5))
    if side * side * 2 != len(data):
        raise ValueError("an elevation tile is not square")
    return np.frombuffer(data, dtype=">i2").reshape(side, side).astype(np.int16)


def elevation(spark: SparkSession, path: str) -> DataFrame:
    """south, west, side, low, high, grid (row-major, voids as 0) of elevation tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0), batch.column(1), strict=True):
                south, west = corner(p.as_py())
                g = grid_of(content.as_py())
                g = np.where((g == -9999) | (g == -32768), 0, g).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array([south], pa.int32()), pa.array([west], pa.int32()), pa.array([g.shape[0]], pa.int32()), pa.array([int(g.min())], pa.int32()), pa.array([int(g.max())], pa.int32()), pa.array([g.ravel()], pa.list_(pa.int16()))], ["south", "west", "side", "low", "high", "grid"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select("path", "content").mapInArrow(run, "south int, west int, side int, low int, high int, grid array<short>")


def contour_features(grids: DataFrame, box: shapes.Box, interval: int) -> DataFrame:
    """Contour lines as features: id (negative), layer, class, metres, gtype, parts; one task per elevation tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for batch in batches:
            for r in batch.to_pylist():
                found = shapes.contours(np.array(r["grid"], dtype=np.int16).reshape(r["side"], r["side"]), r["south"], r["west"], box, interval)
                parts = [[[[{"x": float(x), "y": float(y)} for x, y in line]]] for _, _, line in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array(parts, pa.list_(pa.list_(pa.list_(point))))], ["id", "metres", "parts"])

    rows = grids.select("south", "west", "side", "grid").mapInArrow(run, f"id long, metres int, parts {PARTS}")
    return rows.select("id", F.lit("contour").alias("layer"), T.contour_class(F.col("metres")).alias("class"), "metres", F.lit("line").alias("gtype"), "parts")


def _numbers(text: str) -> list[list[float]]:
    found: list[list[float]] = []

    def walk(x) -> None:
        if isinstance(x, list):
            if len(x) >= 2 and all(isinstance(v, (int, float)) for v in x[:2]):
                found.append([float(x[0]), float(x[1])])
            else:
                for y in x:
                    walk(y)

    walk(json.loads(text))
    return found


def regions(spark: SparkSession, path: str) -> DataFrame:
    """id, name, parent, url, box and area of a region index; entries without a file, a geometry or an area are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ordinal", pa.int64()), ("id", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("url", pa.string()), ("min_lon", pa.float64()), ("min_lat", pa.float64()), ("max_lon", pa.float64()), ("max_lat", pa.float64())])
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                for i, f in enumerate(json.loads(text).get("features", [])):
                    p, g = f.get("properties") or {}, f.get("geometry") or {}
                    url = (p.get("urls") or {}).get("pbf")
                    points = _numbers(json.dumps(g.get("coordinates") or []))
                    if url and points:
                        xs, ys = zip(*points, strict=True)
                        rows.append({"ordinal": i, "id": p.get("id"), "name": p.get("name"), "parent": p.get("parent"), "url": url, "min_lon": min(xs), "min_lat": min(ys), "max_lon": max(xs), "max_lat": max(ys)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    raw = spark.read.text(path, wholetext=True)
    found = raw.mapInArrow(run, "ordinal long, id string, name string, parent string, url string, min_lon double, min_lat double, max_lon double, max_lat double")
    return found.withColumn("area", (F.col("max_lon") - F.col("min_lon")) * (F.col("max_lat") - F.col("min_lat"))).filter("area > 0")


def region_at(found: DataFrame, lon: float, lat: float) -> DataFrame:
    """The smallest region around a position, the first on ties."""
    return found.filter(G.in_box(F.lit(lon), F.lit(lat), F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))).orderBy("area", "ordinal").limit(1)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and number of tiles of the bundles below a path; other files are left out."""
    files = spark.read.format("binaryFile").load(path)
    little = F.concat(*(F.hex(F.substring("content", i, 1)) for i in range(8, 4, -1)))
    return files.filter(F.substring("content", 1, 4) == F.lit(BUNDLE_MAGIC)).select("path", F.col("length").alias("bytes"), F.conv(little, 16, 10).cast("int").alias("tiles"))
