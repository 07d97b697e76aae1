"""Summaries of a dataset, and the arguments that its commands take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import vocab


def parse_box(text: str, ordered: bool = True) -> tuple[float, float, float, float]:
    """min_lon,min_lat,max_lon,max_lat; inverted boxes are an error where ``ordered``."""
    try:
        values = tuple(float(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"not a box: {text}") from None
    if len(values) != 4 or (ordered and (values[0] > values[2] or values[1] > values[3])):
        raise ValueError(f"not a box: {text}")
    return values


def parse_zooms(text: str) -> tuple[int, int]:
    """A range "a-b", or one zoom "a"."""
    low, dash, high = text.partition("-")
    return int(low), int(high if dash else low)


def node_store(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """id, lon, lat with one row per id, the last by ``order``; negative ids are left out."""
    rows = nodes.filter("id >= 0")
    if order is None:
        return rows.select("id", "lon", "lat")
    return rows.groupBy("id").agg(F.max_by(F.struct("lon", "lat"), order).alias("p")).select("id", "p.lon", "p.lat")


def distinct_strings(elements: DataFrame) -> int:
    """Distinct keys and values of all tags, the well-known keys included."""
    said = elements.select(F.explode(F.concat(F.map_keys("tags"), F.map_values("tags"))).alias("s"))
    known = elements.sparkSession.createDataFrame([(k,) for k in vocab.WELL_KNOWN], "s string")
    return said.union(known).distinct().count()


def layer_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "layer")


def extent(features: DataFrame) -> DataFrame:
    """The box around all features."""
    return features.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def load_counters(elements: DataFrame, features: DataFrame) -> DataFrame:
    """nodes, ways, relations (multipolygons with an outer member only) and features of a load."""
    usable = (F.col("osm_type") == "relation") & (F.try_element_at("tags", F.lit("type")) == "multipolygon") & F.exists("members", lambda m: (m["type"] == "way") & m["role"].isin("outer", ""))
    counts = elements.agg(F.count_if(F.col("osm_type") == "node").alias("nodes"), F.count_if(F.col("osm_type") == "way").alias("ways"), F.count_if(usable).alias("relations"))
    return counts.crossJoin(features.agg(F.count(F.lit(1)).alias("features")))  # one row with one row
