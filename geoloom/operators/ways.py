"""Ways and relations: references resolved by joins, geometry built in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G


def resolved(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, seq, node_id, lon, lat of the references that a node answers; the order column stays."""
    return way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")


def way_lines(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, refs, points (array<struct<x,y>>) in order of reference; unresolved references are dropped."""
    points = resolved(way_nodes, nodes).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node_id", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))
    return points.select("way_id", F.col("p.node_id").alias("refs"), F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def way_summary(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts, box, mean position and closedness of every way, without building its points."""
    first, last = F.min(F.struct("seq", "node_id")), F.max(F.struct("seq", "node_id"))
    s = resolved(way_nodes, nodes).groupBy("way_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"),
        F.avg("lon").alias("mean_lon"), F.avg("lat").alias("mean_lat"), first["node_id"].alias("first_node"), last["node_id"].alias("last_node"),
    )
    return s.withColumn("closed", (F.col("n") >= 4) & (F.col("first_node") == F.col("last_node"))).drop("first_node", "last_node")


def geometry_type(closed: Column, n: Column, area: Column) -> Column:
    """polygon for closed areas, line for two points and more, else null."""
    return F.when(closed & area, "polygon").when(n >= 2, "line")


def way_geometry(lines: DataFrame, area: Column) -> DataFrame:
    """Adds gtype and parts (polygon, ring, point) to ways with ``refs`` and ``points``; polygons run counter-clockwise."""
    closed = G.closed_by_refs(F.col("refs"))
    gtype = geometry_type(closed, F.size("points"), area)
    ring = F.when(gtype == "polygon", G.wound(F.col("points"))).otherwise(F.col("points"))
    return lines.withColumn("gtype", gtype).filter("gtype is not null").withColumn("parts", F.array(F.array(ring)))


def unresolved(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with fewer than two resolved references though they have some: way_id, n_refs, n_resolved."""
    refs = way_nodes.groupBy("way_id").agg(F.count(F.lit(1)).alias("n_refs"))
    hit = resolved(way_nodes, nodes).groupBy("way_id").agg(F.count(F.lit(1)).alias("n_resolved"))
    return refs.join(hit, "way_id", "left").select("way_id", "n_refs", F.coalesce("n_resolved", F.lit(0)).cast("long").alias("n_resolved")).filter("n_resolved < 2")


def needed_ways(ways: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """The ways that some relation has as a member."""
    return ways.join(members.select(F.col("way_id").alias(key)), key, "left_semi")


def usable_relations(members: DataFrame) -> DataFrame:
    """rel_id, outers, inners of relations with an outer member."""
    outer = F.count_if(F.col("role").isin("outer", ""))
    return members.groupBy("rel_id").agg(outer.alias("outers"), F.count_if(F.col("role") == "inner").alias("inners")).filter("outers > 0")
