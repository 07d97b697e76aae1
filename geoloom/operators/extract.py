"""Named entities: extraction, deduplication by name and distance, and their sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import tags as T
from geoloom.functions import text as X

COLUMNS = "name address phone website operator lat lon tags osm_type".split()
ENTITY = "osm_type string, osm_id long, name string, address string, phone string, website string, operator string, tags string, address_parts map<string,string>, lon double, lat double"


def entities(elements: DataFrame, include: str | None = None, exclude: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Contact columns of named elements (osm_type, osm_id, tags, lon, lat) that pass the filters.

    The name key must be there (an empty name passes). With a box, elements
    without a position are left out.
    """
    t = F.col("tags")
    keep: Column = T.has_tag(t, "name") & T.include_exclude(t, include, exclude)
    if box:
        keep = keep & F.coalesce(G.in_box(F.col("lon"), F.col("lat"), *box), F.lit(False))
    return elements.filter(keep).select(
        "osm_type", "osm_id", T.tag(t, "name").alias("name"), T.address(t).alias("address"), T.phone(t).alias("phone"), T.website(t).alias("website"),
        F.coalesce(T.tag(t, "operator"), F.lit("")).alias("operator"), T.other_tags(t).alias("tags"), T.address_parts(t).alias("address_parts"), "lon", "lat",
    )


def metres(lon1, lat1, lon2, lat2):
    """Haversine on numbers or arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * G.HAVERSINE_RADIUS * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _merged(radius: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["osm_type", "osm_id"], kind="stable")
        kept: list[int] = []
        lon, lat = np.full(len(group), np.nan), np.full(len(group), np.nan)
        xs, ys, rich = group["lon"].to_numpy(dtype=float), group["lat"].to_numpy(dtype=float), group["richness"].to_numpy()
        for i in range(len(group)):
            n = len(kept)
            if np.isnan(xs[i]) or np.isnan(ys[i]):
                near = np.flatnonzero(np.isnan(lon[:n]))
            else:
                near = np.flatnonzero(metres(lon[:n], lat[:n], xs[i], ys[i]) < radius)
            if not len(near):
                kept.append(i)
                lon[n], lat[n] = (xs[i], ys[i]) if not np.isnan(ys[i]) else (np.nan, np.nan)
            elif rich[i] > rich[kept[near[0]]]:
                kept[near[0]] = i
                lon[near[0]], lat[near[0]] = xs[i], ys[i]
        return group.iloc[sorted(kept)].drop(columns=["key", "richness"])

    return run


def deduplicated(found: DataFrame, radius: float = 100.0) -> DataFrame:
    """One entity of those with one name (case apart) within ``radius`` metres; the richer one, the earlier on ties.

    Entities without a position merge among themselves only. Scanning is in
    order of (osm_type, osm_id). A name is one group, as merging depends on the
    order within it; names that occur once skip it.
    """
    columns = found.columns
    keyed = found.withColumn("key", F.lower("name")).withColumn("richness", T.richness(F.col("address"), F.col("phone"), F.col("website"), F.col("operator"), F.col("tags")))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    alone = keyed.join(often, "key", "left_anti").select(*columns)
    many = keyed.join(often, "key", "left_semi")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return alone.unionByName(many.groupBy("key").applyInPandas(_merged(radius), schema))


def csv_lines(found: DataFrame) -> DataFrame:
    """One CSV line per entity, fields quoted where they must be; positions have six decimals or are blank."""
    number = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("")) if c in ("lat", "lon") else X.csv_field(F.coalesce(F.col(c).cast("string"), F.lit("")))
    blank = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(number(c))
    return found.select(F.concat_ws(",", *(blank(c) for c in COLUMNS)).alias("value"))


def write_csv(found: DataFrame, path: str) -> None:
    header = found.sparkSession.createDataFrame([(",".join(COLUMNS),)], "value string")
    header.unionByName(csv_lines(found)).write.mode("overwrite").text(path)


def json_rows(found: DataFrame) -> DataFrame:
    """One JSON object per entity, address parts beside the other fields."""
    plain = F.map_filter(F.create_map(*(x for c in COLUMNS if c not in ("lat", "lon") for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull())
    head = F.to_json(F.map_concat(plain, F.coalesce("address_parts", F.create_map().cast("map<string,string>"))))
    position = F.to_json(F.struct("lat", "lon"), {"ignoreNullFields": "false"})
    return found.withColumn("h", head).withColumn("p", position).select(F.concat(F.expr("left(h, length(h) - 1)"), F.lit(","), F.expr("substring(p, 2)")).alias("value"))


def geojson_rows(found: DataFrame) -> DataFrame:
    """One GeoJSON feature per entity; no position gives a null geometry, empty properties are left out."""
    has = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    shape = F.when(has, F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))).otherwise(F.lit("null"))
    full = F.map_filter(F.map_concat(F.create_map(*(x for c in COLUMNS if c not in ("lat", "lon") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(""))))), F.coalesce("address_parts", F.create_map().cast("map<string,string>"))), lambda k, v: v != "")
    return found.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.to_json(full), F.lit("}")).alias("value"))


def write(found: DataFrame, path: str) -> None:
    """CSV, or JSON lines and GeoJSON lines where the path's ending says so."""
    if path.endswith(".geojson"):
        geojson_rows(found).write.mode("overwrite").text(path)
    elif path.endswith(".json"):
        json_rows(found).write.mode("overwrite").text(path)
    else:
        write_csv(found, path)


def counters(elements: DataFrame) -> DataFrame:
    """Nodes, ways, relations (all of them) of an extract."""
    return elements.agg(*(F.count_if(F.col("osm_type") == t).alias(f"{t}s") for t in ("node", "way", "relation")))
