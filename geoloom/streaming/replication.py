"""Change feeds: old and new boxes of changed features, and the tiles they make stale; batch and streaming forms of one rule.

State is a box per (osm_type, id). Creating or modifying marks the old and the
new box, deleting marks the old one, and changes that do not classify are skipped and leave
the state as it is. Changes of one feature apply in order of (sequence, ordinal).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from geoloom.functions import geometry as G
from geoloom.functions import tags as T
from geoloom.operators import spatial

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
KEY = ("osm_type", "id")
STALE = "osm_type string, id long, action string, min_lon double, min_lat double, max_lon double, max_lat double"


def boxed_changes(changes: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """sequence, ordinal, action, osm_type, id, usable and box of changes as the reader gives them.

    Nodes carry their position; ways take it from ``nodes`` (id, lon, lat) and
    need two; relations have none.
    """
    layer, _ = T.classify(F.col("tags"))
    rows = changes.select("sequence", "ordinal", "action", "osm_type", "id", "lon", "lat", "node_refs", layer.isNotNull().alias("known"))
    plain = rows.filter("osm_type <> 'way'").select("sequence", "ordinal", "action", "osm_type", "id", "known", F.when(F.col("osm_type") == "node", F.lit(2)).otherwise(0).alias("points"), *(F.col(c).alias(b) for b, c in zip(BOX, ("lon", "lat", "lon", "lat"), strict=True)))
    ways = rows.filter("osm_type = 'way'")
    if nodes is None:
        located = ways.select("sequence", "ordinal", "action", "osm_type", "id", "known", F.lit(0).alias("points"), *(F.lit(None).cast("double").alias(b) for b in BOX))
    else:
        refs = ways.select("sequence", "ordinal", "action", "osm_type", "id", "known", F.explode_outer("node_refs").alias("node_id"))
        at = nodes.select(F.col("id").alias("node_id"), "lon", "lat")
        located = refs.join(at, "node_id", "left").groupBy("sequence", "ordinal", "action", "osm_type", "id", "known").agg(F.count("lon").cast("int").alias("points"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    both = plain.unionByName(located)
    return both.select("sequence", "ordinal", "action", "osm_type", "id", ((F.col("action") == "delete") | (F.col("known") & (F.col("points") >= 2))).alias("usable"), *BOX)


def stale_boxes(boxed: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """osm_type, id, action, box of everything that changes make stale; ``store`` is the state before (osm_type, id, box)."""
    rows = boxed.filter("usable").select(*KEY, "sequence", "ordinal", "action", F.when(F.col("action") != "delete", F.struct(*BOX)).alias("now"))
    if store is not None:
        rows = rows.unionByName(store.select(*KEY, F.lit(-1).cast("long").alias("sequence"), F.lit(-1).cast("long").alias("ordinal"), F.lit("stored").alias("action"), F.struct(*BOX).alias("now")))
    before = F.expr("lag(now) over (partition by osm_type, id order by sequence, ordinal)")
    both = rows.withColumn("old", before).filter("action <> 'stored'").select(*KEY, "action", F.explode(F.array_compact(F.array("old", "now"))).alias("b"))
    return both.select(*KEY, "action", *(F.col(f"b.{c}").alias(c) for c in BOX))


def store_after(boxed: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The state after the changes: the last box of every feature that is still there."""
    rows = boxed.filter("usable").select(*KEY, "sequence", "ordinal", F.when(F.col("action") != "delete", F.struct(*BOX)).alias("now"))
    if store is not None:
        rows = rows.unionByName(store.select(*KEY, F.lit(-1).cast("long").alias("sequence"), F.lit(-1).cast("long").alias("ordinal"), F.struct(*BOX).alias("now")))
    last = rows.groupBy(*KEY).agg(F.max_by("now", F.struct("sequence", "ordinal")).alias("now"))
    return last.filter("now is not null").select(*KEY, *(F.col(f"now.{c}").alias(c) for c in BOX))


def counters(boxed: DataFrame) -> DataFrame:
    """created, modified, deleted, skipped."""
    n = lambda a: F.count_if(F.col("usable") & (F.col("action") == a))
    return boxed.agg(n("create").alias("created"), n("modify").alias("modified"), n("delete").alias("deleted"), F.count_if(~F.col("usable")).alias("skipped"))


def dirty_tiles(stale: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Distinct z, x, y of the tiles that stale boxes touch."""
    lowest: Column = F.lit(min_zoom)
    return spatial.tiles_of_boxes(stale.select(*BOX).distinct(), lowest, max_zoom).select("z", "x", "y").distinct()


class BoxKeeper(StatefulProcessor):
    """Keeps the box of one feature and emits the boxes that each change makes stale."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.box = handle.getValueState("box", "min_lon double, min_lat double, max_lon double, max_lat double, sequence long, ordinal long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values(["sequence", "ordinal"], kind="stable")
        held = self.box.get() if self.box.exists() else None
        out = []
        for c in changes.itertuples():
            if not c.usable or (held is not None and (c.sequence, c.ordinal) <= (held[4], held[5])):
                continue
            if held is not None and held[0] is not None:
                out.append((key[0], key[1], c.action, *held[:4]))
            box = (None,) * 4 if c.action == "delete" else (c.min_lon, c.min_lat, c.max_lon, c.max_lat)
            if c.action != "delete":
                out.append((key[0], key[1], c.action, *box))
            held = (*box, c.sequence, c.ordinal)
        if held is not None:
            self.box.update(held)
        yield pd.DataFrame(out, columns=["osm_type", "id", "action", *BOX])

    def close(self) -> None:
        pass


def stream_stale_boxes(boxed: DataFrame) -> DataFrame:
    """``stale_boxes`` of a stream; needs the RocksDB state store."""
    return boxed.groupBy(*KEY).transformWithStateInPandas(BoxKeeper(), STALE, outputMode="Append", timeMode="None")


def point_box(lon: Column, lat: Column) -> list[Column]:
    return [lon.alias("min_lon"), lat.alias("min_lat"), lon.alias("max_lon"), lat.alias("max_lat")]


def tile_at(lon: float, lat: float, zoom: int) -> tuple[Column, Column]:
    return G.tile_x(F.lit(lon), zoom), G.tile_y(F.lit(lat), zoom)
