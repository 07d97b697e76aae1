"""Cartographic styles as lookups, scenes as tables of draw commands, label placement."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.tags import literal_map

# Fill colours by layer and class ("" is the layer's default).
FILL = {
    "building": {"": "#dfdbd7"},
    "landuse": {"": "#d5cfc8", "forest": "#add19e", "grass": "#cdebb0", "meadow": "#cdebb0", "farmland": "#d5e29e", "residential": "#e0d6d0", "commercial": "#f2dad9", "industrial": "#ebdbe8", "cemetery": "#aacbaf"},
    "natural": {"wood": "#add19e", "scrub": "#c8d7ab", "grassland": "#cdebb0", "sand": "#f5e9c6", "beach": "#f5e9c6", "glacier": "#ddecec", "water": "#aad3df"},
    "water": {"lake": "#aad3df", "pond": "#aad3df", "reservoir": "#aad3df", "basin": "#aad3df"},
    "leisure": {"park": "#c8facc", "garden": "#c8facc", "nature_reserve": "#c8facc", "golf_course": "#b5e3b5"},
    "amenity": {"parking": "#eeeeee"},
}
# Strokes as colour, width, cap, join.
_ROAD = ("round", "round")
STROKE = {
    "highway": {"": ("#cccccc", 0.75, *_ROAD), "motorway": ("#e892a2", 4.0, *_ROAD), "motorway_link": ("#e892a2", 4.0, *_ROAD), "trunk": ("#f9b29c", 3.5, *_ROAD), "trunk_link": ("#f9b29c", 3.5, *_ROAD), "primary": ("#fcd6a4", 3.0, *_ROAD), "primary_link": ("#fcd6a4", 3.0, *_ROAD), "secondary": ("#f7fabf", 2.5, *_ROAD), "secondary_link": ("#f7fabf", 2.5, *_ROAD), "tertiary": ("#ffffff", 2.0, *_ROAD), "tertiary_link": ("#ffffff", 2.0, *_ROAD), "residential": ("#ffffff", 1.5, *_ROAD), "unclassified": ("#ffffff", 1.5, *_ROAD), "service": ("#ffffff", 1.0, *_ROAD)},
    "railway": {"": ("#bfbfbf", 1.0, "butt", "miter"), "rail": ("#bfbfbf", 1.5, "butt", "miter")},
    "water": {"river": ("#aad3df", 2.5, *_ROAD), "stream": ("#aad3df", 1.5, *_ROAD), "canal": ("#aad3df", 1.5, *_ROAD)},
    "boundary": {"": ("#9e9cab", 1.5, "butt", "miter")},
}
# Drawing order, lower first.
Z_ORDER = {"landuse": 10, "contour": 15, "natural": 20, "leisure": 30, "building": 50, "boundary": 60, "railway": 70, "water": 80, "highway": 100, "amenity": 110, "emergency": 112, "education": 113, "shop": 115, "club": 115, "tourism": 120, "office": 125, "healthcare": 130, "craft": 135, "historic": 140, "place": 200}
STILL_WATER, STILL_WATER_Z = ("lake", "pond", "reservoir"), 40
# The second set, for features read back from tiles.
TILE_Z_ORDER = {"landuse": 10, "natural": 20, "leisure": 30, "water": 40, "building": 50, "boundary": 60, "railway": 70, "highway": 100}
TILE_Z_DEFAULT = 150
TILE_FILL = {"building": {"": "#dfdbd7"}, "landuse": {k: v for k, v in FILL["landuse"].items() if k != "cemetery"}, "natural": {"wood": "#add19e", "water": "#aad3df", "grassland": "#cdebb0", "sand": "#f5e9c6", "beach": "#f5e9c6"}, "leisure": {"": "#c8facc"}, "water": {"": "#aad3df"}}
TILE_STROKE = {"highway": {"": ("#cccccc", 0.5), "motorway": ("#e892a2", 3.0), "motorway_link": ("#e892a2", 3.0), "trunk": ("#f9b29c", 2.5), "trunk_link": ("#f9b29c", 2.5), "primary": ("#fcd6a4", 2.0), "primary_link": ("#fcd6a4", 2.0), "secondary": ("#f7fabf", 1.5), "secondary_link": ("#f7fabf", 1.5), "tertiary": ("#ffffff", 1.2), "tertiary_link": ("#ffffff", 1.2), "residential": ("#ffffff", 0.8), "unclassified": ("#ffffff", 0.8)}, "railway": {"": ("#bfbfbf", 1.0)}, "boundary": {"": ("#9e9cab", 1.0)}, "water": {"": ("#aad3df", 1.5)}}
# Labels as size, colour, widest view in degrees.
LABELS = {
    "highway": {"": (8.0, "#777777", 0.1), "motorway": (11.0, "#555555", 20.0), "trunk": (11.0, "#555555", 20.0), "primary": (10.0, "#555555", 5.0), "secondary": (9.0, "#666666", 1.0), "tertiary": (9.0, "#666666", 1.0), "residential": (8.5, "#777777", 0.2), "unclassified": (8.5, "#777777", 0.2)},
    "water": {"": (13.0, "#6b9daf", 10.0)},
    "place": {"": (12.0, "#666666", 2.0), "city": (24.0, "#333333", 360.0), "town": (18.0, "#444444", 30.0), "village": (14.0, "#555555", 5.0)},
    "leisure": {"": (10.0, "#3a7a3a", 1.0)},
    "amenity": {"": (9.0, "#734a08", 0.05)},
    "shop": {"": (9.0, "#5b3a0a", 0.05)},
    "tourism": {"": (9.0, "#0d7377", 0.1)},
    "healthcare": {"": (9.0, "#c4281c", 0.05)},
    "office": {"": (8.0, "#555555", 0.05)},
    "craft": {"": (8.0, "#b5651d", 0.05)},
    "historic": {"": (9.0, "#7b2d8b", 0.1)},
    "club": {"": (8.0, "#555588", 0.05)},
    "emergency": {"": (9.0, "#cc0000", 0.1)},
    "education": {"": (9.0, "#336699", 0.1)},
}
BACKGROUND = "#f2efe9"
CELL_W, CELL_H, MOST_LABELS = 120.0, 30.0, 500


def _lookup(table: dict, layer: Column, cls: Column, part: int | None = None) -> Column:
    flat = {f"{k}/{c}": v if part is None else v[part] for k, cs in table.items() for c, v in cs.items()}
    at = literal_map(flat)
    return F.coalesce(F.try_element_at(at, F.concat_ws("/", layer, cls)), F.try_element_at(at, F.concat(layer, F.lit("/"))))


def fill_colour(layer: Column, cls: Column, table: dict = FILL) -> Column:
    return _lookup(table, layer, cls)


def stroke(layer: Column, cls: Column, table: dict = STROKE) -> Column:
    """struct(colour, width[, cap, join]); null where nothing is drawn."""
    parts = len(next(iter(next(iter(table.values())).values())))
    names = ("colour", "width", "cap", "join")[:parts]
    return F.when(_lookup(table, layer, cls, 0).isNotNull(), F.struct(*(_lookup(table, layer, cls, i).alias(n) for i, n in enumerate(names))))


def z_order(layer: Column, cls: Column) -> Column:
    return F.when((layer == "water") & cls.isin(*STILL_WATER), STILL_WATER_Z).otherwise(F.try_element_at(literal_map(Z_ORDER), layer)).cast("int")


def tile_z_order(layer: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(TILE_Z_ORDER), layer), F.lit(TILE_Z_DEFAULT)).cast("int")


def scene(features: DataFrame, view: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Draw commands for features with a box and a gtype: kind, colour, width, z_order, ordinal, pixel box, in drawing order.

    Features outside the view are culled; both axes have one scale. The first
    command fills the background.
    """
    min_lon, min_lat, max_lon, max_lat = view
    scale = min(width / (max_lon - min_lon), height / (max_lat - min_lat))
    layer, cls = F.col("layer"), F.col("class")
    seen = G.boxes_meet({c: F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")}, {"min_lon": F.lit(min_lon), "min_lat": F.lit(min_lat), "max_lon": F.lit(max_lon), "max_lat": F.lit(max_lat)})
    s = stroke(layer, cls)
    fill = F.when(F.col("gtype") == "polygon", fill_colour(layer, cls))
    px = [((F.col("min_lon") - min_lon) * scale).alias("x0"), ((max_lat - F.col("max_lat")) * scale).alias("y0"), ((F.col("max_lon") - min_lon) * scale).alias("x1"), ((max_lat - F.col("min_lat")) * scale).alias("y1")]
    rows = features.filter(seen).select("id", z_order(layer, cls).alias("z_order"), F.when(fill.isNotNull(), "fill").when((F.col("gtype") == "line") & s.isNotNull(), "stroke").alias("kind"), F.coalesce(fill, s["colour"]).alias("colour"), F.when(fill.isNull(), s["width"]).alias("width"), *px)
    return rows.filter("kind is not null").orderBy("z_order", "id")


def label_candidates(features: DataFrame) -> DataFrame:
    """Named features with their label's size, colour and widest view; the anchor is the middle of the box."""
    layer, cls = F.col("layer"), F.col("class")
    size = _lookup(LABELS, layer, cls, 0)
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    named = features.filter((F.coalesce("name", F.lit("")) != "") & size.isNotNull())
    return named.select("id", "name", size.alias("size"), _lookup(LABELS, layer, cls, 1).alias("colour"), _lookup(LABELS, layer, cls, 2).alias("widest"), mid("min_lon", "max_lon").alias("lon"), mid("min_lat", "max_lat").alias("lat"), "min_lon", "min_lat", "max_lon", "max_lat")


def _place(most: int):
    def run(labels: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in labels.sort_values(["order", "id", "name", "px", "py"]).itertuples():
            if len(out) >= most:
                break
            cells = {(i, j) for i in range(r.top, r.bottom + 1) for j in range(r.left, r.right + 1)}
            if not cells & taken:
                taken |= cells
                out.append((r.view, r.id, r.name, r.px, r.py, -r.order))
        return pd.DataFrame(out, columns=["view", "id", "name", "px", "py", "size"])

    return run


def place_labels(candidates: DataFrame, box: tuple[float, float, float, float], width: int, height: int, view: str = "v") -> DataFrame:
    """Greedy placement in one view: large labels first, on a grid that each label occupies alone.

    Placement is sequential by definition, but of candidates with the same cells
    only the first can find them free, and of those without cells only the first
    MOST_LABELS count. So what one task places is bounded by the view's grid, and
    the rest leaves in a map-side aggregation.
    """
    west, south, east, north = box
    seen = candidates.filter((F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north) & (F.col("max_lat") >= south) & (F.col("widest") >= east - west))
    across = lambda lon: (lon - west) / (east - west) * width
    down = lambda lat: (north - lat) / (north - south) * height
    inner = lambda v, a, b: F.least(F.greatest(v, F.lit(a + 0.1 * (b - a))), F.lit(b - 0.1 * (b - a)))
    lon, lat, size = F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("size").cast("double")
    near = across(lon).between(-50, width + 50) & down(lat).between(-50, height + 50)
    px, py = F.when(near, across(lon)).otherwise(across(inner(lon, west, east))), F.when(near, down(lat)).otherwise(down(inner(lat, south, north)))
    # A generated row is computed once; projections would repeat the size's lookup at every use.
    at = seen.select(F.inline(F.array(F.struct((-size).alias("order"), F.col("id"), F.col("name"), px.alias("px"), py.alias("py"), (F.octet_length("name") * size * 0.55).alias("w"), (size * 1.3).alias("h")))))
    x0, y0 = F.col("px") - F.col("w") / 2, F.col("py") - F.col("h") / 2
    first = lambda v, cell: F.greatest(F.floor(v / cell), F.lit(0)).cast("int")
    last = lambda v, cell, whole: F.least(F.ceil(v / cell), F.lit(math.ceil(whole / cell))).cast("int")
    cells = {"top": first(y0, CELL_H), "bottom": last(y0 + F.col("h"), CELL_H, height), "left": first(x0, CELL_W), "right": last(x0 + F.col("w"), CELL_W, width)}
    label = ["order", "id", "name", "px", "py"]
    at = at.select(*label, *(c.alias(n) for n, c in cells.items()))
    inside = (F.col("bottom") >= F.col("top")) & (F.col("right") >= F.col("left"))
    shown = at.filter(inside).groupBy(*cells).agg(F.min(F.struct(*label)).alias("label")).select("label.*", *cells)
    outside = at.filter(~inside).orderBy(*label).limit(MOST_LABELS)
    return shown.union(outside).withColumn("view", F.lit(view)).groupBy("view").applyInPandas(_place(MOST_LABELS), "view string, id long, name string, px double, py double, size double")


def budget(features: DataFrame, most: int) -> DataFrame:
    """The first ``most`` features in drawing order."""
    return features.orderBy(z_order(F.col("layer"), F.col("class")), "id").limit(most)


def style_json(tiles_url: str) -> dict:
    """A web-map style over the vector tiles, made from the tables above."""
    width_at = lambda w: ["interpolate", ["exponential", 1.4], ["zoom"], 5, w / 4, 18, w * 4]
    match = lambda table, pick: ["match", ["get", "class"], *(x for c, v in table.items() if c for x in (c, pick(v))), pick(table[""]) if "" in table else "rgba(0,0,0,0)"]
    plain = lambda table, pick: pick(table[""]) if set(table) == {""} else match(table, pick)
    source = {"type": "vector", "url": tiles_url} if tiles_url.startswith("pmtiles:") or tiles_url.endswith(".json") else {"type": "vector", "tiles": [tiles_url], "maxzoom": 14}
    layers: list[dict] = [{"id": "background", "type": "background", "paint": {"background-color": BACKGROUND}}]
    for layer in sorted(FILL, key=Z_ORDER.get):
        layers.append({"id": f"{layer}-fill", "type": "fill", "source": "map", "source-layer": layer, "filter": ["==", ["geometry-type"], "Polygon"], "paint": {"fill-color": plain(FILL[layer], lambda v: v)}})
    for layer in sorted(STROKE, key=Z_ORDER.get):
        layers.append({"id": f"{layer}-line", "type": "line", "source": "map", "source-layer": layer, "layout": {"line-cap": next(iter(STROKE[layer].values()))[2], "line-join": next(iter(STROKE[layer].values()))[3]}, "paint": {"line-color": plain(STROKE[layer], lambda v: v[0]), "line-width": width_at(max(v[1] for v in STROKE[layer].values()))}})
    for layer, table in LABELS.items():
        largest = max(table.values())
        layers.append({"id": f"{layer}-label", "type": "symbol", "source": "map", "source-layer": layer, "layout": {"text-field": ["get", "name"], "text-size": plain(table, lambda v: v[0])}, "paint": {"text-color": largest[1]}})
    return {"version": 8, "name": "geoloom", "sources": {"map": source}, "layers": layers}
