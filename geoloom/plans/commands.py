"""The whole pipelines: load, inspect, tiles, extract, device areas and bundles, update, serve."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import shapes, vocab
from geoloom.functions import tags as T
from geoloom.operators import compact, extract, features, inspection, spatial, tiles, ways
from geoloom.operators.tiles import PARTS
from geoloom.plugins import App, Sources
from geoloom.sources import changes, files
from geoloom.streaming import replication

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """All elements of a map extract."""
    App(spark).add(Sources())
    return spark.read.format("osm_pbf").load(path)


def _kinds(df: DataFrame, layers: Iterable[str]) -> DataFrame:
    layer, cls = T.classify(F.col("tags"), layers)
    return df.withColumns({"layer": layer, "class": cls}).filter("layer is not null")


def _finished(df: DataFrame, osm_type: str, order: int) -> DataFrame:
    shaped = files.boxed(df.select(F.lit(osm_type).alias("osm_type"), "id", "layer", "class", "gtype", F.col("parts").cast(PARTS).alias("parts"), "tags"))
    return shaped.withColumn("ordinal", F.struct(F.lit(order).alias("kind"), F.col("id").alias("id")))


def build_features(all_elements: DataFrame, layers: Iterable[str] = vocab.LAYERS, packed: bool = False) -> DataFrame:
    """Features of points of interest, ways and multipolygon relations.

    Elements are classified before any join, so only ways that become features
    or belong to a needed relation look up their nodes. ``packed`` rounds way
    coordinates as a store of 32-bit floats would.
    """
    layers = tuple(layers)
    nodes = all_elements.filter("osm_type = 'node'")
    points = _kinds(nodes.filter(F.size("tags") > 0), layers).withColumn("gtype", F.lit("point")).withColumn("parts", F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))))
    relations = _kinds(all_elements.filter("osm_type = 'relation'").filter(F.try_element_at("tags", F.lit("type")) == "multipolygon"), layers)
    members = relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("ordinal", "m")).filter("m.type = 'way'").select("rel_id", "ordinal", F.col("m.ref").alias("way_id"), F.col("m.role").alias("role"))
    kinds = _kinds(all_elements.filter("osm_type = 'way'"), layers)
    way_refs = all_elements.filter("osm_type = 'way'").select("id", "refs")
    needed = way_refs.join(kinds.select("id").union(members.select(F.col("way_id").alias("id"))).distinct(), "id", "left_semi")
    place = lambda c, offset: G.packed(F.col(c), offset) if packed else F.col(c)
    store = inspection.node_store(nodes).select("id", place("lon", 256.0).alias("lon"), place("lat", 128.0).alias("lat"))
    lines = ways.way_lines(needed.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id")), store)
    own = kinds.drop("refs").join(lines.withColumnRenamed("way_id", "id"), "id")
    shaped = ways.way_geometry(own, T.is_area(F.col("layer"), F.col("class")))
    done = features.assembled(members, lines).filter("error is null").select(F.col("rel_id").alias("id"), "gtype", "parts")
    areas = relations.select("id", "layer", "class", "tags").join(done, "id")
    return _finished(points, "node", 0).unionByName(_finished(shaped, "way", 1)).unionByName(_finished(areas, "relation", 2))


def inspect(spark: SparkSession, path: str) -> dict:
    """Counters, box, distinct strings and layers of a map extract."""
    e = elements(spark, path)
    f = build_features(e)
    return {"counters": inspection.load_counters(e, f).first().asDict(), "box": tuple(inspection.extent(f).first()), "strings": inspection.distinct_strings(e), "layers": {r["layer"]: r["n"] for r in inspection.layer_counts(f).collect()}}


def generate_tiles(spark: SparkSession, path: str, out: str, zooms: str = "0-14", layers: str | None = None, include: str | None = None, exclude: str | None = None, all_tags: bool = False) -> DataFrame:
    """Writes the tile table of a map extract (PBF or GeoJSON) and returns it."""
    if path.endswith((".geojson", ".json")):
        f = files.boxed(files.geojson(spark, path))
    else:
        f = build_features(elements(spark, path), T.parse_layers(layers))
    f = f.filter(T.include_exclude(F.col("tags"), include, exclude))
    low, high = inspection.parse_zooms(zooms)
    tiles.write_table(tiles.generate(f, low, high, all_tags), out)
    return spark.read.parquet(out)


def extract_entities(spark: SparkSession, path: str, out: str, include: str | None = None, exclude: str | None = None, box: str | None = None, radius: float | None = 100.0) -> DataFrame:
    """Named entities of a map extract, deduplicated unless ``radius`` is None, written by the ending of ``out``.

    Ways are filtered by name and tags before their nodes are looked up; a way
    stands at the mean of its nodes, a relation nowhere.
    """
    e = elements(spark, path)
    wanted: Column = T.has_tag(F.col("tags"), "name") & T.include_exclude(F.col("tags"), include, exclude)
    named = e.filter(wanted)
    refs = named.filter("osm_type = 'way'").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id"))
    means = ways.resolved(refs, e.filter("osm_type = 'node'").select("id", "lon", "lat")).groupBy("way_id").agg(F.avg("lon").alias("mean_lon"), F.avg("lat").alias("mean_lat"))
    at_way = named.filter("osm_type = 'way'").join(means, F.col("id") == F.col("way_id"), "left").select("osm_type", F.col("id").alias("osm_id"), "tags", F.col("mean_lon").alias("lon"), F.col("mean_lat").alias("lat"))
    rest = named.filter("osm_type <> 'way'").select("osm_type", F.col("id").alias("osm_id"), "tags", "lon", "lat")
    found = extract.entities(rest.unionByName(at_way), include, exclude, inspection.parse_box(box) if box else None)
    if radius is not None:
        found = extract.deduplicated(found, radius)
    extract.write(found, out)
    return found


def compact_area(f: DataFrame, box: shapes.Box, contours: DataFrame | None = None, width: int = 176, height: int = 176, interval: int = 20) -> bytes:
    """The device blob of one area, with labels; contour lines follow the map features."""
    rows = compact.marked(spatial.in_range(f, *box)).select("ordinal", "gtype", "parts", "poi", "labelled", "category", "subcategory", "poi_type", "area", "elevation", "name", "short_name")
    found = [r.asDict(recursive=True) for r in rows.orderBy("ordinal").toLocalIterator()]  # one area of one display
    if contours is not None:
        lines = contours.withColumn("tags", F.create_map().cast("map<string,string>"))
        found += [r.asDict(recursive=True) for r in compact.marked(lines).orderBy(F.desc("id")).toLocalIterator()]
    return compact.build_blob([r | {"parts": tiles.as_arrays(r["parts"])} for r in found], box, width, height, interval)


def region_bundle(f: DataFrame, region: shapes.Box, path: str, step: float = 0.05, version: int = 1) -> int:
    """Writes the bundle of a region's grid cells; returns the number of cells."""
    cells = compact.cell_blobs(f, region, step).toLocalIterator()
    data = compact.bundle(cells, region, step, version)
    with open(path, "wb") as out:
        out.write(data)
    return int.from_bytes(data[4:8], "little")


def update(spark: SparkSession, feed: str, state: changes.ReplicationState, store: DataFrame | None, nodes: DataFrame | None, min_zoom: int, max_zoom: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dirty tiles, store afterwards, counters) of the diffs after the state's sequence."""
    rows = changes.read(spark, feed).filter(F.col("sequence") > state.sequence)
    boxed = replication.boxed_changes(rows, nodes)
    return replication.dirty_tiles(replication.stale_boxes(boxed, store), min_zoom, max_zoom), replication.store_after(boxed, store), replication.counters(boxed)


def follow(spark: SparkSession, feed: str, state_path: str, work: str, min_zoom: int, max_zoom: int, nodes: DataFrame | None = None) -> int:
    """Applies the diffs after the state one by one and returns how many there were.

    Each writes its dirty tiles and the store after it below ``work`` before the
    state moves on, so a run that stops half-way repeats one diff only.
    """
    done = 0
    state = changes.ReplicationState.load(state_path)
    for sequence in [s for s in changes.sequences(spark, feed) if s > state.sequence]:
        if sequence != state.sequence + 1:
            break  # a diff is missing
        store = spark.read.parquet(f"{work}/store/{state.sequence}") if done or state.sequence in _stores(spark, work) else None
        rows = changes.read(spark, feed).filter(F.col("sequence") == sequence)
        boxed = replication.boxed_changes(rows, nodes)
        replication.dirty_tiles(replication.stale_boxes(boxed, store), min_zoom, max_zoom).write.mode("overwrite").parquet(f"{work}/dirty/{sequence}")
        replication.store_after(boxed, store).write.mode("overwrite").parquet(f"{work}/store/{sequence}")
        state = state.advanced()
        state.save(state_path)
        done += 1
    return done


def _stores(spark: SparkSession, work: str) -> set[int]:
    """Sequences whose store is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/store/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return {int(f.getPath().getParent().getName()) for f in found}


def area_at(f: DataFrame, regions: DataFrame, lon: float, lat: float, step: float = 0.05) -> tuple[str, bytes] | None:
    """(grid key, blob) of the cell around a position, if a region covers it."""
    if not files.region_at(regions, lon, lat).count():
        return None
    key, south, west = f.sparkSession.range(1).select(G.grid_key(F.lit(lat), F.lit(lon), step), G.snap(F.lit(lat), step), G.snap(F.lit(lon), step)).first()
    return key, compact_area(f, (west, south, west + step, south + step))
