"""Queries over built geometry, tiles, relations, device blobs and change feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import tags as T
from geoloom.operators import compact, extract, features, spatial, tiles, ways
from geoloom.plans.queries import _typed, point_features, query, tx, ty, typed
from geoloom.plans.views import sql_with, view
from geoloom.session import shared_dir
from geoloom.streaming import replication


def _point(x, y):
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def region_polygons(spark, sf_dir) -> DataFrame:
    """The region boxes as polygons."""
    r = view(spark, sf_dir, "f_regions")
    ring = F.array(_point("min_lon", "min_lat"), _point("max_lon", "min_lat"), _point("max_lon", "max_lat"), _point("min_lon", "max_lat"), _point("min_lon", "min_lat"))
    return r.select("id", F.lit("polygon").alias("gtype"), F.array(F.array(ring)).alias("parts"))


@query(sql_with("f_regions") + "select id, round((least(max_lon,40)-greatest(min_lon,-60))*(least(max_lat,30)-greatest(min_lat,-20)), 6) as area from f_regions where least(max_lon,40)>greatest(min_lon,-60) and least(max_lat,30)>greatest(min_lat,-20)")
def clip_polygon_area(spark, sf_dir):
    c = features.clipped(region_polygons(spark, sf_dir), (-60.0, -20.0, 40.0, 30.0))
    return c.select("id", F.round(F.abs(G.twice_area(F.col("parts")[0][0])) / 2, 6).alias("area")).filter("area > 0")


@query(sql_with("f_regions") + "select id, round(least(max_lon,40)-greatest(min_lon,-60), 6) as length from f_regions where least(max_lon,40)>=greatest(min_lon,-60) and min_lat between -20 and 30")
def clip_line_pieces(spark, sf_dir):
    r = view(spark, sf_dir, "f_regions").select("id", F.lit("line").alias("gtype"), F.array(F.array(F.array(_point("min_lon", "min_lat"), _point("max_lon", "min_lat")))).alias("parts"))
    line = F.col("parts")[0][0]
    return features.clipped(r, (-60.0, -20.0, 40.0, 30.0)).select("id", F.round(F.element_at(line, -1)["x"] - line[0]["x"], 6).alias("length"))


@query()
def simplify_invariants(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    line = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: _point(F.col("embedding")[2 * i], F.col("embedding")[2 * i + 1]))
    rows = e.select(F.col("vec_id").alias("id"), F.lit("line").alias("gtype"), F.array(F.array(line)).alias("parts"))
    s = features.simplified(rows, 0.2)
    both = rows.select("id", F.col("parts")[0][0].alias("a")).join(s.select("id", F.col("parts")[0][0].alias("b")), "id")
    return both.select("id", F.size("b").alias("kept"), ((F.element_at("a", 1) == F.element_at("b", 1)) & (F.element_at("a", -1) == F.element_at("b", -1))).alias("ends_stay"), (F.size(F.array_except("b", "a")) == 0).alias("subset"))


@query(sql_with("f_regions") + "select id as rel_id, 1 as polygons, 1 as holes, 1 as matched, 0 as orphaned, 0 as open_rings, round((max_lon-min_lon)*(max_lat-min_lat)-4, 6) as area from f_regions")
def multipolygon_report(spark, sf_dir):
    r = view(spark, sf_dir, "f_regions")
    c = F.col
    lower = F.array(_point("min_lon", "min_lat"), _point("max_lon", "min_lat"), _point("max_lon", "max_lat"))
    upper = F.array(_point("min_lon", "min_lat"), _point("min_lon", "max_lat"), _point("max_lon", "max_lat"))
    at = lambda dx, dy: _point(c("min_lon") + 5 + dx, c("min_lat") + 5 + dy)
    hole = F.array(at(0, 0), at(2, 0), at(2, 2), at(0, 2), at(0, 0))
    pieces = r.select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("n"), F.lit(role).alias("role"), p.alias("points")) for i, role, p in ((0, "outer", lower), (1, "outer", upper), (2, "inner", hole))))).alias("p"))
    lines = pieces.select((c("id") * 10 + c("p.n")).alias("way_id"), "p.points")
    members = pieces.select(c("id").alias("rel_id"), (c("id") * 10 + c("p.n")).alias("way_id"), "p.role", c("p.n").alias("ordinal"))
    done = features.assembled(members, lines)
    area = F.aggregate(c("parts")[0], F.lit(0.0), lambda s, ring: s + G.twice_area(ring) / 2)
    return done.select(c("rel_id").cast("int").alias("rel_id"), "polygons", "holes", "matched", "orphaned", "open_rings", F.round(area, 6).alias("area"))


def _entities(spark, sf_dir) -> DataFrame:
    p = view(spark, sf_dir, "f_points")
    t = F.create_map(F.lit("name"), F.concat(F.lit("Shop "), (F.col("id") % 200).cast("string")), F.lit("phone"), F.when(F.col("id") % 3 == 0, "+1 555").otherwise(""), F.lit("cuisine"), F.col("v"))
    near = p.select(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"), t.alias("tags"), (F.col("id") % 200 / 10.0 + F.floor(F.col("id") / 600) * 5e-4).alias("lon"), F.lit(10.0).alias("lat"))
    return extract.entities(near)


@query(
    sql_with(
        "f_points",
        e="select id, id%200 as g, id//600 as cell, 2*(case when id%3=0 then 1 else 0 end) + strlen('cuisine=' || v) as rich from f_points",
        # Clusters of one name stand a whole number of 55 m steps apart; with a radius of 30 m each step is one entity.
        b="select *, row_number() over (partition by g, cell order by rich desc, id) as rn from e",
    )
    + "select id as osm_id, rich as richness from b where rn=1"
)
def dedup_entities(spark, sf_dir):
    d = extract.deduplicated(_entities(spark, sf_dir), 30.0)
    return d.select("osm_id", T.richness(F.col("address"), F.col("phone"), F.col("website"), F.col("operator"), F.col("tags")).alias("richness"))


@query(sql_with("f_points") + "select 'Shop ' || cast(id%200 as varchar) || ',,' || (case when id%3=0 then '+1 555' else '' end) || ',,,' || '10.000000' || ',' || printf('%.6f', cast(id%200 as double)/10.0 + (id//600)*5e-4) || ',cuisine=' || v || ',node' as value from f_points")
def entity_csv(spark, sf_dir):
    return extract.csv_lines(_entities(spark, sf_dir))


@query()
def entity_geojson(spark, sf_dir):
    return extract.geojson_rows(_entities(spark, sf_dir))


def tile_points(spark, sf_dir) -> DataFrame:
    p = point_features(spark, sf_dir)
    return p.select("id", "layer", "class", F.lit("point").alias("gtype"), F.array(F.array(F.array(_point("lon", "lat")))).alias("parts"), F.create_map(F.lit("name"), F.col("name")).alias("tags"), "min_lon", "min_lat", "max_lon", "max_lat", F.col("id").alias("ordinal"), "lon", "lat")


@query(sql_with("f_points", **_typed("f_points")) + "select z, layer, count(*) as n, true as close, true as named from (select *, unnest(range(mz, 15)) as z from typed where mz <= 14) group by z, layer")
def mvt_roundtrip(spark, sf_dir):
    p = tile_points(spark, sf_dir)
    back = tiles.decode(tiles.generate(p, 0, 14))
    at = F.col("parts")[0][0][0]
    both = back.select("z", "layer", "id", F.col("name").alias("got"), at["x"].alias("x"), at["y"].alias("y")).join(p.select("id", F.col("tags.name").alias("want"), "lon", "lat"), "id")
    unit = 360.0 / F.pow(F.lit(2.0), F.col("z")) / 4096
    close = (F.abs(F.col("x") - F.col("lon")) <= unit) & (F.abs(F.col("y") - F.col("lat")) <= unit)
    return both.groupBy(F.col("z").cast("long").alias("z"), "layer").agg(F.count(F.lit(1)).alias("n"), F.bool_and(close).alias("close"), F.bool_and(F.col("got") == F.col("want")).alias("named"))


def way_shapes(spark, sf_dir) -> DataFrame:
    """Local ways as features with geometry."""
    p = F.sort_array(F.collect_list(F.struct("seq", "node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))))
    lines = view(spark, sf_dir, "f_local").groupBy("way_id").agg(p.alias("p")).select(F.col("way_id").alias("id"), F.col("p.node_id").alias("refs"), F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
    t = typed(spark, sf_dir, "f_ways").select("id", "layer", "class")
    built = ways.way_geometry(lines.join(t, "id"), T.is_area(F.col("layer"), F.col("class")))
    b = G.box_of(F.col("points"))
    return built.select("id", "layer", "class", "gtype", "parts", F.create_map(F.lit("name"), F.concat(F.lit("Way "), F.col("id").cast("string"))).alias("tags"), *(b[c].alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")), F.col("id").alias("ordinal"))


@query()
def vector_tiles(spark, sf_dir):
    return tiles.generate(way_shapes(spark, sf_dir), 0, 8).select("z", "x", "y", "features", F.octet_length("data").alias("bytes"))


@query()
def compact_cells(spark, sf_dir):
    c = compact.cell_blobs(way_shapes(spark, sf_dir), (-180.0, -80.0, 180.0, 80.0), 1.0, labels=True)
    return c.select("cx", "cy", F.conv(F.hex(F.substring("blob", 25, 2)), 16, 10).cast("int").alias("features"), F.octet_length("blob").alias("bytes"))


def _boxed(spark, sf_dir) -> DataFrame:
    c = view(spark, sf_dir, "f_changes")
    return c.select(F.col("seq").alias("sequence"), "ordinal", "action", F.lit("node").alias("osm_type"), "id", ((F.col("action") == "delete") | (F.col("k") != "note")).alias("usable"), *replication.point_box(F.col("lon"), F.col("lat")))


@query(sql_with("f_changes") + "select count(*) filter (where k<>'note' and action='create') as created, count(*) filter (where k<>'note' and action='modify') as modified, count(*) filter (where action='delete') as deleted, count(*) filter (where k='note' and action<>'delete') as skipped from f_changes")
def change_counters(spark, sf_dir):
    return replication.counters(_boxed(spark, sf_dir))


_STALE = {
    "u": "select *, case when action<>'delete' then lon end as nlon, case when action<>'delete' then lat end as nlat from f_changes where action='delete' or k<>'note'",
    "l": "select *, lag(nlon) over (partition by id order by seq, ordinal) as olon, lag(nlat) over (partition by id order by seq, ordinal) as olat from u",
    "s": "select nlon as lon, nlat as lat from l where nlon is not null union select olon, olat from l where olon is not null",
}
DIRTY_SQL = sql_with("f_changes", **_STALE) + f"select distinct z, {tx()} as x, {ty()} as y from (select *, unnest(range(0, 9)) as z from s)"


def _long_z(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.col("z").cast("long"))


@query(DIRTY_SQL)
def dirty_tiles_batch(spark, sf_dir):
    return _long_z(replication.dirty_tiles(replication.stale_boxes(_boxed(spark, sf_dir)), 0, 8))


@query(DIRTY_SQL)
def dirty_tiles_stream(spark, sf_dir):
    """The same through the stateful stream, run over everything that is there."""
    base = f"{shared_dir(spark)}/dirty-{uuid.uuid4().hex}"
    boxed = _boxed(spark, sf_dir)
    boxed.repartition(2).write.parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    feed = spark.readStream.schema(boxed.schema).parquet(f"{base}/in")
    run = replication.stream_stale_boxes(feed).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return _long_z(replication.dirty_tiles(spark.read.schema(replication.STALE).parquet(f"{base}/out"), 0, 8))


@query(sql_with("f_changes", **_STALE, last="select id, arg_max(coalesce(nlon, -999), seq*1000000+ordinal) as lon, arg_max(coalesce(nlat, -999), seq*1000000+ordinal) as lat from u group by id") + "select id, lon as min_lon, lat as min_lat from last where lon > -999")
def store_after_changes(spark, sf_dir):
    return replication.store_after(_boxed(spark, sf_dir)).select("id", "min_lon", "min_lat")


@query(sql_with("f_points") + f"select z, x, y, count(*) as n from (select z, {tx()} as x, {ty()} as y from (select *, unnest([3, 6]) as z from f_points)) group by all")
def tile_counts(spark, sf_dir):
    p = view(spark, sf_dir, "f_points").select("lon", "lat", F.explode(F.array(F.lit(3), F.lit(6))).alias("z"))
    return p.groupBy("z", G.tile_x(F.col("lon"), F.col("z")).alias("x"), G.tile_y(F.col("lat"), F.col("z")).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(sql_with("f_points", "f_regions") + "select r.id as region_id, count(*) as n from f_points p join f_regions r on p.lon between r.min_lon and r.max_lon and p.lat between r.min_lat and r.max_lat group by r.id")
def points_in_regions(spark, sf_dir):
    found = spatial.points_in_boxes(view(spark, sf_dir, "f_points").select("id", "lon", "lat"), view(spark, sf_dir, "f_regions"))
    return found.groupBy(F.col("b_id").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))
