"""Queries for the smaller operators: formats, arguments, sources and sinks, each with independent SQL."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import tags as T
from geoloom.functions import text as X
from geoloom.functions import tilecodec, vocab
from geoloom.functions.tilecodec import varint, zigzag
from geoloom.operators import compact, extract, features, inspection, style, tiles
from geoloom.plans.feature_queries import _entities, _point, tile_points
from geoloom.plans.queries import _TRAIL_SQL, _table, _typed, query, tx, ty, typed
from geoloom.plans.views import sql_with, view
from geoloom.session import shared_dir
from geoloom.sources import changes, files
from geoloom.streaming import replication

_LAT = "radians(greatest(-85.051129, least(85.051129, lat)))"


@query(sql_with("f_points", t=f"select *, {tx(z='9')} as x, {ty(z='9')} as y from f_points") + f"select id, round(((lon+180)/360*512-x)*4096, 2) as px, round(((1-ln(tan({_LAT})+1/cos({_LAT}))/pi())/2*512-y)*4096, 2) as py from t")
def tile_local(spark, sf_dir):
    p = view(spark, sf_dir, "f_points")
    x, y = G.tile_x(F.col("lon"), 9), G.tile_y(F.col("lat"), 9)
    return p.select("id", F.round(G.local_x(F.col("lon"), x, 9), 2).alias("px"), F.round(G.local_y(F.col("lat"), y, 9), 2).alias("py"))


@query("select z, 360.0::double/pow(2, least(z, 22))/4096 as degrees from (select unnest(range(0, 25)) as z)")
def tolerances(spark, sf_dir):
    return spark.range(25).select(F.col("id").alias("z"), G.tolerance(F.col("id")).alias("degrees"))


@query(sql_with("f_points") + "select id, cast(cast(lon+256 as float) as double)-256 as lon, cast(cast(lat+128 as float) as double)-128 as lat, lon*1.5 between -180 and 180 and lat*1.5 between -90 and 90 as valid from f_points")
def stored_positions(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    return view(spark, sf_dir, "f_points").select("id", G.packed(lon, 256.0).alias("lon"), G.packed(lat, 128.0).alias("lat"), G.valid_position(lon * 1.5, lat * 1.5).alias("valid"))


@query("select p_partkey as id, cast(floor(fmod(atan2(p_partkey%5-2, p_partkey%7-3)*128/pi()+256, 256)) as int) % 256 as angle from part")
def label_angles(spark, sf_dir):
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.label_angle((F.col("p_partkey") % 7 - 3).cast("double"), (F.col("p_partkey") % 5 - 2).cast("double")).alias("angle"))


@query(sql_with("f_points", v="select id, lon, lat, id*0.01+0.003 as deg from f_points") + "select id, cast(greatest(0, least(14, floor(log2(360.0/deg)))) as int) as zoom, round(lon-deg/2, 9) as min_lon, round(lat-deg/1.6/2, 9) as min_lat, round(lon+deg/2, 9) as max_lon, round(lat+deg/1.6/2, 9) as max_lat from v")
def camera_views(spark, sf_dir):
    deg = F.col("id") * F.lit(0.01) + F.lit(0.003)
    b = G.view_box(F.col("lon"), F.col("lat"), deg, 1.6)
    return view(spark, sf_dir, "f_points").select("id", G.view_zoom(deg).alias("zoom"), *(F.round(c, 9).alias(k) for k, c in b.items()))


@query(sql_with("f_regions") + "select id, printf('%.6f,%.6f,%.6f,%.6f', min_lon-(max_lon-min_lon)*0.1, min_lat-(max_lat-min_lat)*0.1, max_lon+(max_lon-min_lon)*0.1, max_lat+(max_lat-min_lat)*0.1) as box from f_regions")
def grown_boxes(spark, sf_dir):
    box = F.struct("min_lon", "min_lat", "max_lon", "max_lat")
    return view(spark, sf_dir, "f_regions").select("id", G.box_text(G.expand(box, 0.1)).alias("box"))


_ADDRESSES = "select c_custkey as id, c_mktsegment as street, case when c_custkey%3=0 then '' else 'P' || c_nationkey end as code, c_name as name from {customer}"


@query(sql_with(a=_ADDRESSES.replace("{customer}", "customer")) + "select id, case when code='' then '' else 'addr_postcode=' || code || ';' end || 'addr_street_left=' || street as parts from a")
def address_fields(spark, sf_dir):
    a = spark.sql(_ADDRESSES, customer=view(spark, sf_dir, "customer"))
    t = F.create_map(F.lit("addr:street:left"), F.col("street"), F.lit("addr:postcode"), F.col("code"), F.lit("name"), F.col("name"), F.lit("addr:"), F.col("name"))
    return a.select("id", F.array_join(F.transform(F.array_sort(F.map_entries(T.address_parts(t))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("parts"))


@query("select c_custkey as id, cast(i as int) as i, cast((strlen(c_name)+6)//7 as int) as n, lower(hex(substr(c_name, 7*i+1, 7))) as part from (select c_custkey, c_name, unnest(range(0, (strlen(c_name)+6)//7)) as i from customer)")
def blob_chunks(spark, sf_dir):
    blob = F.encode("c_name", "UTF-8")
    c = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), blob.alias("blob"), X.chunk_count(blob, 7).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return c.select("id", "i", "n", F.lower(F.hex(X.chunk(F.col("blob"), F.col("i"), 7))).alias("part"))


@query("select p_partkey as id, cast((p_partkey*7919)%4000000-2000000 as int) as value, greatest(1024, (p_partkey*104729)//1048576*10000) as features, greatest(1024, (p_partkey*104729)//1048576*10000)*256 as memory from part")
def blob_numbers(spark, sf_dir):
    p = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919) % 4000000 - 2000000).alias("v"))
    blob = F.unhex(F.concat(F.lit("00" * 8), F.lpad(F.hex(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    size = F.col("id") * 104729
    return p.select("id", X.big_endian_int(blob, 8).alias("value"), X.feature_estimate(size).alias("features"), X.memory_estimate(size).alias("memory"))


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of every row (a dict), as rows of ``schema``."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([f(r) for r in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, schema)


def _value(r: dict) -> dict:
    k, n = r["id"] % 7, r["id"]
    body = lambda number, wire, payload: varint(number << 3 | wire) + payload
    text = r["name"].encode()
    data = [body(1, 2, varint(len(text)) + text), body(2, 5, struct.pack("<f", n + 0.5)), body(3, 1, struct.pack("<d", n + 0.25)), body(4, 0, varint(-n % (1 << 64))), body(5, 0, varint(n)), body(6, 0, varint(zigzag(-n))), body(7, 0, varint(n % 2))][k]
    return {"id": n, "text": tilecodec.value_text(data)}


@query("select p_partkey as id, case p_partkey%7 when 0 then p_name when 1 then cast(p_partkey+0.5 as varchar) when 2 then p_partkey || '.25' when 3 then cast(-p_partkey as varchar) when 4 then cast(p_partkey as varchar) when 5 then cast(-p_partkey as varchar) else (case when p_partkey%2=1 then 'true' else 'false' end) end as text from part")
def tag_values(spark, sf_dir):
    return _mapped(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), _value, "id long, text string")


_LISTS = ("", "all", "none", "highway", " Water , highway", "building,landuse,natural,place")
_LAYER_SQL = _table("pos, layer", list(enumerate(vocab.LAYERS)))


@query(f"with l as ({_LAYER_SQL}), t as ({_table('t', [(x,) for x in _LISTS])}) select t, coalesce((select string_agg(layer, ',' order by pos) from l where t in ('', 'all') or list_contains(list_transform(string_split(t, ','), lambda s: lower(trim(s))), layer)), '') as layers from t")
def layer_lists(spark, sf_dir):
    return spark.createDataFrame([(t, ",".join(T.parse_layers(t))) for t in _LISTS], "t string, layers string")


_BOXES, _ZOOMS = ("1,2,3,4", "-180,-85.5,180,85.5", "0,0,0,0", "7.25,46,8,47"), ("0-14", "5", "3-9", "14-14")


@query(f"with t as ({_table('b, z', list(zip(_BOXES, _ZOOMS, strict=True)))}) select b, split_part(b,',',1)::double as min_lon, split_part(b,',',2)::double as min_lat, split_part(b,',',3)::double as max_lon, split_part(b,',',4)::double as max_lat, split_part(z,'-',1)::int as low, (case when z like '%-%' then split_part(z,'-',2) else z end)::int as high from t")
def parsed_arguments(spark, sf_dir):
    return spark.createDataFrame([(b, *inspection.parse_box(b), *inspection.parse_zooms(z)) for b, z in zip(_BOXES, _ZOOMS, strict=True)], "b string, min_lon double, min_lat double, max_lon double, max_lat double, low int, high int")


@query(sql_with("f_ways", **_typed("f_ways")) + f"select id, layer, cls as class from typed where ({_TRAIL_SQL}) and not (layer='highway' and cls='footway' and id%4 in (0, 1))")
def trails_without_sidewalks(spark, sf_dir):
    walk = F.when(F.col("id") % 4 == 0, "sidewalk").when(F.col("id") % 4 == 1, "crossing").otherwise("access_aisle")
    t = typed(spark, sf_dir, "f_ways").withColumn("tags", F.create_map(F.lit("footway"), walk))
    return t.filter(T.trail_relevant(F.col("layer"), F.col("class"), F.col("tags"))).select("id", "layer", "class")


@query(sql_with("f_changes") + "select id, arg_max(lon, ordinal) as lon, arg_max(lat, ordinal) as lat from (select id-20 as id, ordinal, lon, lat from f_changes) where id>=0 group by id")
def node_positions(spark, sf_dir):
    return inspection.node_store(view(spark, sf_dir, "f_changes").select((F.col("id") - 20).alias("id"), "ordinal", "lon", "lat"), "ordinal")


@query(sql_with("f_points", w=_table("s", [(k,) for k in vocab.WELL_KNOWN])) + "select count(*) as n from (select k as s from f_points union select v from f_points union select name from f_points union select 'name' union select s from w)")
def string_table(spark, sf_dir):
    p = view(spark, sf_dir, "f_points").select(F.create_map(F.col("k"), F.col("v"), F.lit("name"), F.col("name")).alias("tags"))
    return spark.createDataFrame([(inspection.distinct_strings(p),)], "n long")


@query("select count(*) filter (where o_orderkey%3=0) as nodes, count(*) filter (where o_orderkey%3=1) as ways, count(*) filter (where o_orderkey%3=2) as relations from orders")
def element_counters(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return extract.counters(view(spark, sf_dir, "orders").select(kind.alias("osm_type")))


@query(sql_with("f_regions") + "select id, 5 as outer_points, 2 as rings, 1 as bare_rings, round((max_lon-min_lon)*(max_lat-min_lat), 6) as area from f_regions")
def simplified_rings(spark, sf_dir):
    """Rings with a vertex in the middle of each edge lose these vertices and nothing else."""
    r, c = view(spark, sf_dir, "f_regions"), F.col
    middle = lambda a, b: (c(a) + c(b)) / 2
    x, y = middle("min_lon", "max_lon"), middle("min_lat", "max_lat")
    ring = F.array(_point("min_lon", "min_lat"), _point(x, "min_lat"), _point("max_lon", "min_lat"), _point("max_lon", y), _point("max_lon", "max_lat"), _point(x, "max_lat"), _point("min_lon", "max_lat"), _point("min_lon", y), _point("min_lon", "min_lat"))
    hole = F.array(_point(x, y), _point(x, y + 1), _point(x + 1, y + 1), _point(x + 1, y), _point(x, y))
    rows = r.select("id", F.lit("polygon").alias("gtype"), F.array(F.array(ring, hole)).alias("parts"))
    bare = features.simplified(rows, 0.01, holes=False).select("id", F.size(c("parts")[0]).alias("bare_rings"))
    done = features.simplified(rows, 0.01).join(bare, "id")
    return done.select("id", F.size(c("parts")[0][0]).alias("outer_points"), F.size(c("parts")[0]).alias("rings"), "bare_rings", F.round(F.abs(G.twice_area(c("parts")[0][0])) / 2, 6).alias("area"))


@query(sql_with("f_points") + "select 'Shop ' || (id%200) as name, case when id%3=0 then '+1 555' else '' end as phone, 'cuisine=' || v as tags, cast(10.0 as double) as lat, round((id%200)/10.0+(id//600)*5e-4, 6) as lon from f_points")
def entity_json(spark, sf_dir):
    back = extract.json_rows(_entities(spark, sf_dir)).select(F.from_json("value", "name string, phone string, tags string, lat double, lon double").alias("j"))
    return back.select("j.name", "j.phone", "j.tags", "j.lat", F.round("j.lon", 6).alias("lon"))


@query(sql_with("f_points") + "select 'Feature' as type, 'Point' as shape, round((id%200)/10.0+(id//600)*5e-4, 6) as lon, cast(10.0 as double) as lat, 'Shop ' || (id%200) as name, cast(case when id%3=0 then 4 else 3 end as int) as properties from f_points")
def entity_geojson_fields(spark, sf_dir):
    back = extract.geojson_rows(_entities(spark, sf_dir)).select(F.from_json("value", "type string, geometry struct<type:string,coordinates:array<double>>, properties map<string,string>").alias("j"))
    at = F.col("j.geometry.coordinates")
    return back.select("j.type", F.col("j.geometry.type").alias("shape"), F.round(at[0], 6).alias("lon"), at[1].alias("lat"), F.try_element_at("j.properties", F.lit("name")).alias("name"), F.size("j.properties").alias("properties"))


def _style_rows() -> list[tuple]:
    return [(x["id"], x["type"], x.get("source-layer")) for x in style.style_json("https://t.example/{z}/{x}/{y}.pbf")["layers"]]


@query(f"with f as ({_table('layer', [(k,) for k in style.FILL])}), s as ({_table('layer', [(k,) for k in style.STROKE])}), l as ({_table('layer', [(k,) for k in style.LABELS])}) select 'background' as id, 'background' as type, null::varchar as layer union all select layer || '-fill', 'fill', layer from f union all select layer || '-line', 'line', layer from s union all select layer || '-label', 'symbol', layer from l")
def style_layers(spark, sf_dir):
    return spark.createDataFrame(_style_rows(), "id string, type string, layer string")


def _headed(r: dict) -> dict:
    blob = compact.header_bytes((r["min_lon"], r["min_lat"], r["max_lon"], r["max_lat"]), 176, 160, 20, r["id"], 2 * r["id"], 3)
    return {"id": r["id"], **{k: v for k, v in compact.read_header(blob).items() if k in ("min_lon", "min_lat", "max_lon", "max_lat", "display_height", "features", "pois")}}


@query(sql_with("f_regions") + "select cast(id as bigint) as id, cast(trunc(min_lon*1000000) as int) as min_lon, cast(trunc(min_lat*1000000) as int) as min_lat, cast(trunc(max_lon*1000000) as int) as max_lon, cast(trunc(max_lat*1000000) as int) as max_lat, 160 as display_height, cast(id as int) as features, cast(2*id as int) as pois from f_regions")
def blob_headers(spark, sf_dir):
    return _mapped(view(spark, sf_dir, "f_regions").select("id", "min_lon", "min_lat", "max_lon", "max_lat"), _headed, "id long, min_lon int, min_lat int, max_lon int, max_lat int, display_height int, features int, pois int")


def _round_trip(r: dict) -> dict:
    import numpy as np

    n = r["id"]
    pixels = np.array([(20 + i * (n % 3), 100 + (i % 4 - 1) * (n % 9)) for i in range(n % 40 + 2)])
    back, size = compact.unpack_points(compact.pack_points(pixels))
    return {"id": n, "points": len(back), "last_x": int(back[-1][0]), "last_y": int(back[-1][1]), "same": bool((back == pixels).all())}


@query("select p_partkey as id, n as points, 20+(n-1)*(p_partkey%3) as last_x, 100+((n-1)%4-1)*(p_partkey%9) as last_y, true as same from (select p_partkey, p_partkey%40+2 as n from part)")
def packed_lines(spark, sf_dir):
    return _mapped(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), _round_trip, "id long, points long, last_x long, last_y long, same boolean")


@query(sql_with("f_changes") + "select seq as sequence, ordinal, id, action='delete' or k<>'note' as usable, lon as min_lon, lat as max_lat from f_changes")
def changes_boxed(spark, sf_dir):
    c = view(spark, sf_dir, "f_changes")
    rows = c.select(F.col("seq").alias("sequence"), "ordinal", "action", F.lit("node").alias("osm_type"), "id", "lon", "lat", F.lit(None).cast("array<long>").alias("node_refs"), F.create_map(F.col("k"), F.lit("cafe")).alias("tags"))
    return replication.boxed_changes(rows).select("sequence", "ordinal", "id", "usable", "min_lon", "max_lat")


@query(sql_with("f_changes", r="select *, row_number() over (partition by seq order by ordinal)-1 as place from f_changes") + "select seq as sequence, place as ordinal, action, id, lon, lat, k from r")
def diff_files(spark, sf_dir):
    """Diffs as documents, parsed again."""
    c = view(spark, sf_dir, "f_changes")
    element = F.format_string("<%s><node id=\"%d\" version=\"1\" lon=\"%s\" lat=\"%s\"><tag k=\"%s\" v=\"a &amp; b\"/></node></%s>", "action", "id", F.col("lon").cast("string"), F.col("lat").cast("string"), "k", "action")
    body = c.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("ordinal", element.alias("e")))).alias("e")).select(F.format_string("feed/%03d/%03d/%03d.osc", F.floor(F.col("seq") / 1_000_000), F.floor(F.col("seq") / 1000) % 1000, F.col("seq") % 1000).alias("path"), F.encode(F.concat(F.lit("<osmChange>"), F.array_join("e.e", ""), F.lit("</osmChange>")), "UTF-8").alias("content"))
    back = body.mapInArrow(changes._parsed, changes.SCHEMA)
    return back.filter(F.element_at(F.map_values("tags"), 1) == "a & b").select("sequence", "ordinal", "action", "id", "lon", "lat", F.map_keys("tags")[0].alias("k"))


def _written(spark, df: DataFrame, name: str) -> str:
    """A text column as files of the shared folder, a file per row."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(sql_with("f_points", "f_regions", **_typed("f_points")) + "select 'point' as gtype, id, layer, cls as class, 1 as points, lon as min_lon, lat as max_lat from typed union all select 'polygon', id, 'natural', 'other', 5, min_lon, max_lat from f_regions union all select 'line', id, 'highway', 'primary', 2, min_lon, max_lat from f_regions")
def geojson_scan(spark, sf_dir):
    p, r, c = view(spark, sf_dir, "f_points"), view(spark, sf_dir, "f_regions"), F.col
    feature = lambda shape, at, props: F.to_json(F.struct(F.lit("Feature").alias("type"), c("id").alias("id"), F.struct(F.lit(shape).alias("type"), at.alias("coordinates")).alias("geometry"), props.alias("properties")))
    pair = lambda x, y: F.array(c(x), c(y))
    ring = F.array(F.array(pair("min_lon", "min_lat"), pair("max_lon", "min_lat"), pair("max_lon", "max_lat"), pair("min_lon", "max_lat")))  # closed by the reader
    parts = [p.select(feature("Point", pair("lon", "lat"), F.create_map("k", "v")).alias("f")), r.select(feature("Polygon", ring, F.create_map(F.lit("name"), c("name"))).alias("f")), r.select(feature("LineString", F.array(pair("min_lon", "max_lat"), pair("max_lon", "max_lat")), F.create_map(F.lit("highway"), F.lit("primary"))).alias("f"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.pmod(F.xxhash64("f"), F.lit(5)).alias("file")).agg(F.collect_list("f").alias("fs"))
    path = _written(spark, every.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs", ","), F.lit("]}")).alias("value")), "geojson")
    back = files.boxed(files.geojson(spark, path))
    return back.select("gtype", "id", "layer", "class", F.size(c("parts")[0][0]).alias("points"), "min_lon", "max_lat")


@query(sql_with("f_regions") + "select cast(id as varchar) as id, name, 'https://d.example/' || id as url, min_lon, max_lat, round((max_lon-min_lon)*(max_lat-min_lat), 6) as area from f_regions where id%5<>0")
def region_index(spark, sf_dir):
    r, c = view(spark, sf_dir, "f_regions"), F.col
    pair = lambda x, y: F.array(c(x), c(y))
    props = F.struct(c("id").cast("string").alias("id"), "name", F.struct(F.when(c("id") % 5 != 0, F.concat(F.lit("https://d.example/"), c("id").cast("string"))).alias("pbf")).alias("urls"))
    one = F.to_json(F.struct(props.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(F.array(pair("min_lon", "min_lat"), pair("max_lon", "max_lat")))).alias("coordinates")).alias("geometry")))
    path = _written(spark, r.select(one.alias("f")).agg(F.collect_list("f").alias("fs")).select(F.concat(F.lit('{"features":['), F.array_join("fs", ","), F.lit("]}")).alias("value")), "regions")
    return files.regions(spark, path).select("id", "name", "url", "min_lon", "max_lat", F.round("area", 6).alias("area"))


_NATIONS = 25


@query("select n as id, n*40009+1 as sequence, 'https://d.example/r/' || lpad(cast((n*40009+1)//1000000 as varchar), 3, '0') || '/' || lpad(cast((n*40009+1)//1000%1000 as varchar), 3, '0') || '/' || lpad(cast((n*40009+1)%1000 as varchar), 3, '0') || '.osc.gz' as url from (select unnest(range(0, 25)) as n)")
def replication_steps(spark, sf_dir):
    states = [changes.ReplicationState(n * 40009, "2024-01-01T00:00:00Z", "https://d.example/r/") for n in range(_NATIONS)]
    return spark.createDataFrame([(n, s.advanced().sequence, s.next_url()) for n, s in enumerate(states)], "id long, sequence long, url string")


@query(sql_with("f_points", "f_regions", **_typed("f_points"))
    + "select z, 'point' as gtype, count(*) as n, true as own from (select unnest(range(mz, 11)) as z from typed where mz <= 10) group by z union all"
    + f" select z, 'line', cast(sum({tx('max_lon')}-{tx('min_lon')}+1) as bigint), true from (select *, unnest(range(4, 11)) as z from f_regions) group by z")
def mixed_tiles(spark, sf_dir):
    """Points and lines whose ids repeat, through tiles and back: each keeps its own geometry."""
    p = tile_points(spark, sf_dir)
    r = view(spark, sf_dir, "f_regions").withColumn("max_lat", F.col("min_lat"))
    line = F.array(F.array(F.array(_point("min_lon", "min_lat"), _point("max_lon", "min_lat"))))
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    lines = r.select("id", F.lit("highway").alias("layer"), F.lit("motorway").alias("class"), F.lit("line").alias("gtype"), line.alias("parts"), F.create_map(F.lit("name"), F.col("name")).alias("tags"), *box, F.struct(F.lit(1).alias("kind"), F.col("id").alias("id")).alias("ordinal"))
    both = p.select("id", "layer", "class", "gtype", "parts", "tags", *box, F.struct(F.lit(0).alias("kind"), F.col("id").alias("id")).alias("ordinal")).unionByName(lines)
    back = tiles.decode(tiles.generate(both, 0, 10)).withColumn("unit", 360.0 / F.pow(F.lit(2.0), F.col("z")) / 4096)
    want = p.select("id", F.lit("point").alias("gtype"), "lon", "lat").unionByName(r.select("id", F.lit("line").alias("gtype"), F.lit(None).cast("double").alias("lon"), F.col("min_lat").alias("lat")))
    first = F.col("parts")[0][0][0]
    close = F.coalesce(F.abs(first["x"] - F.col("lon")) <= F.col("unit"), F.lit(True)) & (F.abs(first["y"] - F.col("lat")) <= F.col("unit"))
    return back.join(want, ["id", "gtype"]).groupBy(F.col("z").cast("long").alias("z"), "gtype").agg(F.count(F.lit(1)).alias("n"), F.bool_and(close).alias("own"))
