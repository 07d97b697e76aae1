import gzip
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions.tilecodec import varint, zigzag
from geoloom.operators import compact, extract, tiles
from geoloom.plugins import App, Plugin, Sources
from geoloom.sources import changes, files
from geoloom.streaming import replication


def msg(number, payload):
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def num(number, value):
    return varint(number << 3) + varint(value)


def packed(values, delta=False, zig=False):
    if delta:
        values = np.diff([0, *values]).tolist()
    return b"".join(varint(zigzag(v) if zig else v) for v in values)


def blob(kind, data):
    body = num(2, len(data)) + msg(3, zlib.compress(data))
    head = msg(1, kind.encode()) + num(3, len(body))
    return struct.pack(">I", len(head)) + head + body


@pytest.fixture(scope="module")
def extract_file(tmp_path_factory):
    strings = ["", "name", "A", "highway", "primary", "type", "multipolygon", "outer"]
    table = msg(1, b"".join(msg(1, s.encode()) for s in strings))
    dense = msg(1, packed([1, 2, 3], True, True)) + msg(8, packed([100_000_000, 200_000_000, -100_000_000], True, True)) + msg(9, packed([0, 10, 20], True, True)) + msg(10, packed([1, 2, 0, 0, 0]))
    way = num(1, 50) + msg(2, packed([3])) + msg(3, packed([4])) + msg(8, packed([1, 2, 3, 99], True, True))
    relation = num(1, 70) + msg(2, packed([5])) + msg(3, packed([6])) + msg(8, packed([7])) + msg(9, packed([50], True, True)) + msg(10, packed([1]))
    block = lambda group: blob("OSMData", table + msg(2, group))
    path = tmp_path_factory.mktemp("pbf") / "x.osm.pbf"
    path.write_bytes(blob("OSMHeader", msg(4, b"OsmSchema-V0.6")) + block(msg(2, dense)) + block(msg(3, way)) + block(msg(4, relation)))
    return str(path)


def test_pbf_source(spark, extract_file):
    App(spark).add(Sources())
    sets = []
    for step in ("7", "100", "33554432"):
        df = spark.read.format("osm_pbf").option("partitionBytes", step).load(extract_file)
        sets.append(sorted(map(str, df.collect())))
    assert sets[0] == sets[1] == sets[2] and spark.read.format("osm_pbf").load(f"file://{extract_file}").count() == 5
    rows = {(r["osm_type"], r["id"]): r for r in df.collect()}
    assert set(rows) == {("node", 1), ("node", 2), ("node", 3), ("way", 50), ("relation", 70)}
    assert rows["node", 1]["tags"] == {"name": "A"} and rows["node", 2]["tags"] == {} and round(rows["node", 3]["lat"], 7) == -10.0
    assert rows["way", 50]["refs"] == [1, 2, 3, 99] and tuple(rows["relation", 70]["members"][0]) == ("way", 50, "outer")
    assert spark.read.format("osm_pbf").option("elements", "way").load(extract_file).count() == 1


DIFF = b"""<?xml version="1.0"?><osmChange version="0.6">
<create><node id="1" version="1" lat="10.5" lon="20.5"/></create>
<modify><node id="2" version="3" lat="1" lon="2"><tag k="name" v="Fish &amp; Chips"/><tag k="amenity" v="cafe"/></node>
<way id="5"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way><relation id="9"><member type="way" ref="5" role="outer"/></relation></modify>
<delete><node id="3" version="2" visible="false"/></delete></osmChange>"""


def test_diff_parser():
    rows = changes.parse(gzip.compress(DIFF))
    assert [(r["action"], r["osm_type"], r["id"]) for r in rows] == [("create", "node", 1), ("modify", "node", 2), ("modify", "way", 5), ("modify", "relation", 9), ("delete", "node", 3)]
    assert rows[1]["tags"]["name"] == "Fish & Chips" and rows[2]["node_refs"] == [1, 2] and not rows[4]["visible"] and rows[4]["lon"] == 0.0
    for bad in (b'<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><osmChange/>', b'<!DOCTYPE x [<!ENTITY a "aa">]><osmChange>&a;</osmChange>'):
        with pytest.raises(ValueError, match="DTD"):
            changes.parse(bad)


def test_changes_batch_stream_and_state(spark, tmp_path):
    for n, data in ((1, DIFF), (2, DIFF.replace(b"20.5", b"21.5"))):
        d = tmp_path / "feed" / "000" / "000"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{n:03d}.osc.gz").write_bytes(gzip.compress(data))
    feed = str(tmp_path / "feed")
    batch = changes.read(spark, feed)
    assert sorted((r["sequence"], r["ordinal"]) for r in batch.collect()) == [(s, o) for s in (1, 2) for o in range(5)]
    App(spark).add(Sources())
    run = spark.readStream.format("osm_changes").option("startSequence", "1").load(feed).writeStream.format("memory").queryName("feed_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert {r["sequence"] for r in spark.table("feed_rows").collect()} == {2} and spark.table("feed_rows").count() == 5
    nodes = spark.createDataFrame([(1, 20.5, 10.5), (2, 2.0, 1.0)], "id long, lon double, lat double")
    boxed = replication.boxed_changes(batch, nodes)
    counts = replication.counters(boxed).first()
    assert tuple(counts) == (0, 4, 2, 4)  # node 1 has no tags, relations have no place
    assert replication.counters(replication.boxed_changes(batch)).first()["skipped"] == 6  # without nodes no way has a place
    assert replication.store_after(boxed).count() == 2
    assert replication.dirty_tiles(replication.stale_boxes(boxed), 0, 3).count() >= 4
    s = changes.ReplicationState(999, "t", "https://x/")
    s.save(str(tmp_path / "s.json"))
    assert changes.ReplicationState.load(str(tmp_path / "s.json")).next_url() == "https://x/000/001/000.osc.gz" and s.advanced().sequence == 1000


def test_geojson(spark, tmp_path):
    f = lambda g, p=None, i=None: {"type": "Feature", "id": i, "geometry": g, "properties": p}
    shape = lambda t, c: {"type": t, "coordinates": c}
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        f(shape("Point", [1, 2]), {"amenity": "cafe", "n": 3, "ok": True, "list": [1], "none": None}, 77), f(shape("LineString", [[0, 0], [1, 1]]), {"highway": "path"}), f(shape("LineString", [[0, 0]]), {}), f(shape("Polygon", [ring, [[1, 1], [2, 1]]]), {"building": "yes"}),
        f(shape("MultiPolygon", [[ring], [[[0, 0]]]]), {"landuse": "farm"}), f(None, {"amenity": "bar"}), f(shape("MultiPoint", [[1, 1]]), {}),
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    rows = files.boxed(files.geojson(spark, str(tmp_path / "a.geojson"))).collect()
    assert sorted((r["layer"], r["class"], r["gtype"], len(r["parts"])) for r in rows) == [("amenity", "cafe", "point", 1), ("building", "yes", "polygon", 1), ("highway", "path", "line", 1), ("landuse", "farmland", "polygon", 1)]
    cafe = next(r for r in rows if r["layer"] == "amenity")
    assert cafe["id"] == 77 and cafe["tags"] == {"amenity": "cafe", "n": "3", "ok": "true"} and (cafe["min_lon"], cafe["max_lat"]) == (1, 2)
    (tmp_path / "b.geojson").write_text('{"type":"Topology"}')
    with pytest.raises(Exception, match="neither"):
        files.geojson(spark, str(tmp_path / "b.geojson")).collect()


def test_elevation_and_contours(spark, tmp_path):
    y, x = np.mgrid[0:101, 0:101]
    g = (3000 - np.hypot(x - 50, y - 50) * 10).astype(">i2")
    g[0, 0] = -9999
    (tmp_path / "N40W112.hgt").write_bytes(g.tobytes())
    grids = files.elevation(spark, str(tmp_path)).cache()
    r = grids.first()
    assert (r["south"], r["west"], r["side"], r["low"], r["high"]) == (40, -112, 101, 0, 3000)
    lines = files.contour_features(grids, (-111.8, 40.2, -111.2, 40.8), 100).collect()
    assert {q["metres"] % 100 for q in lines} == {0} and {q["class"] for q in lines} == {"major"} and all(q["id"] < 0 for q in lines)
    ring = next(q for q in lines if q["metres"] == 2900)["parts"][0][0]
    assert all(abs(np.hypot(p["x"] + 111.5, p["y"] - 40.5) - 0.1) < 0.01 for p in ring)


def test_regions(spark, tmp_path):
    g = lambda n: {"type": "MultiPolygon", "coordinates": [[[[0, 0], [n, 0], [n, n]]]]}
    e = lambda i, n, url="u": {"properties": {"id": i, "name": i, "urls": {"pbf": url} if url else {}}, "geometry": g(n) if n else None}
    (tmp_path / "r.json").write_text(json.dumps({"features": [e("big", 20), e("small", 10), e("none", 5, None), e("nowhere", 0), e("twin", 10)]}))
    r = files.regions(spark, str(tmp_path / "r.json"))
    assert {x["id"] for x in r.collect()} == {"big", "small", "twin"}
    assert files.region_at(r, 5, 5).first()["id"] == "small" and files.region_at(r, 15, 15).first()["id"] == "big" and files.region_at(r, 50, 5).count() == 0


def test_packed_points_round_trip():
    rng = np.random.default_rng(0)
    for points in ([[10, 20], [12, 22], [14, 24]], [[50, 100], [53, 98], [55, 95], [52, 97]], *(rng.integers(0, 60, (n, 2)).tolist() for n in (2, 9, 100))):
        p = np.array(points)
        data = compact.pack_points(p)
        back, size = compact.unpack_points(data)
        assert size == len(data) and (back == p).all()
    assert compact.pack_points(np.array([[10, 20], [12, 22], [14, 24]]))[3] == (1 | 1 << 3 | 0x40 | 0x80)
    assert compact.pack_points(np.array([[1, 1]])) is None


def test_area_blob(spark, tmp_path):
    box = (-111.80, 40.60, -111.75, 40.65)
    at = lambda *p: [[np.array(p, dtype=float)]]
    base = {"shown": True, "poi": False, "labelled": True, "category": 0, "subcategory": 0, "poi_type": 15, "area": False, "elevation": 0, "name": "North Trail", "short_name": "N Trl"}
    path = base | {"gtype": "line", "parts": at((-111.79, 40.61), (-111.78, 40.63), (-111.76, 40.64))}
    peak = base | {"poi": True, "gtype": "point", "parts": at((-111.77, 40.62)), "poi_type": 0, "elevation": 3266}
    got = compact.read_blob(compact.build_blob([path, path, peak, peak, peak | {"poi_type": 2}, peak | {"name": ""}, path | {"parts": at((0, 0), (1, 1))}], box))
    assert (got["header"]["features"], got["header"]["pois"], got["header"]["labels"]) == (2, 2, 1)
    assert got["pois"][0][3:] == (3266, "North Trail") and got["labels"][0][4] == "N Trl" and got["header"]["min_lon"] == -111_800_000
    assert len(compact.build_blob([path] * 50, box)) < 5000 and compact.read_header(b"nope") is None
    cells = [{"cx": x, "cy": y, "blob": bytes([x, y])} for x, y in ((3, 1), (1, 2), (2, 1))]
    data = compact.bundle(cells, (0, 0, 1, 1), 0.05, 7)
    assert compact.bundle_cells(data).blob.tolist() == [b"\x02\x01", b"\x03\x01", b"\x01\x02"]
    (tmp_path / "a.bundle").write_bytes(data)
    (tmp_path / "b.bundle").write_bytes(b"something else")
    assert [r["tiles"] for r in files.bundles(spark, str(tmp_path)).collect()] == [3]


def test_dedup_cases(spark):
    e = lambda i, name, lon, lat, phone="": ("node", i, name, "", phone, "", "", "", {}, lon, lat)
    run = lambda *rows: sorted(r["osm_id"] for r in extract.deduplicated(spark.createDataFrame(list(rows), extract.ENTITY)).collect())
    assert run(e(1, "Acme Corp", -80.2, 25.7), e(2, "ACME corp", -80.2, 25.7, "555-1234")) == [2]
    assert run(e(1, "Acme", -80.2, 25.7), e(2, "Acme", -74.0, 40.7)) == [1, 2]
    assert run(e(1, "Acme", None, None), e(2, "Acme", None, None), e(3, "Acme", 1.0, 1.0)) == [1, 3]
    assert run(e(1, "Acme", 1.0, 1.0), e(2, "Globex Corp", 1.0, 1.0)) == [1, 2]


def test_entity_sinks(spark, tmp_path):
    el = spark.createDataFrame([("node", 1, {"name": 'A "x", y', "addr:city": "P", "phone": "1"}, 2.0, 1.0), ("way", 2, {"name": "B"}, None, None), ("node", 3, {"shop": "x"}, 0.0, 0.0)], "osm_type string, osm_id long, tags map<string,string>, lon double, lat double")
    found = extract.entities(el)
    assert extract.entities(el, box=(0, 0, 5, 5)).count() == 1 and tuple(extract.counters(el).first()) == (2, 1, 0)
    lines = sorted(r["value"] for r in extract.csv_lines(found).collect())
    assert lines == ['"A ""x"", y",P,1,,,1.000000,2.000000,,node', "B,,,,,,,,way"]
    shapes = [json.loads(r["value"]) for r in extract.geojson_rows(found).collect()]
    assert sorted(s["geometry"] is None for s in shapes) == [False, True] and next(s for s in shapes if s["geometry"])["properties"]["addr_city"] == "P"
    plain = [json.loads(r["value"]) for r in extract.json_rows(found).collect()]
    assert {p["name"]: (p["lat"], p.get("addr_city")) for p in plain} == {'A "x", y': (1.0, "P"), "B": (None, None)}
    extract.write(found, str(tmp_path / "out.csv"))
    assert spark.read.text(str(tmp_path / "out.csv")).count() == 3


def test_tile_table_and_archive(spark, small, tmp_path):
    from geoloom.plans.feature_queries import tile_points

    made = tiles.generate(tile_points(spark, small), 13, 14).cache()
    tiles.write_table(made, str(tmp_path / "t"))
    r = made.first()
    assert tiles.lookup(spark, str(tmp_path / "t"), r["z"], r["x"], r["y"]) == (200, bytes(r["data"]))
    assert tiles.lookup(spark, str(tmp_path / "t"), 3, 0, 0)[0] == 204 and tiles.lookup(spark, str(tmp_path / "t"), 3, 8, 0)[0] == 400
    n = tiles.write_archive(made, str(tmp_path / "a.pmtiles"), (-180.0, -80.0, 180.0, 80.0), 13, 14)
    head = (tmp_path / "a.pmtiles").read_bytes()[:127]
    assert n == made.count() and head[:8] == b"PMTiles\x03" and struct.unpack("<Q", head[72:80])[0] == n
    assert [tiles.hilbert_id(1, x, y) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]
    view = tiles.in_view(spark.read.parquet(str(tmp_path / "t")), -180.0, -80.0, 180.0, 80.0, 14)
    assert view.count() == made.filter(F.col("z") == 14).count()


def test_plugins(spark):
    seen = []

    class Late(Plugin):
        name = "late"

        def ready(self, spark):
            return False

    class Once(Plugin):
        name = "once"

        def build(self, spark):
            seen.append("build")

        def cleanup(self, spark):
            seen.append("cleanup")

    app = App(spark).add(Once(), [Once()])
    app.start().stop()
    assert seen == ["build", "cleanup"]
    with pytest.raises(RuntimeError, match="late"):
        App(spark).add(Late()).start()
    app.put(5)
    app.on(str, seen.append)
    app.emit("event")
    assert app.get(int) == 5 and seen[-1] == "event"


@pytest.mark.parametrize(("n", "leaves"), [(3, False), (100_000, True)])
def test_archive_of_any_size_can_be_read_by_range(spark, tmp_path, n, leaves):
    z = 9
    rows = spark.range(n).select(F.lit(z).alias("z"), (F.col("id") % 512).cast("int").alias("x"), F.floor(F.col("id") / 512).cast("int").alias("y"), F.encode(F.concat(F.lit("tile "), F.col("id").cast("string"), F.lit(" "), F.substring(F.sha2(F.col("id").cast("string"), 512), 1, 100) if leaves else F.lit("")), "UTF-8").alias("data"))
    if leaves:  # lengths that do not compress
        rows = rows.withColumn("data", F.substring("data", 1, (20 + F.abs(F.xxhash64("x", "y")) % 90).cast("int")))
    path = str(tmp_path / "a.pmtiles")
    assert tiles.write_archive(rows, path, (-180.0, -85.0, 180.0, 85.0), z, z) == n
    archive = tiles.Archive(path)
    assert archive.tiles == n and (archive.root_size + tiles.HEADER_BYTES <= tiles.FIRST_FETCH)
    head = open(path, "rb").read(tiles.HEADER_BYTES)
    assert (struct.unpack("<Q", head[48:56])[0] > 0) == leaves
    for i in (0, n // 2, n - 1):
        assert archive.tile(z, i % 512, i // 512).startswith(f"tile {i} ".encode())
    assert archive.tile(z, 511, 511) is None and archive.tile(3, 0, 0) is None
    got = archive.in_range(spark, z, 0, 0, 2, 1).collect()
    assert {(r["x"], r["y"]): bytes(r["data"]).split()[:2] for r in got} == {(i % 512, i // 512): [b"tile", str(i).encode()] for i in range(n) if i % 512 <= 2 and i // 512 <= 1}
    seen = archive.in_view(spark, -180.0, 84.0, -179.0, 85.0, z).count()
    lat = math.radians(84.0)
    south = int((1 - math.log(math.tan(lat) + 1 / math.cos(lat)) / math.pi) / 2 * 512)
    assert seen == len([1 for i in range(n) if i % 512 <= 1 and i // 512 <= south])


def test_places_along_the_curve():
    for z in (0, 1, 5):
        assert sorted(tiles.hilbert_id(z, x, y) for x in range(2**z) for y in range(2**z)) == list(range((4**z - 1) // 3, (4 ** (z + 1) - 1) // 3))
        assert all(tiles.hilbert_place(tiles.hilbert_id(z, x, y)) == (z, x, y) for x in range(2**z) for y in range(2**z))


def test_features_with_one_id_keep_their_own_geometry(spark):
    point = "array(array(array(named_struct('x', 10.0D, 'y', 10.0D))))"
    line = "array(array(array(named_struct('x', 10.0D, 'y', 10.0D), named_struct('x', 12.0D, 'y', 11.0D))))"
    box = "10.0D as min_lon, 10.0D as min_lat, {0} as max_lon, {1} as max_lat"
    rows = spark.sql(f"select 5L as id, 'place' as layer, 'city' as class, 'point' as gtype, {point} as parts, map('name', 'A') as tags, {box.format('10.0D', '10.0D')}, 0L as ordinal union all select 5L, 'highway', 'motorway', 'line', {line}, map('name', 'B'), {box.format('12.0D', '11.0D')}, 1L")
    back = tiles.decode(tiles.generate(rows, 4, 6)).collect()
    assert {(r["gtype"], r["name"], len(r["parts"][0][0]) >= 2) for r in back} == {("point", "A", False), ("line", "B", True)}
    assert len({(r["z"], r["x"], r["y"], r["gtype"]) for r in back}) == len(back)


def test_long_lines_become_several_records():
    rng = np.random.default_rng(0)
    pixels = np.column_stack([np.arange(1000) % 176, rng.integers(0, 176, 1000)])
    back = []
    for record in compact.line_records(pixels):
        points, size = compact.unpack_points(record)
        assert size == len(record)
        back += points.tolist()[1 if back else 0 :]
    assert back == pixels.tolist()
    assert list(compact.line_records(pixels[:1])) == []


def test_tile_hooks(spark, tmp_path):
    rows = spark.sql("select 1L as id, 'place' as layer, 'city' as class, 'point' as gtype, array(array(array(named_struct('x', 10.0D, 'y', 10.0D)))) as parts, map('name', 'A') as tags, 10.0D as min_lon, 10.0D as min_lat, 10.0D as max_lon, 10.0D as max_lat, 0L as ordinal")
    made = tiles.generate(rows, 4, 5, encode=lambda layers, extent: json.dumps([extent, *layers]).encode())
    assert {bytes(r["data"]) for r in made.collect()} == {b'[4096, "place"]'}
    out = str(tmp_path)

    def write(z, x, y, data):
        with open(f"{out}/{z}-{x}-{y}", "wb") as f:
            f.write(data)

    tiles.each(made, write)
    assert len(list(tmp_path.iterdir())) == made.count()


def test_following_a_feed(spark, tmp_path):
    from geoloom.plans import commands

    feed = tmp_path / "feed" / "000" / "000"
    feed.mkdir(parents=True)
    node = lambda action, lon: f'<osmChange><{action}><node id="7" version="1" lon="{lon}" lat="1"><tag k="amenity" v="cafe"/></node></{action}></osmChange>'
    for n, text in ((1, node("create", 10)), (2, node("modify", 60)), (4, node("delete", 60))):
        (feed / f"00{n}.osc").write_text(text)
    state, work = str(tmp_path / "state.json"), str(tmp_path / "work")
    changes.ReplicationState(0, "t", "https://d.example").save(state)
    assert commands.follow(spark, str(tmp_path / "feed"), state, work, 0, 3) == 2  # the third diff is missing
    assert changes.ReplicationState.load(state).sequence == 2
    assert [r["min_lon"] for r in spark.read.parquet(f"{work}/store/2").collect()] == [60.0]
    assert spark.read.parquet(f"{work}/dirty/2").filter("z = 3").count() == 2  # where it was and where it is
    (feed / "003.osc").write_text("<osmChange/>")
    assert commands.follow(spark, str(tmp_path / "feed"), state, work, 0, 3) == 2
    assert spark.read.parquet(f"{work}/store/4").count() == 0
