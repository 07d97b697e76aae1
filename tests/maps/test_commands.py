import json

import pytest

from geoloom.operators import compact, inspection
from geoloom.plans import commands
from geoloom.sources import changes, files
from tests.maps.test_sources import DIFF, blob, msg, num, packed


@pytest.fixture(scope="module")
def town(tmp_path_factory):
    """A square way with a hole as a relation, a road, a named point."""
    strings = ["", "name", "Peak One", "natural", "peak", "highway", "path", "type", "multipolygon", "landuse", "forest", "outer", "inner", "Long Trail", "ele", "3266"]
    table = msg(1, b"".join(msg(1, s.encode()) for s in strings))
    corner = [(0, 0), (10, 0), (10, 10), (0, 10), (2, 2), (4, 2), (4, 4), (2, 4), (5, 5)]
    dense = msg(1, packed(range(1, 10), True, True)) + msg(8, packed([y * 100_000 for _, y in corner], True, True)) + msg(9, packed([x * 100_000 for x, _ in corner], True, True)) + msg(10, packed([0] * 8 + [1, 2, 3, 4, 14, 15, 0]))
    way = lambda i, tags, refs: msg(3, num(1, i) + msg(2, packed(tags[::2])) + msg(3, packed(tags[1::2])) + msg(8, packed(refs, True, True)))
    relation = num(1, 70) + msg(2, packed([7, 9])) + msg(3, packed([8, 10])) + msg(8, packed([11, 12])) + msg(9, packed([50, 51], True, True)) + msg(10, packed([1, 1]))
    groups = [msg(2, dense), way(50, [], [1, 2, 3, 4, 1]) + way(51, [], [5, 6, 7, 8, 5]) + way(52, [5, 6, 1, 13], [1, 9, 3, 99]), msg(4, relation)]
    path = tmp_path_factory.mktemp("town") / "t.osm.pbf"
    path.write_bytes(blob("OSMHeader", b"") + b"".join(blob("OSMData", table + msg(2, g)) for g in groups))
    return str(path)


def test_load_and_inspect(spark, town):
    f = {(r["osm_type"], r["id"]): r for r in commands.build_features(commands.elements(spark, town)).collect()}
    assert {k: (r["layer"], r["class"], r["gtype"]) for k, r in f.items()} == {("node", 9): ("natural", "peak", "point"), ("way", 52): ("highway", "path", "line"), ("relation", 70): ("landuse", "forest", "polygon")}
    assert [len(ring) for ring in f["relation", 70]["parts"][0]] == [5, 5] and len(f["way", 52]["parts"][0][0]) == 3
    seen = commands.inspect(spark, town)
    assert seen["counters"] == {"nodes": 9, "ways": 3, "relations": 1, "features": 3} and seen["layers"] == {"highway": 1, "landuse": 1, "natural": 1}
    assert seen["box"] == pytest.approx((0, 0, 0.1, 0.1)) and seen["strings"] >= 50


def test_tiles_extract_and_blob(spark, town, tmp_path):
    t = commands.generate_tiles(spark, town, str(tmp_path / "tiles"), "7-8", exclude="name=Nobody")
    assert t.filter("z = 7").count() >= 1
    found = commands.extract_entities(spark, town, str(tmp_path / "e.geojson"))
    assert sorted(r["name"] for r in found.collect()) == ["Long Trail", "Peak One"]
    assert spark.read.text(str(tmp_path / "e.geojson")).count() == 2
    f = commands.build_features(commands.elements(spark, town)).cache()
    data = compact.read_blob(commands.compact_area(f, (-0.01, -0.01, 0.11, 0.11)))
    assert data["pois"][0][3:] == (3266, "Peak One") and data["labels"][0][4] == "Long Trl" and data["header"]["features"] == 1
    assert commands.region_bundle(f, (0.0, 0.0, 0.1, 0.1), str(tmp_path / "b.bundle")) >= 1
    (tmp_path / "r.json").write_text(json.dumps({"features": [{"properties": {"id": "r", "urls": {"pbf": "u"}}, "geometry": {"coordinates": [[0, 0], [1, 1]]}}]}))
    key, blob_ = commands.area_at(f, files.regions(spark, str(tmp_path / "r.json")), 0.051, 0.049)
    assert key == "0.00_0.05" and compact.read_header(blob_)["min_lon"] == 50_000
    assert commands.area_at(f, files.regions(spark, str(tmp_path / "r.json")), 50.0, 50.0) is None


def test_update(spark, tmp_path):
    (tmp_path / "000000001.osc").write_bytes(DIFF)
    nodes = spark.createDataFrame([(1, 20.5, 10.5), (2, 2.0, 1.0)], "id long, lon double, lat double")
    dirty, store, counts = commands.update(spark, str(tmp_path), changes.ReplicationState(0, "", ""), None, nodes, 0, 4)
    assert dirty.count() > 0 and store.count() == 2 and counts.first()["modified"] == 2
    after = commands.update(spark, str(tmp_path), changes.ReplicationState(1, "", ""), store, nodes, 0, 4)
    assert after[0].count() == 0 and after[1].count() == 2


def test_arguments():
    assert inspection.parse_box("1,2,3,4") == (1, 2, 3, 4) and inspection.parse_zooms("3-7") == (3, 7) and inspection.parse_zooms("5") == (5, 5)
    for bad in ("1,2,3", "a,b,c,d", "3,2,1,4"):
        with pytest.raises(ValueError, match="not a box"):
            inspection.parse_box(bad)
