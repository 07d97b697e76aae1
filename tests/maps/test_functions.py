import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import shapes, tilecodec, vocab
from geoloom.functions import tags as T
from geoloom.functions import text as X


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def tagged(**tags):
    return F.create_map(*(F.lit(x) for kv in tags.items() for x in kv)) if tags else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    ("tags", "want"),
    [
        ({"highway": "residential"}, ("highway", "residential")), ({"building": "house"}, ("building", "house")), ({"natural": "water"}, ("water", "lake")), ({"waterway": "river"}, ("water", "river")), ({"water": "lake"}, ("water", "lake")),
        ({"name": "x", "maxspeed": "50"}, (None, None)), ({}, (None, None)), ({"highway": "primary", "building": "yes"}, ("highway", "primary")), ({"waterway": "river", "water": "lake"}, ("water", "river")), ({"shop": "unheard"}, ("shop", "other")), ({"emergency": "fire_hydrant"}, ("emergency", "fire_station")), ({"landuse": "farm"}, ("landuse", "farmland")),
    ],
)
def test_classify(spark, tags, want):
    assert one(spark, *T.classify(tagged(**tags))) == want


def test_classify_with_layers(spark):
    assert one(spark, *T.classify(tagged(natural="water"), ("natural",))) == ("water", "lake")
    assert one(spark, *T.classify(tagged(highway="primary", building="yes"), ("building",))) == ("building", "yes")
    assert T.parse_layers("amenity, shop,tourism") == ("amenity", "shop", "tourism") and T.parse_layers("all") == vocab.LAYERS
    with pytest.raises(ValueError, match="bogus"):
        T.parse_layers("amenity,bogus")


def test_first_of_repeated_keys_wins(spark):
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))))
    assert one(spark, T.tag_map(entries))[0] == {"a": "1", "b": "2"}


@pytest.mark.parametrize(("text", "want"), [("office=property_management", True), ("shop=*", True), ("brand", True), ("access=public", False), ("nothing shop=tyres", True), ("", True)])
def test_tag_filter(spark, text, want):
    t = tagged(office="property_management", name="Acme", shop="tyres", brand="McDonalds", access="private")
    assert one(spark, T.TagFilter.parse(text)(t), T.TagFilter.parse(text).negated()(t)) == (want, not want)


def test_filter_identities(spark):
    t = tagged(shop="tyres", access="private")
    assert one(spark, T.TagFilter.all_of()(t), T.TagFilter.any_of()(t), T.include_exclude(t, "shop", "access=private"), T.include_exclude(t, " ", "")) == (True, False, False, True)


def test_address(spark):
    full = tagged(**{"addr:housenumber": "39", "addr:street": "East Southern Avenue", "addr:city": "Phoenix", "addr:state": "AZ", "addr:postcode": "85040", "addr:street:name": "x", "addr:": "y", "addr:unit": ""})
    assert one(spark, T.address(full))[0] == "39 East Southern Avenue, Phoenix, AZ, 85040"
    assert one(spark, T.address(tagged(**{"addr:housenumber": "39", "addr:city": "P"})))[0] == "P"
    assert set(one(spark, T.address_parts(full))[0]) == {"addr_housenumber", "addr_street", "addr_city", "addr_state", "addr_postcode", "addr_street_name"}
    assert one(spark, T.phone(tagged(phone="", **{"contact:phone": "1"})), T.website(tagged(url="u"))) == ("1", "u")


@pytest.mark.parametrize(("text", "want"), [("3266", 3266), ("3266.5", 3267), ("3266 m", 3266), ("10700 ft", 3261), ("", None), ("approx 3000", None), ("3000 furlongs", None), ("-5", 0), ("3,266", None), ("99999", 65535)])
def test_elevation(spark, text, want):
    assert one(spark, X.elevation(F.lit(text)))[0] == want


@pytest.mark.parametrize(("text", "want"), [("#f00", (1, 0, 0, 1)), ("80f0", (136 / 255, 0, 1, 0)), ("#ff0000", (1, 0, 0, 1)), ("#12345", None), ("#gg0000", None)])
def test_colours(spark, text, want):
    got = one(spark, X.hex_colour(F.lit(text)))[0]
    assert got is None if want is None else np.allclose(tuple(got), want, atol=1e-6)


def test_tile_edges(spark):
    z = F.lit(9)
    at = lambda lon, lat: one(spark, G.tile_x(F.lit(lon), z), G.tile_y(F.lit(lat), z))
    assert at(-180.0, 90.0) == (0, 0) and at(180.0, -90.0) == (511, 511) and at(-999.0, 0.0) == (0, 256) and at(math.nan, 0.0)[0] == 0
    for x, y, zoom in [(0, 0, 0), (0, 0, 1), (1, 1, 1), (3, 5, 4), (100, 200, 9)]:
        b = one(spark, *G.tile_box(F.lit(x), F.lit(y), zoom).values())
        mid = one(spark, G.tile_x(F.lit((b[0] + b[2]) / 2), zoom), G.tile_y(F.lit((b[1] + b[3]) / 2), zoom))
        assert mid == (x, y)
        assert one(spark, *G.tile_of_key(G.tile_key(F.lit(x), F.lit(y), F.lit(zoom)))) == (x, y, zoom)
    with pytest.raises(Exception, match="below zoom 22"):
        one(spark, G.tile_children(F.lit(0), F.lit(0), F.lit(22)))


def test_boxes_rings_pixels(spark):
    box = lambda *v: dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), map(F.lit, v), strict=True))
    assert one(spark, G.boxes_meet(box(0.0, 0.0, 5.0, 5.0), box(3.0, 3.0, 8.0, 8.0)), G.boxes_meet(box(0.0, 0.0, 5.0, 5.0), box(6.0, 0.0, 10.0, 5.0)), G.in_box(F.lit(10.0), F.lit(0.0), 0.0, 0.0, 10.0, 10.0)) == (True, False, True)
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))))
    assert one(spark, G.twice_area(ring), G.twice_area(G.wound(ring)), G.twice_area(G.wound(ring, False))) == (-2.0, 2.0, -2.0)
    assert one(spark, G.pixel_x(F.lit(5.0), F.lit(5.0), F.lit(5.0), 176), G.pixel_y(F.lit(9.0), F.lit(0.0), F.lit(1.0), 176)) == (0, 0)
    assert one(spark, G.elevation_file(F.lit(40.6), F.lit(-111.8)), G.elevation_file(F.lit(-0.5), F.lit(0.5))) == ("N40W112.hgt", "S01E000.hgt")


def test_chunks_and_numbers(spark):
    blob = F.lit(bytearray(range(10)))
    assert bytes(one(spark, X.chunk(blob, F.lit(2), 4))[0]) == b"\x08\x09" and one(spark, X.chunk_count(blob, 4))[0] == 3
    with pytest.raises(Exception, match="out of range"):
        one(spark, X.chunk(blob, F.lit(3), 4))
    assert one(spark, X.big_endian_int(F.lit(bytearray(b"\xff\xff\xff\xfe")), 0))[0] == -2
    assert one(spark, X.next_diff_url(F.lit("https://x/"), F.lit(1234567)))[0] == "https://x/001/234/568.osc.gz"


def test_diff_urls_of_long_and_missing_numbers(spark):
    url = lambda n: X.next_diff_url(F.lit("https://x/"), F.lit(n).cast("long"))
    assert one(spark, url(999_999_999), url(9_172_399_999_999_999_002), url(None)) == ("https://x/1000/000/000.osc.gz", "https://x/9172399999999/999/003.osc.gz", None)


SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], dtype=float)


def test_clip():
    assert [len(p) for p in shapes.clip_line(np.array([[-0.5, -0.5], [0.5, 0.5]]), (-1, -1, 1, 1))] == [2]
    assert shapes.clip_line(np.array([[2.0, 2.0], [3.0, 3.0]]), (-1, -1, 1, 1)) == []
    cut = shapes.clip_ring(SQUARE, (5, 5, 20, 20))
    assert abs(shapes.twice_area(cut)) == 50 and (cut[0] == cut[-1]).all()
    assert shapes.clip_ring(SQUARE, (20, 20, 30, 30)) is None
    zigzag = np.array([[0, 5], [3, 5], [3, 20], [6, 20], [6, 5], [9, 5]], dtype=float)
    assert len(shapes.clip_line(zigzag, (0, 0, 10, 10))) == 2
    assert shapes.clip_parts("line", [[zigzag]], (0, 0, 10, 10))[0][0][-1].tolist() == [9, 5]


def test_simplify_and_levels():
    line = np.array([[0, 0], [1, 0.01], [2, -0.01], [3, 5], [4, 0]], dtype=float)
    assert shapes.simplify(line, 0.1).tolist() == [[0, 0], [2, -0.01], [3, 5], [4, 0]]
    assert shapes.levels(1850, 2350, 20)[0] == 1860 and len(shapes.levels(1850, 2350, 20)) == 25


def test_assembly():
    halves = [np.array([[0, 0], [1, 0], [1, 1]], dtype=float), np.array([[1, 1], [0, 1], [0, 0]], dtype=float)]
    done = shapes.assemble(halves, [])
    assert len(done.polygons) == 1 and len(done.polygons[0][0]) == 5 and shapes.twice_area(done.polygons[0][0]) == 2
    hole = np.array([[2, 2], [3, 2], [3, 3], [2, 3], [2, 2]], dtype=float)
    done = shapes.assemble([SQUARE[::-1]], [hole])
    assert (done.matched, done.orphaned) == (1, 0) and shapes.twice_area(done.polygons[0][0]) > 0 > shapes.twice_area(done.polygons[0][1])
    assert shapes.assemble([SQUARE], [hole + 100]).orphaned == 1
    assert len(shapes.assemble([SQUARE, SQUARE + 50], []).polygons) == 2
    assert shapes.assemble([], [hole]).error == "no outer rings"
    edges = [SQUARE[[2, 3]], SQUARE[[0, 1]], SQUARE[[3, 4]], SQUARE[[1, 2]]]
    assert len(shapes.assemble(edges, []).polygons) == 1
    assert shapes.assemble([SQUARE[:3]], []).open_rings == 1


def test_isolines_of_a_cone():
    y, x = np.mgrid[0:21, 0:21]
    grid = 100 - np.hypot(x - 10, y - 10) * 10
    lines = shapes.isolines(grid, 50)
    assert len(lines) == 1 and np.allclose(np.hypot(*(lines[0] - 10).T), 5, atol=0.15) and np.allclose(lines[0][0], lines[0][-1])


def test_tile_codec_round_trip():
    shape = [[SQUARE * 100 + 10, (SQUARE[::-1] * 20 + 300)], [SQUARE * 50 + 2000]]
    data = tilecodec.encode_tile({"water": [(7, "polygon", shape, {"class": "lake", "name": "L", "k": "v"})], "highway": [(-3, "line", [[np.array([[0.0, 0.0], [100.4, 50.5]])]], {"class": "path"})]})
    water, road = tilecodec.decode_tile(data, 3, 4, 2)
    assert (water["class"], water["name"], water["tags"], [len(p) for p in water["parts"]]) == ("lake", "L", {"k": "v"}, [2, 1]) and road["id"] == -3
    back = tilecodec.to_local(road["parts"][0][0], 3, 4, 2, 4096)
    assert np.allclose(back, [[0, 0], [100, 51]], atol=1e-6)
    assert tilecodec.encode_tile({"x": [(1, "line", [[np.zeros((2, 2))]], {})]}) is None
    assert [tilecodec.unzigzag(tilecodec.zigzag(n)) for n in (0, -1, 5, -(1 << 40))] == [0, -1, 5, -(1 << 40)]
