"""Every map query against its SQL on the smallest tables."""

import glob
import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from geoloom.operators import style
from geoloom.plans import feature_queries, small_queries  # noqa: F401
from geoloom.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(frame):
    f = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, f.where(f.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = entry.queries()[name](spark, small).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_diff_urls_of_large_keys(spark, tmp_path):
    con, path = duckdb.connect(), f"{tmp_path}/orders.parquet"
    con.execute(f"copy (select cast(k as bigint) as o_orderkey from (values (null), (0), (1003009), (1003010), (8999999), (1000000000), (9199999999999999)) t(k)) to '{path}' (format parquet)")
    con.execute(f"create view orders as select * from '{path}'")
    got = [tuple(r) for r in entry.queries()["diff_urls"](spark, str(tmp_path)).select("id", "url").collect()]
    assert sorted(got, key=str) == sorted(con.execute(ORACLE["diff_urls"]).fetchall(), key=str)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_simplified_lines_keep_their_ends(spark, small):
    got = QUERIES["simplify_invariants"](spark, small)
    assert got.filter("not ends_stay or not subset").count() == 0


def placed(labels, box, width, height):
    """Labels one after another on a grid, as the rule says."""
    west, south, east, north = box
    cols, rows = math.ceil(width / style.CELL_W) + 1, math.ceil(height / style.CELL_H) + 1
    free, out = {(i, j) for i in range(rows) for j in range(cols)}, []
    for i, name, size, widest, lon, lat, a, b, c, d in sorted(labels, key=lambda r: (-r[2], r[0])):
        if len(out) == style.MOST_LABELS or widest < east - west or a > east or c < west or b > north or d < south:
            continue
        px, py = (lon - west) / (east - west) * width, (north - lat) / (north - south) * height
        if px < -50 or px > width + 50 or py < -50 or py > height + 50:
            lon = min(max(lon, west + 0.1 * (east - west)), east - 0.1 * (east - west))
            lat = min(max(lat, south + 0.1 * (north - south)), north - 0.1 * (north - south))
            px, py = (lon - west) / (east - west) * width, (north - lat) / (north - south) * height
        w, h = len(name.encode()) * size * 0.55, size * 1.3
        ys = range(max(math.floor((py - h / 2) / style.CELL_H), 0), min(math.ceil((py - h / 2 + h) / style.CELL_H), rows - 1) + 1)
        xs = range(max(math.floor((px - w / 2) / style.CELL_W), 0), min(math.ceil((px - w / 2 + w) / style.CELL_W), cols - 1) + 1)
        own = {(y, x) for y in ys for x in xs}
        if own <= free:
            free -= own
            out.append((i, name, px, py, float(size)))
    return sorted(out)


@pytest.mark.parametrize("most, n", [(12, 400), (10**6, 3000)])
def test_labels_are_placed_as_one_after_another(spark, monkeypatch, most, n):
    monkeypatch.setattr(style, "MOST_LABELS", most)
    rng, box, rows = random.Random(n), (-20.0, -10.0, 20.0, 10.0), []
    for i in range(n):
        lon, lat, r = rng.choice([-21.3, 21.2, rng.uniform(-26, 26)]), rng.uniform(-14, 14), rng.choice([0.0, 0.1, 8.0])
        rows.append((i, "é" * rng.randrange(1, 12) + "x", rng.choice([9.0, 11.0, 14.0]), rng.choice([30.0, 360.0, 360.0]), lon, lat, lon - r, lat - r, lon + r, lat + r))
    frame = spark.createDataFrame(rows, "id long, name string, size double, widest double, lon double, lat double, min_lon double, min_lat double, max_lon double, max_lat double").repartition(4)
    got = style.place_labels(frame, box, 800, 400).drop("view").collect()
    want = placed(rows, box, 800, 400)
    assert len(want) == most or most > n
    assert sorted(map(tuple, got)) == want
    assert style.place_labels(frame.limit(0), box, 800, 400).count() == 0
