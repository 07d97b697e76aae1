"""Features: clipping and simplification in Arrow batches, relation assembly by group, feature packs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import shapes
from geoloom.operators.tiles import PARTS, as_rows, part_arrays, with_parts


def clipped(features: DataFrame, box: shapes.Box, fraction: float = 0.0) -> DataFrame:
    """The features' geometry (gtype, parts) inside a box; features without any are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shapes.clip_parts(k, p, box, fraction) for k, p in zip(batch.column("gtype").to_pylist(), part_arrays(batch.column("parts")), strict=True)]
            yield with_parts(batch.filter(pa.array([p is not None for p in found], pa.bool_())), [p for p in found if p is not None])

    return features.mapInArrow(run, features.schema)


def simplified(features: DataFrame, tolerance: float, holes: bool = True) -> DataFrame:
    """The features' geometry with a tolerance in degrees; ``holes=False`` keeps outer rings only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_parts(batch, [shapes.simplify_parts(k, p, tolerance, holes) for k, p in zip(batch.column("gtype").to_pylist(), part_arrays(batch.column("parts")), strict=True)])

    return features.mapInArrow(run, features.schema)


REPORT = f"rel_id long, gtype string, parts {PARTS}, polygons int, holes int, matched int, orphaned int, open_rings int, degenerate int, error string"


def _assembled(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["role_order", "ordinal"], kind="stable")
    lines = [(role, np.array([(p["x"], p["y"]) for p in points], dtype=np.float64).reshape(-1, 2)) for role, points in zip(group["role"], group["points"], strict=True)]
    done = shapes.assemble([p for role, p in lines if role in ("outer", "")], [p for role, p in lines if role == "inner"])
    row = {
        "rel_id": int(group["rel_id"].iloc[0]), "gtype": "polygon" if done.polygons else None, "parts": as_rows(done.polygons) or None, "polygons": len(done.polygons), "holes": sum(len(p) - 1 for p in done.polygons),
        "matched": done.matched, "orphaned": done.orphaned, "open_rings": done.open_rings, "degenerate": done.degenerate, "error": done.error,
    }
    return pd.DataFrame([row])


def assembled(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Polygons and report of every relation: members (rel_id, way_id, role, ordinal) and way lines (way_id, points).

    Only ways that are members are moved; a relation is one group.
    """
    m = members.filter(F.col("role").isin("outer", "", "inner")).withColumn("role_order", (F.col("role") == "inner").cast("int"))
    rows = m.join(lines.select("way_id", "points"), "way_id")
    return rows.groupBy("rel_id").applyInPandas(_assembled, REPORT)


def write_pack(features: DataFrame, path: str) -> None:
    """A feature pack: processed features with resolved tags, as one dataset."""
    features.write.mode("overwrite").parquet(path)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
