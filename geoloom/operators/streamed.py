"""Groups as runs of a sorted partition: one group in memory at a time, and no call into Python per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that are handed back at once.
OUT_ROWS = 256


def rows_of(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch; ``parts``, where there are any, as arrays of vertices."""
    at = batch.schema.get_field_index("parts")
    if at < 0:
        return batch.to_pylist()
    from geoloom.operators.tiles import part_arrays

    rows = batch.drop_columns(["parts"]).to_pylist()
    for row, parts in zip(rows, part_arrays(batch.column(at)), strict=True):
        row["parts"] = parts
    return rows


def by_group(rows: DataFrame, keys: list[str], order: list[str], build: Callable[[list[dict]], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``build`` gets the rows of each group in order and returns rows of ``schema`` (``arrow`` is the same as Arrow types)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        key = None
        for batch in batches:
            for row in rows_of(batch):
                k = tuple(row[c] for c in keys)
                if k != key and held:
                    out += build(held)
                    held = []
                    if len(out) >= OUT_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                key = k
                held.append(row)
        if held:
            out += build(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType.fromDDL(schema))
