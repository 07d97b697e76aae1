"""Tables that cut lineage, kept in the folder that every node shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from geoloom.session import shared_dir


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Rows of an Arrow batch at most, as a row holds a whole text.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_owned: list[Scratch] = []


@atexit.register
def _clear() -> None:
    """Removes the folders of this process, as far as its session still runs."""
    for scratch in _owned:
        try:
            scratch.drop()
        except Exception:  # the session has ended
            return


class Scratch:
    """Parquet tables under one random folder of the shared directory.

    ``keep`` writes a frame and reads it back, so later stages restart from
    committed files when an executor is lost; ``drop`` frees the disk of a
    table whose readers have all been written themselves. What a query's lazy
    result still reads goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _owned.append(self)
        if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes a table, or the whole folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
