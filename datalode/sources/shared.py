"""Paths and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"  # one machine, one disk
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that a function of texts takes at once: as Python values they need several times their size.
SMALL = 500


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of SMALL rows; an empty batch stays one."""
    return (b.slice(a, SMALL) for b in batches for a in range(0, max(b.num_rows, 1), SMALL))


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that is written once and read as often as needed."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
