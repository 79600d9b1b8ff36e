"""Helpers shared by the operators: shared folders, written intermediates, Arrow stages."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bundlescan.session import ensure_checkpoint_dir, release, ship_package  # noqa: F401 - release: for the operators

#: Arrow batches of the Python stages: rows and bytes, whichever comes first.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and ship the package to the workers."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage is cut, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The POSIX path of a folder that tasks write plain files into. The shared folder must be
    mounted on every node (file: or a bare path); another scheme is refused, because files on a
    node's own disk would be lost to the others."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: plain files need a shared folder that is mounted on every node; "
                         "set spark.checkpoint.dir to such a mount")
    return unquote(url.path)


def write_file(path: str, parts: Iterator[bytes]) -> None:
    """Write a file under a name of this attempt's own, then rename: a task that runs again, or
    twice at once, leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for x in parts:
            out.write(x)
    os.replace(part, path)


def named(df: DataFrame, *wanted: str) -> DataFrame:
    """Only these columns; others, whatever their names, are left out."""
    return df.select(*(F.col(f"`{c}`") for c in wanted))


def with_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], schema: str,
                 keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and, from an Arrow stage, the columns of schema. A column
    of df with the name of a new one gives way to it. make: gets a batch with all of df's columns,
    returns the new columns."""
    new = T._parse_datatype_string(schema)
    held = [c for c in (df.columns if keep is None else keep) if c not in set(new.names)]
    out = T.StructType([df.schema[c] for c in held] + list(new.fields))
    names = out.names

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + make(batch), names)
        release()

    return df.mapInArrow(stage, out)
