"""Raw directory trees -> the ``files(bundle_id, path, content)`` contract.

``binaryFile`` silently drops names beginning with ``.`` or ``_`` — and dotfiles are a finding
here — so trees have a data source of their own, ``filetree``. Each root is split into shards by the
hash of a file's path, so one root that holds nearly all files is read by many tasks; every task
walks the folders of its root, which is listing alone, and opens only its own files (links are not
followed, symlinked files skipped, only regular files read). No list of files goes through the
driver. As a stream, a batch holds the files that changed between two moments, by the time at which
the file system last changed their entry, so a file that is renamed into the tree counts as new; a
file younger than ``settle`` seconds waits for the next batch.

Options: ``roots``, a JSON object of bundle ids and folders; ``splits``, the shards of a root;
``settle``. Folders must be on a file system that every executor sees.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship_package
from .files import entries

SCHEMA = "bundle_id string, path string, content binary"
SPLITS = 16
_BATCH_BYTES = 8 << 20


@dataclass
class Shard(InputPartition):
    """Files of a root whose path's hash gives k modulo n, changed after low and up to high (ns)."""

    bundle: str
    root: str
    k: int
    n: int
    low: int | None = None
    high: int | None = None

    def paths(self) -> Iterator[tuple[str, str]]:
        """(path below the root, path) of the shard's files."""
        for folder, folders, names in os.walk(self.root, followlinks=False):
            folders.sort()
            for name in sorted(names):
                full = os.path.join(folder, name)
                path = os.path.relpath(full, self.root).replace(os.sep, "/")
                if zlib.crc32(os.fsencode(path)) % self.n != self.k or os.path.islink(full) or not os.path.isfile(full):
                    continue
                if self.high is not None and not self.low < os.stat(full).st_ctime_ns <= self.high:
                    continue
                yield path, full

    def batches(self) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, full in self.paths():
            try:
                with open(full, "rb") as fh:
                    held.append((path, fh.read()))
            except FileNotFoundError:
                continue  # taken away since it was listed
            size += len(held[-1][1])
            if size >= _BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.bundle] * len(rows)), pa.array([p for p, _ in rows]),
                                           pa.array([c for _, c in rows], pa.binary())], ["bundle_id", "path", "content"])


def _shards(options: dict, low: int | None = None, high: int | None = None) -> list[Shard]:
    n = int(options.get("splits", SPLITS))
    return [Shard(b, root, k, n, low, high) for b, root in sorted(json.loads(options["roots"]).items()) for k in range(n)]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Shard]:
        return _shards(self.options)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return partition.batches()


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(float(self.options.get("settle", 1)) * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return _shards(self.options, start["ns"], end["ns"])

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return partition.batches()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(dict(self.options))


def _options(spark: SparkSession, roots: dict[str, str], **more) -> dict[str, str]:
    ship_package(spark)
    spark.dataSource.register(TreeSource)
    return {"roots": json.dumps({b: os.path.abspath(r) for b, r in roots.items()})} | {k: str(v) for k, v in more.items()}


def read_trees(spark: SparkSession, roots: dict[str, str], splits: int = SPLITS) -> DataFrame:
    """{bundle_id: root directory} -> files(bundle_id, path, content)."""
    return spark.read.format("filetree").options(**_options(spark, roots, splits=splits)).load()


def stream_trees(spark: SparkSession, roots: dict[str, str], splits: int = SPLITS, settle: float = 1) -> DataFrame:
    """The same as a stream: each batch holds the files that are new or changed since the last."""
    return spark.readStream.format("filetree").options(**_options(spark, roots, splits=splits, settle=settle)).load()


def read_tree_entries(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    return entries(read_trees(spark, roots))
