"""Tables that a job writes on its way."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that the session
    names.  Where it names none: a temporary folder on a local master, else one in the
    warehouse, which driver and executors share."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints"))
    with without_shuffle_files(spark):
        return df.select("*").checkpoint(eager=True)  # planned anew, under that setting


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What a job shuffles in here is of no use behind it: Spark drops those files at its end."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """The table as files by columns, which stay until the session ends."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    _path(spark, folder, lambda fs, at: fs.deleteOnExit(at))
    with without_shuffle_files(spark):
        df.select("*").write.parquet(f"{folder}/table")
    return spark.read.schema(df.schema).parquet(f"{folder}/table")


def _path(spark: SparkSession, path: str, do):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    return do(fs, at)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of a file, or of a folder's files; none if there is no such path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)] if fs.exists(at) else []


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one on a local master."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(shared, f"files-{uuid.uuid4().hex}") if shared else tempfile.mkdtemp(prefix="files-")


def _listed(batches: Iterator[pa.RecordBatch], key: str, values: str) -> Iterator[pa.RecordBatch]:
    """From batches in order of the key a row for each key, whose rows may be of two batches."""
    rest = None
    for b in itertools.chain(batches, [None]):
        last = b is None
        b = rest if last else pa.concat_batches([rest, b]) if rest is not None else b
        if b is None or not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        if not last:  # the last key's rows may go on
            rest, starts = b.slice(starts[-2]), starts[:-1]
            b = b.slice(0, starts[-1])
        if not b.num_rows:
            continue
        out = []
        for n, column in zip(b.schema.names, b.columns):
            if n == key:
                out.append(column.take(pa.array(starts[:-1])))
            elif n == values:
                flat = column.flatten()
                out.append(pa.ListArray.from_arrays(pa.array(starts * (len(flat) // b.num_rows), pa.int32()), flat))
            else:
                out.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), column))
        yield pa.RecordBatch.from_arrays(out, names=b.schema.names)


class FeatureStore:
    """Frames written as tables that are bucketed by one key, so that they meet without
    another exchange: each frame is dealt out once, when it is written.

    As a context it drops its tables and their files at the end; what is read from it has
    to be written elsewhere before, as written() does, or its files be left, see leave().
    """

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key, self.folder, self.names = spark, key, shared_folder(spark), []
        self.left = False
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(self, frame: DataFrame) -> DataFrame:
        """The frame as it is stored."""
        return self._put(frame.repartition(self.buckets, self.key))

    def put_lists(self, frame: DataFrame, values: str) -> DataFrame:
        """The frame as a row for each key, which has a list of each other column; the arrays of
        `values`, all of one length, follow each other in one array."""
        kinds = dict(frame.dtypes)
        kind = ", ".join(f"`{n}` {k if n in (self.key, values) else f'array<{k}>'}" for n, k in kinds.items())
        dealt = frame.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        return self._put(dealt.mapInArrow(partial(_listed, key=self.key, values=values), kind))

    def _put(self, dealt: DataFrame) -> DataFrame:
        name = f"frame_{uuid.uuid4().hex}"
        with without_shuffle_files(self.spark):
            # a map keeps its rows' partitions, which Spark doesn't know: the buckets are given to the writer's tasks as they are
            dealt.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def keep(self, frame: DataFrame) -> DataFrame:
        """The frame as files by columns, for the frames that are made of it: smaller than a
        checkpoint, and gone with tidy() or the store."""
        path = f"{self.folder}/kept/{uuid.uuid4().hex}"
        with without_shuffle_files(self.spark):
            frame.select("*").write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def tidy(self) -> None:
        """Drops what was kept on the way to the stored frames."""
        _path(self.spark, f"{self.folder}/kept", lambda fs, at: fs.delete(at, True))

    def leave(self, frame: DataFrame) -> DataFrame:
        """The frame, which reads the stored files whenever it is used: they stay until the session ends."""
        _path(self.spark, self.folder, lambda fs, at: fs.deleteOnExit(at))
        self.left = True
        return frame

    def __enter__(self) -> FeatureStore:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not self.left:
            _path(self.spark, self.folder, lambda fs, at: fs.delete(at, True))
