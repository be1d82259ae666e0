"""Staging between phases: shared folders, written tables, checkpoints.

Everything here goes to the folder named by ``spark.checkpoint.dir``, which on a
cluster is storage that every executor and the driver can reach.  A staged table
outlives lost executors, and reading it back gives Catalyst its true size, so the
planner's own threshold decides whether it is broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged data; a private one only in local mode with nothing set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="pairlab-")
    spark.conf.set("spark.checkpoint.dir", folder)
    context.setCheckpointDir(folder)
    return folder


#: Catalog names of bucketed tables, by their folder.
_tables: dict[str, str] = {}

#: Folders that a session's queries have made and not removed yet, by application.
_made: dict[str, set[str]] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses; it belongs to the session until removed."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove everything this session's queries have staged; call it once their results have been read."""
    for path in list(_made.get(spark.sparkContext.applicationId, ())):
        remove_folder(spark, path)


class Scratch:
    """Staged tables that a fit needs only while it runs.

    Used as a context manager; ``next_round`` drops what is older than the previous round, so
    a long iteration keeps two rounds on storage at most.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base: list[str] = []
        self.rounds: list[list[str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in [*self.base, *[p for paths in self.rounds for p in paths]]:
            remove_folder(self.spark, path)

    def stage(self, df: DataFrame, label: str, every_round: bool = False) -> DataFrame:
        path = new_folder(self.spark, label)
        (self.rounds[-1] if self.rounds and not every_round else self.base).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage_bucketed(self, df: DataFrame, label: str, key: str) -> DataFrame:
        """Stage ``df`` dealt out and sorted by ``key``: joins and groupings by it need no shuffle of this table."""
        path = new_folder(self.spark, label)
        (self.rounds[-1] if self.rounds else self.base).append(path)
        return _bucketed(df, path, key, buckets_of(self.spark))

    def next_round(self) -> None:
        if len(self.rounds) > 1:
            for path in self.rounds.pop(0):
                remove_folder(self.spark, path)
        self.rounds.append([])


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the file system that holds it."""
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(path)


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` as Parquet and return the written table, which stays until removed."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for tables rebuilt inside an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    spark, name = df.sparkSession, f"pairlab_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    _tables[path] = name
    return spark.table(name)


def buckets_of(spark: SparkSession) -> int:
    """Buckets of staged tables: as many as a shuffle has partitions, so that either side of a join fits the other."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
