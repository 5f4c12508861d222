"""Diffs of file states, and merging a delta into a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_diff(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key, state (unchanged, changed, deleted); a file without known digest is changed."""
    was = old.select(*key, F.col(digest).alias("was"), F.lit(True).alias("there"))
    now = new.select(*key, F.col(digest).alias("now"), F.lit(True).alias("here"))
    state = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() | (F.coalesce("was", F.lit("")) == "") | ~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("unchanged")
    return was.join(now, key, "full").select(*key, state.alias("state"))


def has_work(diff: DataFrame) -> bool:
    return not diff.where("state <> 'unchanged'").isEmpty()


def delta_merge(stored: DataFrame, fresh: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """stored without the rows of touched (changed or deleted) keys, and the fresh rows: nothing stale remains."""
    return stored.join(touched.select(*key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


class Store:
    """Tables in a folder, partitioned by workspace and repository; a refresh replaces whole partitions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def exists(self, name: str) -> bool:
        """Whether the table has ever been written, asked of the file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def drop_workspace(self, name: str, workspace: str) -> None:
        """Deletes all rows of a workspace."""
        self.clear(name, {"workspace_id": workspace})

    def upsert(self, name: str, rows: DataFrame, key: list[str], by: tuple[str, ...] = ("workspace_id", "repo")) -> None:
        """Writes rows by key: what has the key is replaced, all else stays. Chunks with their vectors come so."""
        if self.exists(name):
            self.merge(name, rows, rows.select(*dict.fromkeys([*by, *key])).distinct(), key, by)
        else:
            self.refresh(name, rows, by)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def refresh(self, name: str, df: DataFrame, by: tuple[str, ...] = ("workspace_id", "repo")) -> None:
        """Replaces the partitions that df has rows of; others stay."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def merge(self, name: str, fresh: DataFrame, touched: DataFrame, key: list[str], by: tuple[str, ...] = ("workspace_id", "repo")) -> None:
        """delta_merge within the touched partitions; a partition left without rows is dropped."""
        stored = self.read(name)
        parts = touched.select(*by).distinct()
        within = stored.join(parts, list(by), "left_semi")
        merged = delta_merge(within, fresh, touched, key)
        scratch = f"{self.folder}/_merge-{uuid.uuid4().hex}"  # the old partitions are still read from
        merged.write.parquet(scratch)
        done = self.spark.read.schema(merged.schema).parquet(scratch)
        # known before the refresh, as what is touched may come from the partitions it replaces
        empty = [tuple(row) for row in parts.join(done.select(*by).distinct(), list(by), "left_anti").toLocalIterator()]
        self.refresh(name, done, by)
        for row in empty:
            self.clear(name, dict(zip(by, row, strict=True)))
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(scratch)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, name: str, partition: dict[str, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([f"{self.folder}/{name}", *[f"{k}={v}" for k, v in partition.items()]]))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
