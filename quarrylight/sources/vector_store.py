"""A collection of vectors as Parquet tables in a folder: open, create, reset, upsert by id.

Every write goes to a new version; a version counts once its marker exists, so
a lost executor or a failed write leaves the one before in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, vec_id bigint, embedding array<float>, model string"


def upserted(store: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """The store with the news in place of rows of the same key.  Repeated keys among the news are an error of the caller."""
    return store.join(news.select(key), key, "left_anti").unionByName(news)


def repeated_keys(news: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of keys that come more than once, which must not be upserted."""
    return news.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class Collection:
    """Vectors in a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "chunk_id"):
        self.spark, self.folder, self.key = spark, folder, key

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def exists(self) -> bool:
        return bool(self._versions())

    def rows(self) -> DataFrame:
        """The vectors; an error where there is no collection."""
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no vector collection in {self.folder}: create it first")
        return self.spark.read.parquet(f"{self.folder}/v{versions[-1]}")

    def create(self, schema: str = SCHEMA) -> DataFrame:
        """The collection, made empty where there is none."""
        return self.rows() if self.exists() else self._write(self.spark.createDataFrame([], schema))

    def reset(self, schema: str = SCHEMA) -> DataFrame:
        """An empty collection in place of what was there."""
        return self._write(self.spark.createDataFrame([], schema))

    def upsert(self, news: DataFrame) -> DataFrame:
        """Puts rows in by key; a key that comes more than once is an error."""
        twice = repeated_keys(news, self.key).limit(5).collect()
        if twice:
            raise ValueError(f"repeated ids: {sorted(r[self.key] for r in twice)}")
        return self._write(upserted(self.rows(), news, self.key))

    def _write(self, rows: DataFrame) -> DataFrame:
        versions = self._versions()
        rows.write.parquet(f"{self.folder}/v{versions[-1] + 1 if versions else 0}")
        return self.rows()
