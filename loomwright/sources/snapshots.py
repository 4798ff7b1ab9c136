"""Tables as snapshots: every change writes a new folder, and the head moves last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing without the keys of new, and new, one row for each key (the last by `order`)."""
    w = Window.partitionBy(key).orderBy(*([F.col(order).desc()] if order else [F.lit(1)]))
    fresh = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return existing.join(fresh.select(key), key, "left_anti").select(*existing.columns).unionByName(fresh.select(*existing.columns))


def delete(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key).distinct(), key, "left_anti").select(*existing.columns)


class Store:
    """Named tables below a root: <root>/<table>/<revision> and <root>/HEAD, a table of (table, revision, at)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _head(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/HEAD")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("name string, revision string, at timestamp").parquet(f"{self.root}/HEAD") if there else None

    def revision(self, name: str) -> str | None:
        head = self._head()
        row = head.filter(F.col("name") == name).agg(F.max_by("revision", "at").alias("r")).first() if head is not None else None
        return row.r if row else None

    def read(self, name: str) -> DataFrame | None:
        r = self.revision(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{r}") if r else None

    def write(self, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = ()) -> str:
        """All tables under one new revision; readers see none of them before the last line."""
        revision = uuid.uuid4().hex
        for name, df in tables.items():
            out = df.write
            keys = [c for c in partition_by if c in df.columns]
            (out.partitionBy(*keys) if keys else out).parquet(f"{self.root}/{name}/{revision}")
        rows = self.spark.createDataFrame([(n, revision) for n in tables], "name string, revision string")
        rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/HEAD")
        return revision
