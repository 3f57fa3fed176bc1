"""A keyed table in hash buckets with versions: a merge reads and rewrites only the buckets that its batch touches.

Below the root stand data/version=N/bucket=B (what merge N wrote) and manifest/version=N (a row a bucket: which version's files it has now, and how many rows). A version is there once its manifest is
whole; a merge that broke off is written over by the next try. A number that was merged before, or that is lower than one that was, is a replay and changes nothing. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MANIFEST = "bucket int, version long, rows long"


class BucketTable:
    """``keep`` whole versions stay readable. The number of buckets is fixed for a table's life; choose it so that a bucket is a few files' worth."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.root, self.schema, self.keys, self.buckets, self.keep = spark, root.rstrip("/"), schema, keys, buckets, keep

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        fs, path = self._fs(f"{self.root}/manifest/version=*/_SUCCESS")
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in fs.globStatus(path) or [])

    def manifest(self, version: int | None = None) -> dict[int, tuple[int, int]]:
        """bucket: (version of its files, rows), of the newest version or of one; at most ``buckets`` rows."""
        found = self.versions() if version is None else [version]
        if not found:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={found[-1]}").collect()
        return {r["bucket"]: (r["version"], r["rows"]) for r in rows}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table as of a version, or those buckets of it."""
        held = self.manifest(version)
        paths = [f"{self.root}/data/version={v}/__bucket={b}" for b, (v, _) in sorted(held.items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int, transition: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """The buckets that were rewritten: their rows become ``transition(old, new)``. Rows must stay in their bucket, hence keep their keys."""
        done = self.versions()
        if done and number <= done[-1]:
            return []
        touched = sorted(r["__bucket"] for r in self.bucketed(batch).select("__bucket").distinct().collect())
        held = self.manifest(done[-1]) if done else {}
        if touched:
            old = self.read(done[-1], touched) if done else self.spark.createDataFrame([], self.schema)
            rows = self.bucketed(transition(old, batch).select(*self.schema.names))
            data = f"{self.root}/data/version={number}"
            rows.repartition(len(touched), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(data)
            # the schema has the bucket, so that a version without rows can be read as well
            wrote = self.spark.read.schema(StructType([*self.schema.fields, StructField("__bucket", IntegerType())])).parquet(data).groupBy("__bucket").agg(F.count("*").alias("n")).collect()
            held = {b: x for b, x in held.items() if b not in touched} | {r["__bucket"]: (number, r["n"]) for r in wrote}
        rows = [(b, v, n) for b, (v, n) in sorted(held.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={number}")
        self.expire()
        return touched

    def expire(self) -> None:
        """Delete manifests older than the newest ``keep``, and files that none of those left names."""
        done = self.versions()
        for version in done[: -self.keep]:
            fs, path = self._fs(f"{self.root}/manifest/version={version}")
            fs.delete(path, True)
        named = {(v, b) for version in done[-self.keep :] for b, (v, _) in self.manifest(version).items()}
        fs, path = self._fs(f"{self.root}/data/version=*/__bucket=*")
        for x in fs.globStatus(path) or []:
            b, v = (int(p.getName().split("=")[1]) for p in (x.getPath(), x.getPath().getParent()))
            if (v, b) not in named and v <= done[-1]:
                fs.delete(x.getPath(), True)
