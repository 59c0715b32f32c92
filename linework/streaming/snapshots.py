"""Snapshots of a stream: the last row of each key, in buckets of which a batch rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import latest_by_key


@dataclass(frozen=True)
class Snapshot:
    """Under ``root``: data/version=v/_bucket=b with rows, and manifest/version=v with one row (bucket, at) a bucket.

    ``at`` is the version whose folder holds the bucket now. A batch writes the buckets it touches, then
    its manifest as one file, which appears whole or not at all; readers take the newest. A batch
    that runs again starts from the manifest before its own and writes the same again. After each
    batch the folders that none of the last ``keep`` manifests names are deleted, so a reader may lag so
    many batches behind. ``write`` is the function for ``foreachBatch``.
    """

    root: str
    keys: Sequence[str]
    order: Sequence[str]
    buckets: int = 64
    keep: int = 3

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _path(self, spark: SparkSession, path: str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, spark: SparkSession) -> list[int]:
        """Versions with a finished manifest, rising."""
        path, fs = self._path(spark, f"{self.root}/manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(self._path(spark, f"{self.root}/manifest/{n}/_SUCCESS")[0])]
        return sorted(done)

    def _manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        """Bucket to version; as many rows as buckets at most."""
        return {row["bucket"]: row["at"] for row in spark.read.parquet(f"{self.root}/manifest/version={version}").collect()}

    def _rows(self, spark: SparkSession, manifest: dict[int, int], wanted: Sequence[int]) -> DataFrame | None:
        paths = [f"{self.root}/data/version={manifest[b]}/_bucket={b}" for b in wanted if b in manifest]
        return spark.read.parquet(*paths) if paths else None

    def write(self, batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        before = [v for v in self._versions(spark) if v < version]
        manifest = self._manifest(spark, before[-1]) if before else {}
        new = latest_by_key(batch, list(self.keys), list(self.order)).persist()
        try:
            touched = [row[0] for row in new.select(self.bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
            if touched:
                old = self._rows(spark, manifest, touched)
                merged = new if old is None else latest_by_key(old.unionByName(new), list(self.keys), list(self.order))
                merged.withColumn("_bucket", self.bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/data/version={version}")
        finally:
            new.unpersist()
        rows = sorted((manifest | dict.fromkeys(touched, version)).items())
        spark.createDataFrame(rows, "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        self._expire(spark)

    def _expire(self, spark: SparkSession) -> None:
        versions = self._versions(spark)
        live = {(b, at) for v in versions[-self.keep :] for b, at in self._manifest(spark, v).items()}
        known = {(b, at) for v in versions[-self.keep - 1 :] for b, at in self._manifest(spark, v).items()}
        for b, at in known - live:
            path, fs = self._path(spark, f"{self.root}/data/version={at}/_bucket={b}")
            fs.delete(path, True)
        for v in versions[: -self.keep]:
            path, fs = self._path(spark, f"{self.root}/manifest/version={v}")
            fs.delete(path, True)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows of the newest version; None before the first batch."""
        versions = self._versions(spark)
        if not versions:
            return None
        manifest = self._manifest(spark, versions[-1])
        return self._rows(spark, manifest, sorted(manifest))
