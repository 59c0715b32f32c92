"""Scans over drifting files, snapshots with last-write-wins and append-only keys, the warehouse build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import warehouse


def scan_source(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """All files under ``root`` that match, united by name; columns that a file lacks are null."""
    return spark.read.option("mergeSchema", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(root)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def changed_files(listing: DataFrame, stamps: DataFrame) -> DataFrame:
    """Rows of (path, stamp) whose stamp is not the one that was seen."""
    return listing.join(stamps.select("path", F.col("stamp").alias("_seen")), "path", "left").filter(F.col("_seen").isNull() | (F.col("_seen") != F.col("stamp"))).drop("_seen")


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``; null keys are keys."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target after the batch: the last row of each key wins, the batch's among equals."""
    both = target.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest_by_key(both, keys, [*order, "_batch"]).drop("_batch")


def append_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks, one for each key."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def build_warehouse(spark: SparkSession, raw_plays: DataFrame, root: str) -> DataFrame:
    """Write plays, team_weeks, defense_depth_weeks and player_weeks under ``root`` by season; (table, n)."""
    flagged = warehouse.plays(raw_plays)
    flagged.write.mode("overwrite").partitionBy("season").parquet(f"{root}/plays")
    flagged = spark.read.parquet(f"{root}/plays")
    made = {"team_weeks": warehouse.team_weeks(flagged), "defense_depth_weeks": warehouse.defense_depth_weeks(flagged), "player_weeks": warehouse.player_weeks(flagged)}
    for name, df in made.items():
        df.write.mode("overwrite").partitionBy("season").parquet(f"{root}/{name}")
    counts = [spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name in ("plays", *made)]
    return union_by_name(counts)


def list_tables(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(table, n) of Parquet tables under a root."""
    return union_by_name([spark.read.parquet(f"{root}/{n}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n") for n in names])


def sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SQL over named tables, written as {name} in the statement."""
    return spark.sql(statement, **tables)
