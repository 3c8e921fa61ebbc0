"""Snapshot tables on plain Parquet: versions in folders of their own, and a pointer to the newest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where a local session names none, as in tests, a temporary one; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-stage-")
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a stage's table and reads it: later stages filter and scan columns, instead of computing every expression again. Also gives its path, for drop()."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    return staged(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes stage tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Appends a stage's rows, partitioned, for instance by artifact type or date."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a snapshot that were written to their end, on any file system that Spark reads."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    done = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v=")) for p in done if p.getName().startswith("v="))


def read_snapshot(spark: SparkSession, path: str, schema: str, *, before: int | None = None) -> DataFrame:
    """The newest version (below `before`, where given); an empty frame before the first."""
    have = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/v={have[-1]}") if have else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, path: str, *, keep: int = 2, version: int | None = None) -> int:
    """Writes the next version, never over one that is being read, and drops all but the last `keep`. A version counts once its _SUCCESS file is there, so a run that dies halfway changes nothing. A stream names the version by its batch, so that a batch that is run again replaces its own."""
    spark = df.sparkSession
    have = [v for v in versions(spark, path) if version is None or v < version]
    new = (have[-1] if have else 0) + 1 if version is None else version
    df.write.mode("overwrite").parquet(f"{path}/v={new}")
    drop(spark, *[f"{path}/v={v}" for v in have[: max(0, len(have) + 1 - keep)]])
    return new


def upsert(old: DataFrame, new: DataFrame, key: str, *, merge_map: str | None = None) -> DataFrame:
    """old with new's rows in place of those of equal keys; a map column named merge_map is merged instead, new entries first."""
    if not merge_map:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    cols = [c for c in new.columns if c not in (key, merge_map)]
    j = old.select(key, F.col(merge_map).alias("_m"), *[F.col(c).alias(f"_{c}") for c in cols]).join(new, key, "full_outer")
    empty = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(F.coalesce("_m", empty), lambda k, v: ~F.map_contains_key(F.coalesce(F.col(merge_map), empty), k)), F.coalesce(F.col(merge_map), empty))
    return j.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in cols], both.alias(merge_map))


def exposition(counts: DataFrame) -> DataFrame:
    """One row of named counts to (name, value) rows."""
    return counts.unpivot([], counts.columns, "name", "value")
