"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BATCH = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    # lower() is the quick way and equals this for pure ASCII; elsewhere it would also change É and the like
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers hold; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session names none (tests), a temporary one is set; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores in front where df has such columns already (Spark ignores their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Writes df as a compressed table in the shared folder and reads it again, which cuts its lineage there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() made and that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
