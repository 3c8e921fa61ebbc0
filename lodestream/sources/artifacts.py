"""Stage tables: what a stage of a pipeline leaves for the next one, with the contract that the next one reads it by.

Each kind of artifact is one typed Parquet table, partitioned by run and by writing, so that a read scans the files of its run alone. A small index table has a row for
each finished writing, as the last step of it: what a run that died has left is never read, and what is written twice is read once, the newest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INDEX = "artifact_id string, kind string, version int, task_id string, run_id string, created_at timestamp, schema string, n_rows long"


class ContractError(ValueError):
    """An artifact is not what its reader expects."""


@dataclass(frozen=True)
class Contract:
    """kind and version of an artifact, and the columns, as a DDL string, that it has at least."""

    kind: str
    version: int
    columns: str

    @property
    def name(self) -> str:
        return f"{self.kind}.v{self.version}"

    def check(self, schema: StructType) -> None:
        have = {f.name: f.dataType.simpleString() for f in schema}
        wrong = [f"{f.name} {f.dataType.simpleString()}, not {have.get(f.name, 'there')}" for f in StructType.fromDDL(self.columns) if have.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ContractError(f"{self.name} must have {'; '.join(wrong)}")


def write_artifact(df: DataFrame, root: str, contract: Contract, *, task_id: str, run_id: str, at: datetime | None = None) -> str:
    """Appends df as the artifact of (task, run) and returns its id. Columns named run_id or artifact_id are not kept: they are the table's partitions."""
    contract.check(df.schema)
    spark = df.sparkSession
    rows = df.drop("run_id", "artifact_id")
    artifact_id = uuid.uuid4().hex
    path = f"{root}/{contract.kind}"
    rows.withColumns({"run_id": F.lit(run_id), "artifact_id": F.lit(artifact_id)}).write.mode("append").partitionBy("run_id", "artifact_id").parquet(path)
    n = of_artifact(spark, root, contract.kind, rows.schema, run_id, artifact_id).count()
    entry = spark.range(1).select(*[F.lit(v).cast(k).alias(c) for c, k, v in (("artifact_id", "string", artifact_id), ("kind", "string", contract.kind), ("version", "int", contract.version), ("task_id", "string", task_id), ("run_id", "string", run_id))], (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("created_at"), F.lit(rows.schema.json()).alias("schema"), F.lit(n).cast("long").alias("n_rows"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/index")
    return artifact_id


def of_artifact(spark: SparkSession, root: str, kind: str, schema: StructType, run_id: str, artifact_id: str) -> DataFrame:
    full = StructType([*schema.fields]).add("run_id", "string").add("artifact_id", "string")
    return spark.read.schema(full).parquet(f"{root}/{kind}").filter((F.col("run_id") == run_id) & (F.col("artifact_id") == artifact_id)).drop("run_id", "artifact_id")


def index(spark: SparkSession, root: str) -> DataFrame:
    """A row for each finished artifact; none before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/index")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(INDEX).parquet(f"{root}/index") if there else spark.createDataFrame([], INDEX)


def newest(spark: SparkSession, root: str, *, task_id: str, run_id: str, kinds: tuple[str, ...] = ()):
    """The index row of the newest artifact of (task, run), of these kinds where some are given; None if there is none. Ties of time go to the larger id."""
    rows = index(spark, root).filter((F.col("task_id") == task_id) & (F.col("run_id") == run_id))
    rows = rows.filter(F.col("kind").isin(*kinds)) if kinds else rows
    found = rows.agg(F.max_by(F.struct("*"), F.struct("created_at", "artifact_id")).alias("a")).first()
    return found["a"]


def read_artifact(spark: SparkSession, root: str, contract: Contract, *, task_id: str, run_id: str) -> DataFrame:
    """The newest artifact that the task has written in the run. LookupError if there is none, ContractError if it is of another kind or version, or lacks a column."""
    found = newest(spark, root, task_id=task_id, run_id=run_id)
    if found is None:
        raise LookupError(f"task {task_id} has written no artifact in run {run_id}")
    if (found["kind"], found["version"]) != (contract.kind, contract.version):
        raise ContractError(f"expected {contract.name}, got {found['kind']}.v{found['version']}")
    import json

    schema = StructType.fromJson(json.loads(found["schema"]))
    contract.check(schema)
    return of_artifact(spark, root, contract.kind, schema, run_id, found["artifact_id"])
