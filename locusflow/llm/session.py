"""What the operators need of a session: table reads, Arrow batch bounds, and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,024 rows, set for the session and left so: a plan runs under what holds at its action. The operators cut them again by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on local threads, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which is set once where the session has none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be no column's; case doesn't tell columns apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size, without a job; a block a partition where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.rdd.getNumPartitions() << 24
