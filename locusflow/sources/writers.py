"""Writers: Parquet, JSON lines, CSV, dated partitions and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import content_hash
from ..operators.ordered import numbered


def parquet(rows: DataFrame, path: str, *, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = rows.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(rows: DataFrame, path: str, *, mode: str = "overwrite", compression: str = "none", keep_nulls: bool = False) -> None:
    """`append` keeps earlier records; readers take the last of a key."""
    rows.write.mode(mode).option("compression", compression).option("ignoreNullFields", not keep_nulls).json(path)


def csv(rows: DataFrame, path: str, *, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """One ordered file where an order is asked for: for reports."""
    rows = rows.orderBy(*order).coalesce(1) if order else rows
    rows.write.mode(mode).option("header", True).csv(path)


def by_day(rows: DataFrame, path: str, ts: str, number: int) -> None:
    """gzip JSON lines under date=.../batch=number, each row by its own day; the same number again replaces what it wrote."""
    dated = rows.withColumns({"date": F.to_date(ts), "batch": F.lit(number)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").option("compression", "gzip").json(path)


def verified_by_day(rows: DataFrame, path: str, ts: str, number: int, schema: str) -> int:
    """`by_day`, then read again: fails unless as many rows are there as were written. Gives their number."""
    seen = Observation(f"written-{number}")
    by_day(rows.observe(seen, F.count(F.lit(1)).alias("n")), path, ts, number)
    wrote = seen.get["n"]
    if wrote:
        again = rows.sparkSession.read.schema(f"{schema}, date date, batch int").json(path).where(F.col("batch") == number).count()
        if again != wrote:
            raise OSError(f"batch {number}: {wrote} rows were written, {again} are there")
    return wrote


def json_array(rows: DataFrame, path: str, *, order: list[str]) -> None:
    """One JSON array in one text file, a row a line, in order: for catalogues that a client reads whole.

    The lines are sorted and written by tasks; only the brackets and commas depend on a row's neighbours.
    """
    lines = numbered(rows, order, "_place").select("_place", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    last = lines.agg(F.max("_place").alias("_last"))
    opened = F.when(F.col("_place") == 0, "[").otherwise("")
    closed = F.when(F.col("_place") == F.col("_last"), "]").otherwise(",")
    whole = lines.join(F.broadcast(last)).select("_place", F.concat(opened, "line", closed).alias("value"))
    empty = rows.sparkSession.range(1).where(F.lit(rows.isEmpty())).select(F.lit(0).cast("bigint").alias("_place"), F.lit("[]").alias("value"))
    whole.unionByName(empty).repartition(1).sortWithinPartitions("_place").select("value").write.mode("overwrite").text(path)


def manifest(outputs: dict[str, DataFrame]) -> dict[str, dict]:
    """stage output -> rows and a content hash that doesn't depend on order."""
    return {name: content_hash(rows).first().asDict() for name, rows in outputs.items()}


def artefacts(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path, its bytes as they are stored; a task hashes the files it is dealt. For files below 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumnRenamed("path", "file")


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text in whatever store the path names: written beside, then renamed."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = paths(path + ".part"), paths(path)
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(whole, False)
    if not fs.rename(part, whole):
        raise OSError(f"{path} can't be written")


def report(row: DataFrame, path: str) -> None:
    """A one-row summary as a JSON file."""
    text_file(row.sparkSession, path, json.dumps(json.loads(row.toJSON().first()), ensure_ascii=False, indent=1, sort_keys=True))
