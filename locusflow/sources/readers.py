"""Readers: JSON arrays and lines, CSV, Parquet, XML dumps, JDBC tables, decoded map objects and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import first_wins, last_wins


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file holding one JSON array. Convert it to Parquet once: such a file can't be split."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, *, seq: bool = False) -> DataFrame:
    """Lines of JSON. `seq`: adds _seq, the order of records by file, block and line."""
    rows = spark.read.schema(schema).json(path)
    if not seq:
        return rows
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("_seq"))


def json_lines_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record of each key, as an append-only file means it."""
    return last_wins(json_lines(spark, path, schema, seq=True), [key], "_seq")


def json_lines_first(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    return first_wins(json_lines(spark, path, schema, seq=True), [key], "_seq")


def csv(spark: SparkSession, path: str, schema: str | None = None, *, line_breaks: bool = False) -> DataFrame:
    """CSV with a header; a byte order mark doesn't become part of the first name. `line_breaks`: values may hold some, so files aren't split."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", line_breaks).option("escape", '"')
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Columns and filters go into the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where is not None else rows
    return rows.select(*columns) if columns else rows


def open_places(places: DataFrame, prefix: str = "Dining and Drinking") -> DataFrame:
    """Places with a position, a category of the prefix, not closed and without open flags."""
    fitting = F.exists("fsq_category_labels", lambda x: x.startswith(prefix))
    return places.where(F.col("latitude").isNotNull() & fitting & F.col("date_closed").isNull() & (F.size(F.coalesce("unresolved_flags", F.array().cast("array<string>"))) == 0))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of a numpy file: one task reads a file, so keep large matrices as Parquet arrays."""
    import io

    import numpy as np
    import pandas as pd

    def run(parts):
        for part in parts:
            for body in part["content"]:
                x = np.load(io.BytesIO(body)).astype("float64")
                yield pd.DataFrame({"row": np.arange(len(x)), "vector": list(x)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row bigint, vector array<double>")


def xml_pages(spark: SparkSession, path: str, tag: str = "page") -> DataFrame:
    """A dump of pages, compressed or not, one row each."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A database table, read in ranges of a numeric column where bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def map_objects(objects: DataFrame, keys: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """Decoded map objects (osm_id, kind, tags, rings) with one of the tag keys, at the mean of their vertices."""
    holds = F.lit(False)
    for k in keys:
        has = F.map_contains_key("tags", F.lit(k))
        wanted = (values or {}).get(k)
        holds = holds | (has & F.col("tags")[k].isin(*wanted) if wanted else has)
    rows = objects.where(holds).withColumn("_p", F.flatten("rings"))
    mean = lambda c: F.aggregate("_p", F.lit(0.0), lambda a, p: a + p[c]) / F.size("_p")
    return rows.withColumns({"lat": mean("lat"), "lon": mean("lon"), "name": F.map_filter("tags", lambda k, _: k.startswith("name"))}).drop("_p", "rings")


def rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(category, pattern) of a rule file, by priority: a small dimension that becomes expressions."""
    rows = json_array(spark, path, "priority int, category string, pattern string")
    return [(r.category, r.pattern) for r in rows.orderBy("priority").collect()]


def batch_results(lines: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Rows inside nested result JSON; malformed results give none."""
    return lines.select(F.explode(F.from_json(body, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})).alias("r")).select("r.*").where(F.col("id").isNotNull())


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to fetch after an earlier run."""
    return todo.join(done.select(key), key, "left_anti")
