"""Changes of bucketed tables: what is rewritten, what is read, and two changes at once."""

import pytest
from pyspark.sql import functions as F

from locusflow.operators import logs
from locusflow.sources.keyed import ChangedMeanwhileError, KeyedTable

COLUMNS = "id int, name string, seq int"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("seq"))
    rows = rows.unionByName(spark.createDataFrame([(None, "none", 1)], COLUMNS))
    return KeyedTable.create(rows, str(tmp_path / "t"), ["id"], buckets=16), rows


def files(tmp_path):
    return {p for p in (tmp_path / "t").rglob("*.parquet")}


def test_a_change_rewrites_its_buckets(spark, table, tmp_path):
    keyed, rows = table
    before, folders = files(tmp_path), keyed.manifest().folders
    changes = spark.createDataFrame([(7, "seven", 2), (8, "old", 0), (900, "new", 1), (None, "still none", 5)], COLUMNS)
    touched = keyed.upsert(changes, "seq")
    assert 1 <= len(touched) <= 4 and len(files(tmp_path) - before) == len(touched)
    after = keyed.manifest().folders
    assert {b for b in after if after[b] != folders.get(b)} == set(touched)
    assert rows_of(keyed.read()) == rows_of(logs.upsert(rows, changes, ["id"], "seq"))
    gone = spark.createDataFrame([(7,), (7,), (12345,), (None,)], "id int")
    before = files(tmp_path)
    touched = keyed.delete(gone)
    assert len(files(tmp_path) - before) <= len(touched) <= 3
    left = {r.id for r in keyed.read().collect()}
    assert left == set(range(400)) - {7} | {900}
    keyed.update(spark.createDataFrame([(3,), (4,)], "id int"), {"name": F.concat("name", F.lit("!")), "seq": F.lit(9)})
    assert {(r.id, r.name, r.seq) for r in keyed.read().where("seq = 9").collect()} == {(3, "n3!", 9), (4, "n4!", 9)}
    assert keyed.manifest().number == 3 and keyed.upsert(changes.limit(0), "seq") == [] and keyed.manifest().number == 3
    want = rows_of(keyed.read())
    assert keyed.tidy() >= 4 and rows_of(keyed.read()) == want and len(files(tmp_path)) <= 16


def test_a_forgotten_user_leaves_other_buckets(spark, tmp_path):
    events = spark.range(300).select((F.col("id") % 30).alias("user_id"), F.col("id").alias("seq"), F.lit("x").alias("text"))
    saved = events.groupBy("user_id").agg(F.max("seq").alias("seq"), F.first("text").alias("text"))
    keyed = KeyedTable.create(saved, str(tmp_path / "t"), ["user_id"], buckets=8)
    gone = spark.createDataFrame([(4, "a4")], "id bigint, actor string")
    touched = keyed.delete(gone.select(F.col("id").alias("user_id")))
    want = saved.join(gone.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    assert len(touched) == 1 and rows_of(keyed.read()) == rows_of(want)


def test_the_second_of_two_changes_is_refused(spark, table):
    keyed, _ = table
    want = rows_of(keyed.read())

    def other_first(rows):
        KeyedTable(spark, keyed.folder).delete(spark.createDataFrame([(1,)], "id int"))
        return rows.where("id <> 2")

    with pytest.raises(ChangedMeanwhileError):
        keyed.change(spark.createDataFrame([(2,)], "id int"), other_first)
    assert rows_of(keyed.read()) == [r for r in want if r != "(1, 'n1', 1)"]


def test_a_broken_change_leaves_the_table(spark, table):
    keyed, _ = table
    want = rows_of(keyed.read())

    def breaks(rows):
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        keyed.change(spark.createDataFrame([(2,)], "id int"), breaks)
    assert rows_of(keyed.read()) == want and keyed.delete(spark.createDataFrame([(2,)], "id int"))
    empty = KeyedTable.create(keyed.read().limit(0), keyed.folder + "-empty", ["id"])
    assert empty.read().count() == 0 and empty.upsert(spark.createDataFrame([(5, "a", 1)], COLUMNS), "seq") and empty.read().count() == 1
