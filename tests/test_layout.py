"""Indexes and layouts: names by their runs of letters, places by a curve, and what of a file a question reads."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from locusflow.functions import geo
from locusflow.operators import name_index, search
from locusflow.operators.name_index import NameIndex
from locusflow.sources import layout

draw = random.Random(3)
SYLLABLES = ["ka", "to", "mi", "역", "京都", "ra", "no", "x", "é"]
NAMES = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 9))) for _ in range(3_000)] + [None, "", "a", "a", "%_\\"]


def scanned_rows(spark, df):
    """Rows that came out of the file scan of a plan once it has run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution()
        n = plan.executedPlan().executeCollect()
        leaves = plan.executedPlan().collectLeaves()
        return len(n), sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id int, key string")
    folder = str(tmp_path_factory.mktemp("names")) + "/index"
    NameIndex.write(rows, "key", folder, files=3)
    return rows, NameIndex(spark, folder, "key")


@pytest.mark.parametrize("q", ["k", "京都", "atom", "tomika", "京都역", "zz", "kazz", "", "x", "%_\\", "kaka", "é京"])
def test_names_holding_a_question(names, q):
    rows, index = names
    want = sorted(i for i, n in enumerate(NAMES) if q and n and q in n)
    assert sorted(r.id for r in index.holding(q).collect()) == want
    assert sorted(r.id for r in name_index.holding(rows, "key", q).collect()) == want
    assert sorted(r.id for r in index.equal(q).collect()) == [i for i, n in enumerate(NAMES) if q and n == q]


def test_a_question_reads_one_list(spark, names):
    """The list of its rarest run, not the table: the plan has no scan but of the lists."""
    _, index = names
    counts = {r.run: r.n for r in spark.read.parquet(index.folder + "/counts").collect()}
    found = index.holding("京都역ka")
    n, read = scanned_rows(spark, found)
    rarest = min(counts[x] for x in name_index.runs_of("京都역ka"))
    whole = spark.read.parquet(index.folder + "/lists").count()
    assert n == found.count() and n <= rarest <= read < whole / 20
    plan = found._jdf.queryExecution().toString()
    assert "/lists]" in plan and "EqualTo(run," in plan and plan.count("FileScan") == 1


def test_first_stations_are_those_of_the_rounds(spark, tmp_path):
    rows = [(i, f"st{draw.randrange(4)}x", "", 35 + draw.random() / 9, 135 + draw.random() / 9, i) for i in range(400)]
    index = spark.createDataFrame([(r[1], *r) for r in rows], "key string, id int, name string, sub string, lat double, lon double, seq int")
    NameIndex.write(index, "key", str(tmp_path / "i"))
    want = [r.id for r in search.matching_stations(index, "st").orderBy("order").collect()]
    for limit in (1, 3, 12, 500):
        for source in (index, NameIndex(spark, str(tmp_path / "i"), "key")):
            assert [r.id for r in search.first_stations(source, "st", limit).orderBy("order").collect()] == want[:limit]
    assert search.first_stations(index, "none", 5).count() == 0


def test_a_box_reads_few_row_groups(spark, tmp_path):
    """Of a catalogue over a country, three kilometres about a town are a few of its row groups."""
    rows = spark.range(240_000).select(
        "id", (31 + F.rand(1) * 14).alias("lat"), (130 + F.rand(2) * 14).alias("lon"), F.sha2(F.col("id").cast("string"), 256).alias("name"),
    )
    rows = rows.unionByName(spark.range(3).select((F.col("id") - 9).alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("x").alias("name")))
    path = str(tmp_path / "places")
    layout.write_by_place(rows, path, group_bytes=128 << 10, file_bytes=4 << 20)
    assert spark.read.parquet(path).count() == 240_003
    for at in ((35.0, 139.0), (43.06, 141.35), (31.0, 130.0)):
        south, north, west, east = at[0] - 3 / 110, at[0] + 3 / 110, at[1] - 3 / 80, at[1] + 3 / 80
        read = whole = 0
        for file in glob.glob(path + "/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            names = [meta.schema.column(i).name for i in range(meta.num_columns)]
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = {c: group.column(names.index(c)).statistics for c in ("lat", "lon")}
                whole += group.total_byte_size
                if all(s.has_min_max for s in stats.values()) and stats["lat"].min <= north and stats["lat"].max >= south and stats["lon"].min <= east and stats["lon"].max >= west:
                    read += group.total_byte_size
        assert 0 < read < 0.05 * whole
        found = layout.within(spark.read.parquet(path), at, 3.0)
        n, scanned = scanned_rows(spark, found)
        assert n == rows.where(geo.haversine_km(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lon")) <= 3).count() and scanned < 0.05 * 240_000


def test_the_curve_interleaves_bits(spark):
    cells = [(-90.0, -180.0), (90.0, 180.0), (35.0, 139.0), (-12.3, 77.7), (None, 1.0)]
    got = [r.c for r in spark.createDataFrame(cells, "a double, b double").select(layout.curve(F.col("a"), F.col("b")).alias("c")).collect()]

    def plainly(lat, lon):
        y, x = (min(max(int((v - low) / span * 2**18 // 1), 0), 2**18 - 1) for v, low, span in ((lat, -90, 180), (lon, -180, 360)))
        return sum((y >> i & 1) << 2 * i | (x >> i & 1) << 2 * i + 1 for i in range(18))

    assert got == [*(plainly(*c) for c in cells[:-1]), None]


def test_derived_tables_are_written_once_for_each_state(spark, tmp_path):
    table, built = str(tmp_path / "t"), []

    def build(out):
        built.append(out)
        spark.read.parquet(table).write.parquet(out)

    spark.range(5).write.parquet(table)
    first = layout.once(spark, "copy", table, build)
    assert layout.once(spark, "copy", table, build) == first and len(built) == 1 and built[0] != first
    spark.range(9).write.mode("overwrite").parquet(table)
    second = layout.once(spark, "copy", table, build)
    assert second != first and spark.read.parquet(second).count() == 9 and len(built) == 2
