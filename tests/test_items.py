"""Names as written, JSON lines, snippets, spreading that settles, visited places, idle sessions, artefacts and near cells."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from locusflow import catalogue
from locusflow.functions import geo
from locusflow.operators import labels, learning, logs, resolve
from locusflow.plans import log_queries
from locusflow.sources import writers


def test_names_are_trimmed_and_need_a_letter(spark):
    rows = spark.createDataFrame([(" a b ",), ("A b",), ("・ー・",), ("・・",), ("  ",), (None,), ("１",)], "n string")
    assert [r.n for r in labels.named(rows, "n").collect()] == ["a b", "A b", "・ー・", "１"]  # the long-vowel sign is a letter


def test_json_lines_keep_times_decimals_and_nulls(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05.5+00:00' AS t, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS n, DATE '2024-02-03' AS d, CAST(1.50 AS DECIMAL(10, 2)) AS x, CAST(NULL AS STRING) AS s, array(1, 2) AS a")
    got = json.loads(rows.select(logs.json_line(rows).alias("j")).first().j)
    assert got == {"t": "2024-01-02T03:04:05.500000+00:00", "n": "2024-01-02T03:04:05", "d": "2024-02-03", "x": 1.5, "s": None, "a": [1, 2]}


def test_snippets_fall_back_to_the_name(spark):
    found = spark.createDataFrame([("a x", ["both"]), ("a", ["name"]), ("b y", []), ("b", ["only name"])], "query string, snippets array<string>")
    rows = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "y"), ("c", None), ("a", None)], "name string, area string")
    got = sorted((r.name, r.area or "", tuple(r.snippets)) for r in learning.with_snippets(rows, found, name="name", area="area").collect())
    assert got == [("a", "", ("name",)), ("a", "x", ("both",)), ("a", "z", ("name",)), ("b", "y", ("only name",)), ("c", "", ())]


def test_spreading_ends_when_it_has_settled(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(12)], "a string, b string, weight double")
    seeds = spark.createDataFrame([("n0", 1.0), ("n12", -1.0)], "node string, y double")
    long = {r.node: r.score for r in learning.spread(links, seeds, rounds=30).collect()}
    early = {r.node: r.score for r in learning.spread(links, seeds, rounds=30, tolerance=1e-4).collect()}
    assert early.keys() <= long.keys() and all(abs(early[n] - long[n]) < 1e-4 for n in early) and early != long


def test_visits_are_the_lists_as_changes(spark):
    draw = random.Random(5)
    rows = [(u, i, draw.choice([None, "p1", "p2", "p3", "p4"])) for i in range(200) for u in ("a", "b")]
    got = {(r.u, r.i): (r.added, r.n_before) for r in logs.visits(spark.createDataFrame(rows, "u string, i int, p string"), by="u", order=["i"], place="p").collect()}
    seen = {"a": [], "b": []}
    for u, i, p in rows:
        new = p is not None and p not in seen[u]
        assert got[u, i] == (p if new else None, len(seen[u]))
        seen[u] += [p] * new


def test_visited_so_far_gives_whole_lists(spark, tmp_path):
    """A list for each event, as the first SQL gave it, not what the event adds to it; nulls of the order come last in both."""
    duckdb = pytest.importorskip("duckdb")
    draw = random.Random(6)
    rows = [(i, draw.choice([1, 2, None]), draw.choice([None, *range(40)]), draw.choice(["purchase", "purchase", "click", None])) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string")
    events.select("event_id", F.expr("cast(timestamp_seconds(s) AS timestamp_ntz)").alias("ts"), "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.visited for r in log_queries.visited_so_far(spark, str(tmp_path)).collect()}
    want, seen = {}, {}
    for i, user, _, kind in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want[i] = ",".join(sorted(seen.setdefault(user, set())))
        seen[user] |= {str(i % 97)} if kind == "purchase" else set()
    assert got == want and max(v.count(",") for v in got.values()) > 20
    sql = catalogue.ORACLES["visited_so_far"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert dict(duckdb.sql(sql).fetchall()) == want


def test_idle_sessions(spark):
    rows = [("a", 0, "x"), ("a", 10, "end"), ("a", 20, "x"), ("a", 121, "x"), ("a", 221, "x"), ("b", 5, "x")]
    df = spark.createDataFrame(rows, "k string, s int, kind string").withColumn("ts", F.timestamp_seconds("s"))
    make = lambda now: sorted((r.k, r.session, r.n, r.closed_by) for r in logs.session_table(df, by="k", ts="ts", tie="s", ends=F.col("kind") == "end", idle_seconds=100, now=now).collect())
    assert make(None) == [("a", 0, 2, "end"), ("a", 1, 1, "idle"), ("a", 2, 2, None), ("b", 0, 1, None)]
    assert make(F.timestamp_seconds(F.lit(300))) == [("a", 0, 2, "end"), ("a", 1, 1, "idle"), ("a", 2, 2, None), ("b", 0, 1, "idle")]


def test_artefacts_are_files_with_sizes_and_hashes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "in" / "b.bin").write_bytes(b"\0" * 1000)
    got = {r.file.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in writers.artefacts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (3, hashlib.sha256(b"abc").hexdigest()), "b.bin": (1000, hashlib.sha256(b"\0" * 1000).hexdigest())}


@pytest.mark.parametrize("km", [0.1, 3.0, 40.0])
def test_four_cells_hold_all_that_is_near(spark, km):
    """Pairs about the equator, the date line, middle latitudes and the poles, against all pairs."""
    draw = random.Random(int(km * 10))
    places = []
    for lat in (0.0, 35.0, -51.3, 66.0, 84.0, 88.7, 89.9, -89.95):
        for lon in (139.0, 179.9999, -180.0, 0.0):
            for _ in range(6):
                up, over = draw.uniform(-1.3, 1.3) * km / 111, draw.uniform(-1.3, 1.3) * km / 111 / max(math.cos(math.radians(lat)), 0.01)
                places.append((max(-90.0, min(90.0, lat + up)), (lon + over + 180) % 360 - 180))
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "a int, l_lat double, l_lon double")
    right = left.toDF("b", "r_lat", "r_lon")
    near = geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= km
    got = resolve.within_cells(left, right, km).where(near).select("a", "b").collect()
    want = left.crossJoin(right).where(near).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > len(places)
    assert left.select(F.max(F.size(geo.near_cells(F.col("l_lat"), F.col("l_lon"), km)))).first()[0] <= 4
