"""Sources, sinks, cursor exports, the profile stream, chains in names, and small functions around services."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import text
from locusflow.functions.chains import without_branch
from locusflow.operators import build, chains, evaluation, labels, learning, logs, ranking, recommend, resolve, search, series
from locusflow.operators.candidates import Constraints
from locusflow.sources import readers, writers
from locusflow.streaming import jobs


def test_database_tables_are_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i}", i % 3 == 0) for i in range(100)], "id int, name string, open boolean")
    rows.write.format("jdbc").option("url", url).option("dbtable", "places").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    got = readers.jdbc(spark, url, "places", column="ID", bounds=(0, 100), parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100
    assert sorted(r[0] for r in got.where("open").collect()) == list(range(0, 100, 3))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    writers.parquet(spark.range(50).selectExpr("id", "id % 5 AS k", "'x' AS wide"), str(tmp_path / "p"), by=["k"])
    rows = readers.parquet(spark, str(tmp_path / "p"), ["id"], (F.col("k") == 2) & (F.col("id") > 20))
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThan(id,20)" in plan and "wide" not in plan.split("ReadSchema")[1] and "(k#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert sorted(r.id for r in rows.collect()) == [22, 27, 32, 37, 42, 47]


def test_files_of_many_kinds(spark, tmp_path):
    x = np.arange(12).reshape(4, 3)
    np.save(tmp_path / "m.npy", x)
    assert [r.vector for r in readers.matrix(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == x.astype(float).tolist()
    (tmp_path / "a.json").write_text('[{"id":"a","v":1},\n {"id":"b","v":null}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "id string, v int").count() == 2
    (tmp_path / "r.json").write_text('[{"priority":2,"category":"b","pattern":"y"},{"priority":1,"category":"a","pattern":"x"}]')
    assert readers.rules(spark, str(tmp_path / "r.json")) == [("a", "x"), ("b", "y")]
    import bz2

    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(b"<d><page><title>A</title></page><page><title>B</title></page></d>"))
    assert sorted(r.title for r in readers.xml_pages(spark, str(tmp_path / "d.xml.bz2")).collect()) == ["A", "B"]
    places = spark.createDataFrame([(1.0, ["Dining and Drinking > Bar"], None, None), (None, ["Dining and Drinking"], None, []), (1.0, ["Shop"], None, []), (1.0, ["Dining and Drinking"], "2020", []), (1.0, ["Dining and Drinking"], None, ["dup"])], "latitude double, fsq_category_labels array<string>, date_closed string, unresolved_flags array<string>")
    assert readers.open_places(places).count() == 1


def test_catalogue_as_one_json_array(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"é{i}", None if i % 2 else [i]) for i in range(40)], "id int, name string, tags array<int>").repartition(4)
    writers.json_array(rows, str(tmp_path / "o"), order=["id"])
    files = [p for p in (tmp_path / "o").iterdir() if p.name.startswith("part")]
    got = json.loads("".join(p.read_text("utf-8") for p in files))
    assert len(files) == 1 and [r["id"] for r in got] == list(range(40)) and got[1] == {"id": 1, "name": "é1", "tags": None}
    writers.json_array(rows.limit(0), str(tmp_path / "e"), order=["id"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").iterdir() if p.name.startswith("part"))) == []


def test_other_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, []), (1, "x", [1])], "id int, name string, tags array<int>")
    writers.json_lines(build.stripped(rows), str(tmp_path / "l"), compression="gzip")
    assert sorted(spark.read.text(str(tmp_path / "l")).toPandas()["value"]) == ['{"id":1,"name":"x","tags":[1]}', '{"id":2}']
    writers.json_lines(rows, str(tmp_path / "n"), keep_nulls=True)
    assert '{"id":2,"name":null,"tags":[]}' in set(spark.read.text(str(tmp_path / "n")).toPandas()["value"])
    writers.json_lines(rows, str(tmp_path / "l"), mode="append", compression="gzip")
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    writers.csv(rows.select("id", "name"), str(tmp_path / "c"), order=["id"])
    assert [r.id for r in readers.csv(spark, str(tmp_path / "c"), "id int, name string").collect()] == [1, 2]
    writers.report(rows.agg(F.count("*").alias("n")), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 2}
    assert writers.manifest({"a": rows})["a"]["n"] == 2


def test_dated_batches_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 23:59:59"), (2, "2024-01-02 00:00:01")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("at"))
    for _ in range(2):
        assert writers.verified_by_day(rows, str(tmp_path / "o"), "at", 0, "id int, at timestamp") == 2
    assert writers.verified_by_day(rows.where("id = 2"), str(tmp_path / "o"), "at", 1, "id int, at timestamp") == 1
    got = spark.read.json(str(tmp_path / "o"))
    assert sorted((r.id, str(r.date), r.batch) for r in got.collect()) == [(1, "2024-01-01", 0), (2, "2024-01-02", 0), (2, "2024-01-02", 1)]


def test_a_lost_batch_is_noticed(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "2024-01-01 23:59:59")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("at"))
    write = writers.by_day
    monkeypatch.setattr(writers, "by_day", lambda rows, path, ts, number: write(rows, path, ts, number + 1))
    with pytest.raises(OSError):
        writers.verified_by_day(rows, str(tmp_path / "x"), "at", 5, "id int, at timestamp")


def test_cursor_exports_take_each_row_once(spark, tmp_path):
    table = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00") for i in range(10)], "id int, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
    out, state = str(tmp_path / "o"), str(tmp_path / "s")
    assert jobs.export_table(table.where("id < 4"), out, state, "2024-01-01 00:03:30") == 2  # 0 and 1 are older than the lag
    assert jobs.export_table(table, out, state, "2024-01-01 00:06:00") == 2
    assert jobs.export_table(table, out, state, "2024-01-01 00:06:00") == 0
    for p in (tmp_path / "s" / "cursor-000000000001").iterdir():
        p.unlink()  # the newest cursor is broken: the batch is written again, under its own number
    assert jobs.export_table(table, out, state, "2024-01-01 00:06:00") == 2
    assert jobs.export_table(table, out, state, "2024-01-01 01:00:00") == 6
    got = spark.read.json(out)
    assert sorted(r.id for r in got.collect()) == list(range(10)) and {r.batch for r in got.collect()} == {0, 1, 2}
    for n in range(3):
        for p in (tmp_path / "s" / f"cursor-{n:012d}").iterdir():
            p.unlink()
    with pytest.raises(OSError):
        jobs.export_table(table, out, state, "2024-01-01 01:00:00")


def profile_log():
    rng = random.Random(4)
    out = []
    for i in range(120):
        kind = rng.choice(["intend", "intend", "choose", "say"])
        out.append({
            "actor": rng.choice("abc"), "ts": f"2024-01-01T00:00:{i // 2:02d}Z", "seq": i, "kind": kind, "trait": "local" if kind == "say" else None, "value": "true" if kind == "say" else None,
            "next_category": rng.choice(["bar", "meal", None]) if kind == "intend" else None, "max_distance_km": rng.choice(["1.0", "2.5", None]) if kind == "intend" else None, "local": rng.choice(["true", None]) if kind == "intend" else None,
            "item": f"i{i}", "category": rng.choice(["meal", "sight"]), "sub": rng.choice(["s1", "s2"]),
        })
    return out


def test_profile_stream_equals_the_batch(spark, tmp_path):
    """Events in three files, one a batch: the last state of each actor is that of the whole log."""
    schema = "actor string, ts timestamp, seq int, kind string, trait string, value string, next_category string, max_distance_km string, local string, item string, category string, sub string"
    log = profile_log()
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, log[40 * n : 40 * n + 40])))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []

    def keep(batch, number):
        seen.append({r.actor: r.doc for r in batch.collect()})

    rows = jobs.profiles(jobs.log_stream(spark, str(tmp_path / "in"), schema))
    jobs.run_to_end(lambda: rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    whole = {r.actor: r.doc for r in jobs.profiles_of(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    last = {}
    for batch in seen:
        last.update(batch)
    assert last == whole and len(seen) == 3


def test_windowed_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"k": k, "ts": f"2024-01-01T00:{m:02d}:30Z"}) for k, m in [("a", 0), ("a", 0), ("b", 1), ("a", 59)]))
    got = {}
    rows = jobs.window_counts(jobs.log_stream(spark, str(tmp_path / "in"), "k string, ts timestamp"), key="k", ts="ts")
    jobs.run_to_end(lambda: rows.writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({(r.k, r.begin.minute): r.n for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert got == {("a", 0): 2, ("b", 1): 1, ("a", 59): 1}


CHAIN_ROWS = [(0, "sushi", "天狗", False), (1, "cafe", "ウエスト", False), (2, "donburi", "松屋", True), (3, "donburi", "韓丼", False), (4, "bar", " ", False), (5, "bar", "Ｒｅｄ Ｄｏｏｒ", False)]
BRAND_ROWS = [(0, "soba", "Q1", "小諸そば", "vote"), (1, "cafe", "Q2", "ウエスト", "vote"), (2, "bar", "Q5", None, "hand"), (3, "bar", "Q6", "x", "hand"), (4, "grill", "Q7", "ウエスト", "hand")]
CHAIN_WORDS = [("sushi", "寿司|すし"), ("soba", "そば"), ("donburi", "丼"), ("cafe", "カフェ"), ("yakitori", "やきとり")]


def chain_dimension(spark, rows=CHAIN_ROWS):
    return chains.dimension(spark.createDataFrame(rows, "seq int, category string, name string, start_only boolean"))


def brand_dimension(spark, rows=BRAND_ROWS):
    return chains.dimension(spark.createDataFrame(rows, "seq int, category string, brand_key string, name string, source string"))


def test_chains_in_names(spark):
    want = [
        ("天狗", ("sushi", "chain")), ("すし処 天狗", ("sushi", "chain")), ("やきとり 天狗", ("yakitori", "keyword")), ("ウエスト カフェ", ("cafe", "chain")), ("小松屋", (None, None)), ("松屋食堂", (None, None)), ("松屋 駅前店", ("donburi", "chain")),
        ("松屋駅前店", ("donburi", "chain")), ("駅前 松屋", (None, None)), ("韓丼", ("donburi", "chain")), ("天狗(新館)", ("sushi", "chain")), ("そば 花", ("soba", "keyword")), ("", (None, None)), (None, (None, None)), ("天狗店", ("sushi", "chain")),
        ("花・天狗", ("sushi", "chain")), ("the RED door 東店", ("bar", "chain")), ("red doors", (None, None)), ("天狗 ", ("sushi", "chain")), ("天狗や 店", (None, None)), ("天狗 ウエスト", ("sushi", "chain")),
    ]
    names = spark.createDataFrame([(i % 5 if i % 7 else None, n, "clash") for i, (n, _) in enumerate(want)] * 2, "id int, name string, seq string")
    got = chains.label_by_chains(names, chain_dimension(spark), CHAIN_WORDS)
    assert sorted(got.columns) == sorted([*names.columns, "matched", "label", "kind"])
    rows = got.collect()
    assert len(rows) == 2 * len(want)
    assert all((r.label, r.kind) == dict((n or "", w) for n, w in want)[r.name] for r in rows)
    assert next(r.matched for r in rows if r.name == "天狗 ウエスト") == ["sushi", "cafe"]
    assert chains.label_by_chains(names, chain_dimension(spark, []), []).where("label IS NOT NULL").count() == 0
    assert chains.label_by_chains(names.limit(0), chain_dimension(spark), CHAIN_WORDS).count() == 0


def test_brands(spark):
    rows = [("Q9; Q2", "x"), (None, "小諸そば 本店"), ("", "ウエストそば"), (None, "ウエスト そば"), (None, "ウエスト"), (None, None), ("Q5;Q1", "ウエスト"), (None, "x 店"), ("Q1", None), (None, "の ウエスト")]
    got = chains.label_by_brands(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, keys string, name string"), brand_dimension(spark), CHAIN_WORDS).orderBy("id").collect()
    assert [r.label and (r.label, r.rule) for r in got] == [("cafe", "brand_key"), ("soba", "brand_name"), None, None, ("cafe", "brand_name"), None, ("bar", "brand_key"), None, ("soba", "brand_key"), None]
    assert (got[4].source, got[6].source) == ("vote via Q2", "hand")


def test_ten_thousand_chains_are_one_join(spark):
    """The answers of a plain reader, and a plan that doesn't grow with the list."""
    draw = random.Random(8)
    parts = ["ka", "no", "ten", "mori", "bar", "屋", "亭", "grill", "no.1"]
    words = sorted({"".join(draw.choice(parts) for _ in range(draw.randrange(1, 7))) for _ in range(30_000)})
    shown = sorted({draw.choice(words) + draw.choice(["", "", " " + draw.choice(words)]) for _ in range(12_000)})[:10_000]
    table = [(i, f"c{i % 9}", n, i % 4 == 0) for i, n in enumerate(shown)]
    ends = ["", "", " 東店", "南店", "(x)", " annex", "x"]
    names = [(i, draw.choice(["", "", "the ", "花・", "pre"]) + draw.choice(shown).title() + draw.choice(ends)) for i in range(600)]
    by_first = {}
    for row in table:
        by_first.setdefault(row[2][0], []).append(row)

    def plainly(name):
        low, hits = name.lower(), []
        for b in [i for i in range(len(low)) if i == 0 or low[i - 1] in " ・"]:
            for seq, category, chain, start in by_first.get(low[b], []):
                after = low[b + len(chain) :]
                if low.startswith(chain, b) and not (start and b) and (not after or after[0] in " (（" or (after.endswith("店") and " " not in after)):
                    hits.append((seq, category))
        return list(dict.fromkeys(c for _, c in sorted(set(hits))))

    frame = spark.createDataFrame(names, "id int, name string")
    labelled = chains.label_by_chains(frame, chain_dimension(spark, table), [])
    got = {r.id: r.matched for r in labelled.collect()}
    assert got == {i: plainly(n) for i, n in names} and sum(map(bool, got.values())) > 300
    plans = [chains.label_by_chains(frame, chain_dimension(spark, table[:n]), [])._jdf.queryExecution().optimizedPlan().toString() for n in (10, 10_000)]
    assert abs(len(plans[0]) - len(plans[1])) < 200


@pytest.mark.parametrize("name,want", [("ドトール 天神店", "ドトール"), ("とても長い名前の花屋中央支店", "とても長"), ("本店", "本店"), (" 鳥吉 ", "鳥吉"), ("山川支店", "山川支店")])
def test_branch_endings(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(without_branch(F.col("n")).alias("b")).first().b == want


def test_stations_of_one_name_near_by_are_shown_once(spark):
    rows = [(1, {"name": "京都駅", "name:ko": "교토역"}, "JR", 34.985, 135.758), (2, {"name": "京都", "name:ko": "교토역"}, None, 34.986, 135.759), (3, {"name": "西京都"}, "K", 34.9, 135.7), (4, {"name": "京都", "name:ko": "교토역"}, "S", 35.2, 135.758)]
    stations = spark.createDataFrame([(*r, r[0]) for r in rows], "id int, names map<string,string>, operator string, lat double, lon double, seq int")
    index = search.station_index(stations)
    got = search.matching_stations(index, search.station_key_of("京都駅")).orderBy("order").collect()
    assert [(r.id, r.name, r.sub) for r in got] == [(1, "교토역", "京都駅"), (4, "교토역", "京都"), (3, "西京都", "K")]
    none = spark.createDataFrame([], "name string, city string, code string, lat double, lon double, seq int")
    places = spark.createDataFrame([("p", "京都タワー", "京都タワー", None, "tower", 0.9, 34.98, 135.75)], "id string, name string, name_key string, name_ja string, sub string, popularity double, lat double, lon double")
    found = search.find("京都", starts=none, index=index, places=places, limit=4).orderBy("place").collect()
    assert [r.source for r in found] == ["station"] * 3 + ["place"] and search.find(" ", starts=none, index=index, places=places).count() == 0
    assert search.geocode("교토", index=index, places=places, near=(35.3, 135.7)).first().lat == 35.2
    assert search.geocode("タワー", index=index, places=places).first().name == "京都タワー" and search.geocode("zz", index=index, places=places).count() == 0


def test_themes_and_radii():
    assert recommend.asked(Constraints("meal", theme="local")).theme is None and recommend.asked(Constraints("sight", theme="odd")).theme is None
    assert recommend.radii(Constraints("sight", theme="local")) == [5.0, 15.0] and recommend.radii(Constraints("meal", max_distance_km=3)) == [3, 5.0, 15.0]


def listed_plainly(rows, n):
    """rows: (id, sub, score, dist_km, content, chance); (rank, id, slot) of the list."""
    ranked = sorted(rows, key=lambda r: (-r[2], r[3], r[0]))
    top, rest = ranked[: n - 1], ranked[n - 1 :]
    shown = [(i, r[0], "top") for i, r in enumerate(top, 1)]
    subs = {r[1] for r in top}
    fresh = [r for r in rest if r[1] not in subs] or rest
    return shown + [(n, r[0], "explore") for r in sorted(fresh, key=lambda r: (-(r[4] + 0.3 * r[5]), r[0]))[:1]]


LISTED = "user int, id string, sub string, score double, dist_km double, content double, chance double"


def list_rows(rng, users, most, kinds):
    return [(u, f"i{n}", rng.choice([*(f"s{k}" for k in range(kinds)), None]), round(rng.random(), 1), round(rng.random(), 2), round(rng.random(), 1), rng.randrange(3) / 3) for u in range(users) for n in range(rng.randrange(1, most))]


@pytest.mark.parametrize(("most", "kinds", "n"), [(200, 6, 8), (40, 2, 8), (9, 9, 8), (60, 1, 2)])
def test_top_lists_equal_plain_ones(spark, most, kinds, n):
    rows = list_rows(random.Random(most), 12, most, kinds)
    df = spark.createDataFrame(rows, LISTED).repartition(5)
    got = {}
    for r in ranking.top_list(df, by=["user"], n=n, chance=F.col("chance")).collect():
        got.setdefault(r.user, []).append((r["rank"], r.id, r.slot))
    assert {u: sorted(x) for u, x in got.items()} == {u: listed_plainly([r[1:] for r in rows if r[0] == u], n) for u in {r[0] for r in rows}}
    one = ranking.top_list(df.where("user = 3"), n=n, chance=F.col("chance"))
    assert sorted((r["rank"], r.id, r.slot) for r in one.collect()) == listed_plainly([r[1:] for r in rows if r[0] == 3], n)
    assert ranking.top_list(df.limit(0), by=["user"]).count() == 0


def test_lists_are_cut_before_the_shuffle(spark):
    """A user and task send n rows and n a kind at most; the rows are read once."""
    rows = [(n % 2, f"i{n}", f"s{n % 3}", n % 97 / 97, 0.1, n % 89 / 89, 0.0) for n in range(20_000)]
    df = spark.createDataFrame(rows, LISTED).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ranking.top_list(df, by=["user"])._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        text_, sent, seen = plan.toString(), [], [plan]
        while seen:
            node = seen.pop()
            kids = node.children()
            seen += [kids.apply(i) for i in range(kids.size())]
            if node.nodeName() == "Exchange":
                sent.append(node.metrics().apply("shuffleRecordsWritten").value())
        assert text_.count("WindowGroupLimit") >= 1 and text_.count("RoundRobinPartitioning") == 1
        assert max(x for x in sent if x != 20_000) <= 2 * 4 * (8 + 8 * 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_least_radius_with_a_whole_list_is_shown(spark):
    rng = random.Random(4)
    rows = [(0, f"i{n}", f"s{n % 5}", 0.0, n / 10, round(rng.random(), 1), rng.randrange(3) / 3) for n in range(60)]
    df = spark.createDataFrame(rows, LISTED)
    score = lambda x: x.withColumn("score", F.round(F.col("content") - F.col("dist_km") / F.col("radius_km"), 3))
    for rungs, want in (([0.2, 0.5, 3.0], 3.0), ([0.7, 3.0], 0.7), ([0.01, 0.3], 0.3)):
        got = recommend.top_of_rungs(df, rungs, score, chance=F.col("chance")).collect()
        inside = [(r[1], r[2], round(r[5] - r[4] / want, 3), *r[4:]) for r in rows if r[4] <= want]
        assert [(r["rank"], r.id, r.slot) for r in got] == listed_plainly(inside, 8) and {r.radius_km for r in got} == {want}
    assert recommend.top_of_rungs(df.limit(0), [1.0], score).count() == 0


def test_attractions(spark):
    kinds = build.Kinds([("sight", {"tourism": ["museum"]}), ("shrine", {"amenity": ["place_of_worship"]})], ["tourism", "amenity"], {"tourism=museum": "museum"}, worship={"shinto": "shrine"})
    rows = [(1, {"name": "A", "tourism": "museum", "wikidata": "Q5; Q2"}), (2, {"name": "B", "amenity": "place_of_worship", "religion": "x"}), (3, {"name": "", "tourism": "museum"}), (4, {"name": "D", "amenity": "place_of_worship", "religion": "shinto", "name:ko": ""}), (5, {"name": "E"})]
    objects = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "osm_id int, tags map<string,string>, lat double, lon double")
    known = spark.createDataFrame([("Q2", "가", 0.5)], "qid string, ko string, scaled double")
    got = {r.id: (r.name, r.sub, r.popularity, r.pop_tier) for r in build.attractions(objects, known, kinds).collect()}
    assert got == {"osm_1": ("가", "museum", 0.6, 1), "osm_4": ("D", "shrine", 0.05, 3)}


def test_small_operators(spark):
    rows = spark.createDataFrame([("a", 3, "f"), ("a", 0, "f"), ("b", None, "g")], "k string, rating int, f string")
    assert {r.k: (r.n, r.rated, r["mean"]) for r in learning.ratings(rows, "k").collect()} == {"a": (2, 1, 3.0), "b": (1, 0, None)}
    gone = spark.createDataFrame([("a",)], "id string")
    assert {r.k for r in logs.unreferenced(rows, gone, "k").collect()} == {None, "b"}
    e = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.0)], "by string, ms double")
    got = {r.by: (r.n, r.p50, r.rate) for r in evaluation.latency(e, by="by", ms="ms", failed=F.col("ms") > 2, seconds=4).collect()}
    assert got == {"x": (2, 3.0, 0.5), "y": (1, 2.0, 0.25)}
    ranges = spark.createDataFrame([(0, 9, "A"), (20, 240, "B")], "lo long, hi long, c string")
    assert [r.c for r in resolve.in_ranges(spark.createDataFrame([(9,), (10,), (200,), (None,)], "v long"), ranges, "v", 50).orderBy("v").collect()] == [None, "A", None, "B"]
    curves = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [3.0, 5.0]), ("c", [9.0, 1.0])], "k string, v array<double>")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "k string, cluster int")
    assert [(r.cluster, r.members, r.curve, r.peak) for r in series.cluster_curves(curves, clusters, "k", "v").collect()] == [(2, 1, [9.0, 1.0], 1), (1, 2, [2.0, 5.0], 2)]
    trend = spark.createDataFrame([("a", 1, 10, 0.5), ("a", 3, 10, 0.5), ("b", 1, 10, 0.1), ("b", 3, 30, 0.1)], "k string, p int, v int, top double")
    assert {r.k: r.trend for r in series.trend(trend, "k", "v", F.col("p"), peak=F.max("top")).collect()} == {"a": "event", "b": "rising"}
    assert labels.chunked(spark.range(60), ["id"], 25).groupBy("chunk").count().count() == 3


def test_batches_reach_a_classifier(spark):
    class Lengths:
        def __call__(self, texts):
            assert len(texts) <= 4
            return np.array([[len(t), -len(t)] for t in texts], dtype=float)

    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(10)], "id int, t string").coalesce(1)
    got = learning.classified(rows, "t", Lengths, batch=4).select("id", learning.decided(F.transform("logits", learning.sigmoid), ["long", "short"], 0.9).alias("d")).collect()
    assert [(r.d.label, r.d.sure) for r in got if r.id in (0, 1, 9)] == [("long", False), ("long", False), ("long", True)]
