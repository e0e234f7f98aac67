"""The engine's own operators: fixtures of their shapes, plain loops beside them, and the registry."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import geo, kana, text
from locusflow.functions.taxonomy import Taxonomy
from locusflow.operators import candidates as c
from locusflow.operators import evaluation, labels, logs, ordered, profile, ranking, resolve, series
from locusflow.operators.candidates import Constraints, Context
from locusflow.plans.stages import Runner, Stage
from locusflow.sources import readers, writers
from locusflow.streaming import jobs

TAXONOMY = Taxonomy(parent={"grill": "bar", "ramen": "noodle"}, also={"pub": ["grill"]}, terms={"선술집": {"fine": ["pub"]}, "라멘": {"coarse": ["noodle"], "fine": ["ramen"]}}, subs={"온천": "bath"})


def km(a, b, x, y):
    h = math.sin(math.radians(x - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(x)) * math.sin(math.radians(y - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        ("a", "炭火 鳥吉 本店", "bar", "bar", ["grill"], None, 33.59, 130.40, 0.3),
        ("b", "鳥吉", "bar", "unknown", None, None, 33.5902, 130.4001, 0.3),
        ("c", "麺や ラーメン太郎", "meal", "noodle", ["ramen"], None, 33.591, 130.401, 0.3),
        ("d", "別の店", "bar", "bar", ["wine"], None, 33.62, 130.45, 0.7),
    ]
    df = spark.createDataFrame(rows, "id string, name string, category string, cuisine string, fine array<string>, broad string, lat double, lon double, popularity double")
    return df.withColumns({"sub": F.col("category"), "keys": text.name_keys(F.col("name")), "name_key": text.term_key(F.col("name")), "sub_key": F.col("category"), "brand_key": text.norm(F.col("name"))})


def ids(df):
    return sorted(r.id for r in df.collect())


def test_overlapping_kinds_and_unknown_ones(places):
    here = Context(33.59, 130.40)
    assert ids(c.candidates(places, Constraints("bar", include_sub=["선술집"], max_distance_km=2), here, TAXONOMY)) == ["a"]
    assert ids(c.candidates(places, Constraints("bar", exclude_sub=["선술집"], max_distance_km=2), here, TAXONOMY)) == ["b"]
    assert ids(c.candidates(places, Constraints("meal", include_sub=["太郎"], max_distance_km=2), here, TAXONOMY)) == ["c"]


def test_visited_and_its_doubles_stay_out(places):
    got = c.candidates(places, Constraints("bar", max_distance_km=10), Context(33.59, 130.40, ["b"]), TAXONOMY)
    assert ids(got) == ["d"]


def test_trace_counts_each_rule(places):
    rows = c.trace(places, Constraints("bar", include_sub=["선술집"], max_distance_km=2), Context(33.59, 130.40), TAXONOMY).orderBy("step").collect()
    assert [(r.rule, r.n_left) for r in rows] == [("all", 4), ("category", 2), ("include", 1), ("distance", 1)]


@pytest.mark.parametrize("lat,lon", [(35.0, 139.0009), (35.0, 139.00095), (69.9, 18.9), (-78.4, 106.8), (12.0, 179.9999), (0.0005, -180.0)])
def test_doubles_within_a_hundred_metres_are_seen(spark, lat, lon):
    """Every double up to 100 m away stays out, on either side of a cell's edge, far north and over the date line; those beyond stay in."""
    rows, far = [("v", "店名", lat, lon)], set()
    for n, (bearing, metres) in enumerate((b, m) for b in range(0, 360, 30) for m in (40, 91.5, 95.6, 99.9, 100.6, 150)):
        up = metres * math.cos(math.radians(bearing)) / 111194.93
        over = metres * math.sin(math.radians(bearing)) / 111194.93 / math.cos(math.radians(lat + up / 2))
        east = (lon + over + 540) % 360 - 180
        rows.append((f"d{n}", "店名", lat + up, east))
        if km(lat, lon, lat + up, east) > 0.1:
            far.add(f"d{n}")
    df = spark.createDataFrame(rows, "id string, name string, lat double, lon double").withColumn("keys", text.name_keys(F.col("name")))
    got = c.mark_seen(df, ["v"])
    assert set(ids(got.where("not _seen"))) == far
    left = df.where("id = 'v'").select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    met = resolve.within_cells(left, df.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), 0.1)
    assert {r[0] for r in rows} - far <= {r.r_id for r in met.collect()} and met.groupBy("r_id").count().agg({"count": "max"}).first()[0] == 1


def test_brands_need_no_python(places):
    plan = c.candidates(places.withColumn("brand_key", F.lit("x")), Constraints("bar", include_brand=["Ｂｒａｎｄ #7"]), Context(), TAXONOMY).select("id")._jdf.queryExecution().toString()
    assert "brand7" in plan and "nfkc" not in plan.split("== Physical Plan ==")[1]


def test_full_width_names_meet_rules(spark):
    t = Taxonomy(parent={"ramen": "noodle"}, name_rules=[("ramen", "ramen")], overrides=[{"pattern": "^bar", "fine": "b", "parent": "bar", "note": ""}])
    df = spark.createDataFrame([("Ｒａｍｅｎ屋", "noodle"), ("Ｂａｒ　X", "bar")], "name string, cuisine string")
    got = df.select(t.named(F.col("name"), F.col("cuisine")).alias("n"), t.overriding(F.col("name"), F.lit(0.0), F.lit(0.0))["fine"].alias("o"), text.first_match(F.col("name"), [("x", "ramen")])[0].alias("m")).collect()
    assert [(r.n, r.o, r.m) for r in got] == [(["ramen"], None, "x"), ([], "b", None)]


def test_no_location_gives_null_distances(places):
    assert {r.dist_km for r in c.candidates(places, Constraints("bar"), Context(), TAXONOMY).collect()} == {None}


@pytest.mark.parametrize("near,want", [(8, 2.0), (7, 15.0)])
def test_radius_ladder(spark, near, want):
    pool = spark.createDataFrame([(i, 1.5 if i < near else 20.0) for i in range(9)], "id int, dist_km double")
    got = c.widened(pool, c.ladder(1.0)).collect()
    assert len(got) == near and {r.radius_km for r in got} == {want}
    assert c.ladder(3.0) == [3.0, 5.0, 15.0]


def test_names(spark):
    rows = [("Ｃａｆｅ　ドトール 天神店",), ("ﾄﾞﾄｰﾙ",), ("カフェ・ドトール",), ("酒場 山加商店",), ("x_²",), (None,)]
    got = spark.createDataFrame(rows, "s string").select("s", text.norm(F.col("s")).alias("n"), text.name_keys(F.col("s"), generic=["酒場"]).alias("k")).collect()
    assert [r.n for r in got] == ["cafeドトール天神店", "ドトール", "カフェドトール", "酒場山加商店", "x2", ""]
    assert got[0].k == ["cafeドトール天神店", "cafeドトール"] and got[3].k == ["酒場山加商店"] and got[5].k == []
    pair = spark.createDataFrame([(got[0].k, got[1].k, got[3].k)], "a array<string>, b array<string>, c array<string>")
    assert tuple(pair.select(text.same_name(F.col("a"), F.col("b")), text.same_name(F.col("a"), F.col("c"))).first()) == (True, False)


@pytest.mark.parametrize("reading,loan,want", [("とうきょう", False, "도쿄"), ("かふぇ", True, "카페"), ("らーめん", False, "라멘"), ("きっさ", False, "깃사"), ("おおさか", False, "오사카"), ("しんじゅく", False, "신주쿠"), ("うぃ", True, "위"), ("つきじ", False, "쓰키지"), ("ちゃや", False, "자야"), ("こちょう", False, "고초"), ("しぇふ", True, "셰후"), ("ふぁん", True, "판"), ("じゅーす", True, "주스"), ("てぃー", True, "티"), ("うぇすと", True, "웨스토"), ("をん", False, "온"), ("あっ", False, "아"), ("んあっか", False, "ㄴ앗카"), ("きゃく", False, "갸쿠"), ("ゔぁ", True, "바"), ("おう", False, "오"), ("xお", False, "x오")])
def test_kana_by_sound(reading, loan, want):
    assert kana.hangul_of(reading, loan) == want


def test_every_kana_has_a_syllable():
    for c in map(chr, range(0x3041, 0x3097)):
        if "SMALL" not in kana.unicodedata.name(c) and c not in "んゐゑ":
            assert "가" <= kana.hangul_of(c) <= "힣", c


def test_transliteration_keeps_what_it_cannot_read(spark):
    names = spark.createDataFrame([("ラーメン タロウ",), ("Bar・キツネ",), ("漢字",), (None,), ("ｶﾌｪ",), ("たろう店",), ("たろう本店",), ("きた駅",), ("ABC店 x",), ("plain",)], "s string")
    got = [r.x for r in names.select(kana.transliterate({"ラーメン": "라멘", "駅": "역"})(F.col("s")).alias("x")).collect()]
    assert got == ["라멘 타로", "Bar 키쓰네", "漢字", None, "카페", "다로점", "다로本店", "기타역", "ABC店 x", "plain"]


def test_templates_and_prices(spark):
    page = "{{eat| name=A [[x|y]] | price=¥1,200 or 900 yen }} mid {{EAT|name=B|lat=1}}"
    row = spark.createDataFrame([(page,)], "p string").select(F.transform(text.templates(F.col("p"), "eat"), text.template_fields).alias("t"), text.price_bucket(F.col("p")).alias("b")).first()
    assert row.t == [{"name": "A [[x|y]]", "price": "¥1,200 or 900 yen"}, {"name": "B", "lat": "1"}] and row.b == "low"


def plain_geohash(lat, lon, n):
    out, bits, code, even, la, lo = "", 0, 0, True, [-90.0, 90.0], [-180.0, 180.0]
    while len(out) < n:
        r, v = (lo, lon) if even else (la, lat)
        mid = sum(r) / 2
        code = code * 2 + (v >= mid)
        r[v < mid] = mid
        even, bits = not even, bits + 1
        if bits % 5 == 0:
            out += geo.BASE32[code]
            code = 0
    return out


def test_geohash_at_the_edges(spark):
    points = [(35.68, 139.76), (90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (-0.0001, -0.0001), (33.59, 130.4)]
    got = [r.g for r in spark.createDataFrame(points, "lat double, lon double").select(geo.geohash(F.col("lat"), F.col("lon"), 7).alias("g")).collect()]
    assert got == [plain_geohash(a, b, 7) for a, b in points]


def test_nearest_match_over_cell_edges(spark):
    left = spark.createDataFrame([("l", 35.0, 139.0009)], "l_id string, l_lat double, l_lon double")
    right = spark.createDataFrame([(1, 35.0, 139.00195)], "r_id int, r_lat double, r_lon double")  # 95.6 m to the east
    assert resolve.nearest_match(left, right).count() == 1
    far = spark.createDataFrame([(1, 35.0, 138.99985)], "r_id int, r_lat double, r_lon double")
    edge = spark.createDataFrame([("l", 35.0, 139.00094)], "l_id string, l_lat double, l_lon double")
    assert resolve.nearest_match(edge, far).count() == 1


def greedy(nodes, edges):
    kept, near = set(), {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in nodes:
        if not near[n] & kept:
            kept.add(n)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_removal_equals_a_pass_in_order(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)]
    n = spark.createDataFrame([(i, i) for i in nodes], "id long, rank long")
    e = spark.createDataFrame(edges, "a long, b long")
    got = {r.id for r in resolve.greedy_independent(n, e).collect() if r.kept}
    assert got == greedy(nodes, [(a, b) for a, b in edges if a != b])


def test_dedupe_keeps_both_ends_of_a_chain(spark):
    rows = [("a", "鳥吉", 33.59, 0.9, ["x"]), ("b", "鳥吉 本店", 33.5908, 0.8, ["y"]), ("c", "鳥吉", 33.5916, 0.7, ["z"])]
    df = spark.createDataFrame(rows, "id string, name string, lat double, popularity double, sources array<string>").withColumns({"lon": F.lit(130.4), "category": F.lit("bar"), "keys": text.name_keys(F.col("name"))})
    got = {r.id: r.sources for r in resolve.dedupe_nearby(df, richness=F.lit(1)).collect()}
    assert got == {"a": ["x", "y"], "c": ["z"]}


def test_outcomes(spark):
    shown = json.dumps([{"rank": 1, "place_id": "p"}, {"rank": 1, "place_id": "p"}, {"rank": 2, "place_id": "q"}])
    turns = spark.createDataFrame([("t", shown), ("u", "[]")], "turn_id string, candidates string")
    reactions = spark.createDataFrame([("t", "p", "select"), ("t", "p", "save"), (None, "q", "skip")], "turn_id string, place_id string, type string")
    got = {r.place_id: (r.selected, r.saved, r.skipped, r.opened) for r in logs.outcomes(turns, reactions).collect()}
    assert got == {"p": (True, True, False, False), "q": (False,) * 4}


def test_profile_state_machine():
    p = profile.Profile()
    for value in ("0.5", "2.0", "1.0"):
        p.intend({"max_distance_km": "9"})
        p.intend({"max_distance_km": value, "next_category": "bar"})
        p.choose("i", "meal", "noodle")
    assert p.evidence["max_distance_km"] == {"0.5": 1, "2.0": 1, "1.0": 1} and p.value("max_distance_km") == "1.0" and p.value("cuisine") == "noodle"
    assert p.evidence["after_meal"] == {"bar": 2} and p.value("after_meal") is None
    assert p.intend({"local": "true"}) == {"local": "true", "max_distance_km": "1.0"} and profile.Profile().intend({}) == {"max_distance_km": "1.0"}
    assert p.summary() == {"local": "open (0/3)", "max_distance_km": "1.0 (inferred)", "cuisine": "noodle (inferred)"}
    p.say("local", "True")
    p.observe("local", "false")
    assert p.value("local") == "True" and profile.Profile.load(p.dump()) == p


def test_top_list_explores_a_new_kind(spark):
    rows = [(f"i{n}", "x" if n < 9 else "y", 1 - n / 20, 0.1 * n, 0.5) for n in range(12)]
    df = spark.createDataFrame(rows, "id string, sub string, score double, dist_km double, content double")
    got = ranking.top_list(df).orderBy("rank").collect()
    assert [r.id for r in got[:7]] == [f"i{n}" for n in range(7)] and got[7].slot == "explore" and got[7].sub == "y"


def test_average_linkage():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((3, 12))
    curves = [(base[i % 3] + 0.01 * rng.standard_normal(12)).tolist() for i in range(12)]
    assert series.average_linkage(curves, 3) == [1, 2, 3] * 4


def test_rank_cuts_are_nearest_rank(spark):
    values = sorted(random.Random(3).choices(range(500), k=997))
    got = {r.q: r.value for r in ordered.nearest_rank(spark.createDataFrame([(v,) for v in values], "value int"), "value", [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    assert got == {q: values[min(996, int(q * 997))] for q in (0.0, 0.01, 0.5, 0.99, 1.0)}


def plain_linkage(curves, k):
    """Average linkage pair by pair."""
    d = 1 - np.corrcoef(np.asarray(curves))
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        _, i, j = min((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    label = [0] * len(d)
    for n, g in enumerate(sorted(groups, key=min), 1):
        for i in g:
            label[i] = n
    return label


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_average_linkage_equals_pairs(seed):
    curves = np.random.default_rng(seed).standard_normal((40, 12)).tolist()
    for k in (1, 2, 5, 17, 40):
        assert series.average_linkage(curves, k) == plain_linkage(curves, k)


def test_order_statistics_by_group_and_ties(spark):
    rng = random.Random(9)
    rows = [(g, float(rng.choice([0, 0, 0, rng.gauss(0, 5)]))) for g in "ab" for _ in range(301)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.low, r.mid) for r in ordered.interpolated(df, "v", {"low": 0.1, "mid": 0.5}, ["g"]).collect()}
    for g in "abc":
        own = [v for h, v in rows if h == g]
        assert got[g] == pytest.approx(tuple(np.quantile(own, [0.1, 0.5])))
    assert "d" not in got
    n = [(r.place, r.v) for r in ordered.numbered(df.where("v is not null"), ["v", "g"]).collect()]
    assert [v for _, v in sorted(n)] == sorted(v for _, v in rows if v is not None) and sorted(p for p, _ in n) == list(range(len(n)))
    totals = ordered.running_totals(df.where("v is not null").selectExpr("v", "1L AS one"), ["v"], ["one"]).collect()
    assert sorted(r.one_before for r in totals) == list(range(len(n)))
    assert ordered.interpolated(df.limit(0), "v", {"m": 0.5}).count() in (0, 1)


def test_neighbours_in_blocks(spark):
    x = np.random.default_rng(2).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole, cut = (sorted(map(tuple, evaluation.neighbours(df.where("vec_id < 9"), df, k=4, block_bytes=b).collect())) for b in (1 << 20, 200))
    assert whole == cut and len(whole) == 36


def test_neighbours_equal_brute_force(spark):
    x = np.random.default_rng(2).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in evaluation.neighbours(df.where("vec_id < 5"), df, k=4).orderBy("vec_id", "place").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        s = np.round(u @ u[q], 6)
        assert got[q] == [i for i in np.lexsort((np.arange(60), -s)) if i != q][:4]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"a","v":1}\n{"id":"b","v":2}\n{"id":"a","v":3}\n')
    path = str(tmp_path / "l.jsonl")
    assert {r.id: r.v for r in readers.json_lines_last(spark, path, "id string, v int", "id").collect()} == {"a": 3, "b": 2}
    assert {r.id: r.v for r in readers.json_lines_first(spark, path, "id string, v int", "id").collect()} == {"a": 1, "b": 2}
    (tmp_path / "x.csv").write_text("﻿id,name\n1,é\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "x.csv")).columns == ["id", "name"]
    (tmp_path / "p.xml").write_text("<d><page><title>A</title></page><page><title>B</title></page></d>")
    assert readers.xml_pages(spark, str(tmp_path / "p.xml")).count() == 2
    bad = spark.createDataFrame([('[{"id":"1","cat":"x"}]',), ("oops",)], "body string")
    assert readers.batch_results(bad, "id:string,cat:string").count() == 1
    objects = spark.createDataFrame([("n1", "node", {"amenity": "cafe", "name": "A"}, [[(1.0, 2.0), (3.0, 4.0)]]), ("n2", "node", {"x": "y"}, [[(1.0, 2.0)]])], "osm_id string, kind string, tags map<string,string>, rings array<array<struct<lat:double,lon:double>>>")
    assert [(r.lat, r.lon, r.name) for r in readers.map_objects(objects, ["amenity"]).collect()] == [(2.0, 3.0, {"name": "A"})]
    writers.parquet(bad, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_export_replays_without_doubles(spark, tmp_path):
    schema = "id long, created_at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"created_at":"2024-01-01T23:59:59Z"}\n{"id":2,"created_at":"2024-01-02T00:00:01Z"}\n')
    for _ in range(2):
        jobs.run_to_end(lambda: jobs.export_by_day(jobs.log_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")))
    rows = spark.read.json(str(tmp_path / "out"))
    assert {(r.id, str(r.date)) for r in rows.collect()} == {(1, "2024-01-01"), (2, "2024-01-02")} and rows.count() == 2
    young = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:09:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
    assert [r.id for r in jobs.settled(young, None, "2024-01-01 00:10:00").collect()] == [1]


def test_stage_runner(spark, tmp_path):
    stages = [Stage("a", lambda s, i: s.range(3)), Stage("b", lambda s, i: i["a"].selectExpr("id * 2 AS id"), ["a"]), Stage("c", lambda s, i: s.range(1), tags=frozenset({"paid"}))]
    runner = Runner(spark, str(tmp_path), stages)
    assert [s.name for s in runner.expand(["b"])] == ["a", "b"] and runner.run(["b"])["b"]["state"] == "run"
    assert runner.run(["b"])["b"]["state"] == "skipped" and runner.status()["c"] == "missing"
    with pytest.raises(PermissionError):
        runner.run(["c"])
    first = runner.save_manifest(str(tmp_path / "manifest.json"))
    assert json.loads((tmp_path / "manifest.json").read_text()) == first
    runner.run(["a"], force=True)
    assert Runner.compare(first, runner.manifest()) == {"a": "same", "b": "same"}
    with pytest.raises(ValueError):
        Runner(spark, "x", [Stage("b", stages[1].build, ["a"])])


def test_label_helpers(spark):
    rows = spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("k", "y", 3), ("k", "x", 4), ("z", "x", 5)], "key string, value string, seq int")
    assert {r.key: r.value for r in labels.mode(rows, "key", "value", "seq").collect()} == {"k": "x", "z": "x"}
    assert labels.majority(rows, "key", "value").count() == 0
    assert {r.key: r.labels for r in labels.share_labels(rows, "key", "value").collect()} == {"k": ["x", "y"], "z": ["x"]}


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_simulated_walks_don_t_depend_on_tasks(spark):
    from locusflow.operators import simulate

    rng = np.random.default_rng(1)
    rows = [(f"i{n}", ("meal", "bar")[n % 2], f"s{n % 7}", 35 + float(rng.uniform(-0.01, 0.01)), 139 + float(rng.uniform(-0.01, 0.01)), float(rng.uniform())) for n in range(300)]
    items = spark.createDataFrame(rows, "id string, category string, sub string, lat double, lon double, popularity double")
    s = simulate.Settings(plan=("meal", "bar") * 6)
    got = simulate.simulate(items, 6, settings=s).collect()
    assert len(got) == 6 * 4 * 12
    table = items.orderBy("id").toPandas()
    catalogue = simulate._Catalogue(*(table[c].to_numpy() for c in ("id", "category", "sub", "lat", "lon", "popularity")))
    kinds = sorted(set(zip(catalogue.category, catalogue.sub, strict=True)))

    def start(seed):
        at = simulate.begin(kinds, 300, seed, s)[2]
        return catalogue.lat[at], catalogue.lon[at]

    want = sorted(t for p in simulate.POLICIES for seed in range(6) for t in simulate.walk(catalogue, start(seed), kinds, 300, p, seed, s))
    assert sorted(tuple(r) for r in got) == want
    success = {p: sum(t[4] for t in want if t[0] == p) for p in simulate.POLICIES}
    assert success["learned"] >= success["fixed"] - 3
