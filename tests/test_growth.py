"""Results that hold however rows are dealt out, and work that grows with what is found."""

import random

import pytest
from pyspark.sql import functions as F

from locusflow.functions import text
from locusflow.operators import build, resolve
from locusflow.plans import place_queries, service_queries

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def one_after_the_other(rows, position):
    """(actor, sub) -> (a, b), added in order of event."""
    sums = {}
    for n, user, kind, k in sorted(rows):
        a, b = sums.get((user, f"sub{k % 12}"), (0.0, 0.0))
        a += {"purchase": 1.0, "signup": 0.7, "click": 0.3}.get(kind, 0.0)
        b += 0.3 / (1 + (k % 8 if position else 0)) if kind == "error" else 0.0
        sums[user, f"sub{k % 12}"] = a, b
    return {key: (1.0 + a, 1.0 + b) for key, (a, b) in sums.items()}


def strongest(sums):
    out = {}
    for (user, sub), (a, b) in sums.items():
        out.setdefault(user, []).append((-(a / (a + b)), -(a + b), sub))
    return {user: [x[2] for x in sorted(rows)[:5]] for user, rows in out.items()}


@pytest.mark.parametrize(("query", "position"), [(service_queries.preference_lines, False), (place_queries.strongest_preferences, True)])
def test_preferences_of_equal_share_don_t_depend_on_files(spark, tmp_path, query, position):
    """Weights are added in order of event, so shares that differ in the last digit only come in one order."""
    rng = random.Random(5)
    rows = [(n, n % 600, rng.choice(("purchase", "signup", "click", "error")), rng.randrange(96)) for n in range(36000)]
    dealt = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(n, None, u, t, 1.0, f'{{"k": {k}}}') for n, u, t, k in dealt], EVENTS)
    df.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    got = {}
    for r in query(spark, str(tmp_path)).collect():
        got.setdefault(r.actor, {})[r.place] = (r.sub if position else r.line.split()[0])
    assert {u: [x[p] for p in sorted(x)] for u, x in got.items()} == strongest(one_after_the_other(rows, position))


@pytest.mark.parametrize("most", [1, 2, 3, 15])
def test_chains_of_parents_equal_plain_ones(spark, most):
    """Several parents, a cycle, a null parent and chains longer than the bound."""
    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("c", "root"), ("x", "y"), ("y", "x"), ("z", "x"), ("q", None), ("root", "top"), *((f"l{i}", f"l{i + 1}") for i in range(20)), ("l20", "root")]
    up = {}
    for a, b in pairs:
        up.setdefault(a, []).append(b)

    def plain(start):
        level, depth, seen = up[start], 0, []
        while level and depth < most:
            depth, seen, level = depth + 1, seen + level, list({p for x in level for p in up.get(x, [])})
        known = [x == "root" for x in seen if x is not None]
        return depth, any(known) if known else None

    got = {r.start: (r.depth, r.inside) for r in build.below(spark.createDataFrame(pairs, "start string, up string"), "root", most).collect()}
    assert got == {a: plain(a) for a in up}


def test_a_chain_of_many_starts_has_no_bound_of_rows(spark, tmp_path):
    """More rows on the way than a recursive query may make (a million by default)."""
    spark.createDataFrame([(0, 1)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1,)], "r_regionkey int").write.parquet(str(tmp_path / "region.parquet"))
    spark.range(400_000).selectExpr("id AS c_custkey", "0 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = place_queries.parent_chain(spark, str(tmp_path)).groupBy("depth", "inside").count().collect()
    assert {(r.depth, r.inside, r["count"]) for r in got} == {(3, True, 400_000), (2, True, 1), (1, False, 1)}


def named_places(spark, seed, n=160):
    """Places about the date line whose keys hold one another in many ways; some without a key or a place."""
    rng = random.Random(seed)
    keys = lambda: rng.choice([None, [], ["ab"], ["abc", "bc"], ["c", "abcd"], ["x", "xab"], *([["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))] for _ in range(8)])])
    rows = [(f"i{i}", rng.choice("uv"), None if i == 7 else 10 + rng.uniform(-0.01, 0.01), (180 + rng.uniform(-0.01, 0.01) + 180) % 360 - 180, keys()) for i in range(n)]
    return spark.createDataFrame(rows, "id string, category string, lat double, lon double, keys array<string>")


@pytest.mark.parametrize("seed", [1, 2])
def test_doubles_by_keys_equal_doubles_by_pairs(spark, seed):
    items = named_places(spark, seed)
    for within in ("category", None):
        plain = resolve.near_doubles(items, km=0.5, same=text.same_name(F.col("l_keys"), F.col("r_keys")), within=within)
        got = [tuple(r) for r in resolve.near_doubles(items, km=0.5, within=within).collect()]
        assert sorted(got) == sorted(tuple(r) for r in plain.collect()) and len(got) > 100


def joined_on(df, key):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and line.count(key) >= 2 and " = " in line]


def test_doubles_meet_by_name_and_cell(spark):
    """Places of other names in a cell aren't compared: names are a key of the join."""
    assert joined_on(resolve.near_doubles(named_places(spark, 3)), "_key#")


def points(rng, n, side, spread=0.006):
    """Most in a dense spot, some far apart, over the date line; equal places give equal distances."""
    at = lambda: rng.choice((rng.uniform(-spread, spread), round(rng.uniform(-spread, spread), 3), rng.uniform(-spread, spread) / 30))
    return [(i, 20 + at(), (180 + at() + 180) % 360 - 180, rng.choice(("ab", "abc", "bc", "x", "cx", "q"))) for i in range(n)]


@pytest.mark.parametrize("names", [False, True])
def test_nearest_by_rungs_equals_nearest_of_all(spark, monkeypatch, names):
    """Who finds something near by doesn't search further, and the nearest stays the nearest."""
    rng = random.Random(9)
    left = spark.createDataFrame(points(rng, 150, "l"), "l_id int, l_lat double, l_lon double, l_k string").withColumn("l_keys", F.array("l_k", F.lit("zz")))
    right = spark.createDataFrame(points(rng, 200, "r"), "r_id int, r_lat double, r_lon double, r_k string").withColumn("r_keys", F.array("r_k"))
    same = F.col("l_id") % 5 == F.col("r_id") % 5
    call = {"same": same, "names": True} if names else {"same": same}
    plain = resolve.within_cells(left, right, 0.7).withColumn("d", resolve.geo.flat_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where("d <= 700").where(same)
    plain = plain.where(text.same_name(F.col("l_keys"), F.col("r_keys"))) if names else plain
    want = {}
    for r in plain.collect():
        want[r.l_id] = min(want.get(r.l_id, (9e9, 0)), (r.d, r.r_id))
    monkeypatch.setattr(resolve, "LEAST_PAIRS", 0)
    monkeypatch.setattr(resolve, "AIM", 0.05)
    on = ("_key",) if names else ()
    assert names or len(resolve._rungs(left, right, 700.0, on)) > 2
    got = [(r.l_id, (r.dist_m, r.r_id)) for r in resolve.nearest_match(left, right, metres=700.0, **call).collect()]
    assert len(got) == len(want) > 100 and dict(got) == want


def test_near_rows_are_searched_near_by_first(spark, monkeypatch):
    """A hundred thousand pairs within reach are not all met: names are keys, and the search widens from a small radius."""
    rows = [(i, 10 + (i % 40) * 1e-4, 20 + (i // 40) * 1e-4) for i in range(400)]
    left = spark.createDataFrame(rows, "l_id int, l_lat double, l_lon double").withColumn("l_keys", F.array(F.lit("ab")))
    right = spark.createDataFrame(rows, "r_id int, r_lat double, r_lon double").withColumn("r_keys", F.array(F.lit("abc")))
    monkeypatch.setattr(resolve, "LEAST_PAIRS", 1000)
    searched, plain = [], resolve.within_cells
    monkeypatch.setattr(resolve, "within_cells", lambda a, b, km, on=(): searched.append((km, on, plain(a, b, km, on).count())) or plain(a, b, km, on))
    got = resolve.nearest_match(left, right, metres=900.0, names=True).collect()
    assert sorted((r.l_id, r.r_id) for r in got) == [(i, i) for i in range(400)]
    assert searched[0][0] < 0.9 and all(on == ("_key",) for _, on, _ in searched) and sum(n for *_, n in searched) < 400 * 400


@pytest.mark.parametrize("seed", [4, 5])
def test_removal_by_keys_equals_a_pass_over_all_pairs(spark, seed):
    items = named_places(spark, seed).withColumns({"popularity": F.lit(0.5), "sources": F.array(F.concat(F.lit("s"), F.substring("id", 2, 3)))})
    pairs = resolve.near_doubles(items, km=0.5, same=text.same_name(F.col("l_keys"), F.col("r_keys"))).collect()
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(r.id for r in items.collect()):
        taker = min(near.get(i, set()) & set(want), default=None)
        want.setdefault(taker or i, []).append(f"s{i[1:]}")
    plan = resolve.dedupe_nearby(items, richness=F.lit(1), km=0.5)
    assert {r.id: r.sources for r in plan.collect()} == {i: sorted(x) for i, x in want.items()}


def test_a_walker_holds_what_lies_about_it_only(spark, monkeypatch):
    """A turn's task gets the places of its category within the widest radius, not all that the walk could reach."""
    from locusflow.operators import simulate

    rows = [(f"i{n}", ("meal", "bar")[n % 2], f"s{n % 5}", 35 + (n % 60) * 0.002, 139 + (n // 60) * 0.002, n % 97 / 97) for n in range(3600)]
    items = spark.createDataFrame(rows, "id string, category string, sub string, lat double, lon double, popularity double")
    s = simulate.Settings(plan=("meal", "bar") * 3, radii=(0.5, 1.0))
    met, plain = [], simulate.within_cells

    def within(left, right, km):
        out = plain(left, right, km)
        met.append((km, right.select("category").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(simulate, "within_cells", within)
    got = simulate.simulate(items, 3, settings=s).collect()
    assert len(got) == 3 * 4 * 6 and len(met) == 6
    assert all(km < 1.1 and kinds == 1 and n < 12 * 300 for km, kinds, n in met)  # some 200 of 1,800 lie in a walker's cells


def test_walks_over_a_wide_catalogue_equal_single_ones(spark):
    from locusflow.operators import simulate

    rng = random.Random(2)
    rows = [(f"i{n}", ("meal", "bar")[n % 2], f"s{n % 7}", 35 + rng.uniform(-0.1, 0.1), 139 + rng.uniform(-0.1, 0.1), rng.random()) for n in range(1500)]
    items = spark.createDataFrame(rows, "id string, category string, sub string, lat double, lon double, popularity double")
    s = simulate.Settings(plan=("meal", "bar", "walk") * 3)
    table = items.orderBy("id").toPandas()
    catalogue = simulate._Catalogue(*(table[c].to_numpy() for c in ("id", "category", "sub", "lat", "lon", "popularity")))
    kinds = sorted(set(zip(catalogue.category, catalogue.sub, strict=True)))
    want = []
    for seed in range(4):
        at = simulate.begin(kinds, 1500, seed, s)[2]
        want += [t for p in simulate.POLICIES for t in simulate.walk(catalogue, (catalogue.lat[at], catalogue.lon[at]), kinds, 1500, p, seed, s)]
    assert sorted((tuple(r) for r in simulate.simulate(items, 4, settings=s).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("seed", "per"), [(6, 1024), (7, 5)])
def test_lists_from_contenders_equal_lists_of_all(spark, monkeypatch, seed, per):
    """Equal scores, distances and chances, users with few places about them, a null kind, and users over several tasks."""
    from locusflow.operators import ranking, shortlist

    monkeypatch.setattr(shortlist, "USERS", per)
    rng = random.Random(seed)
    at = lambda: rng.choice((rng.uniform(-0.02, 0.02), round(rng.uniform(-0.02, 0.02), 3)))
    places = spark.createDataFrame([(f"p{i}", rng.choice((*"abcde", None)), rng.choice((0.1, 0.5, 0.501, rng.random())), rng.randrange(40), 40 + at(), (180 + at() + 180) % 360 - 180) for i in range(1500)], "id string, sub string, popularity double, lot long, r_lat double, r_lon double")
    people = [(u, 40 + at() * (40 if u % 9 == 0 else 1), (180 + at() + 180) % 360 - 180, rng.choice((0.0, 0.3, 0.95)), [*"abc"], [rng.random(), 0.5, 0.9]) for u in range(40)]
    users = spark.createDataFrame([*people, (99, None, 180.0, 0.5, None, None)], "user int, l_lat double, l_lon double, w double, _subs array<string>, _tastes array<double>")

    def listed(near):
        near = near.withColumn("dist_km", resolve.geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where("dist_km <= 2")
        near = near.join(users.select("user", F.map_from_arrays("_subs", "_tastes").alias("_m")), "user")
        rows = ranking.scored(near, radius=F.lit(2.0), w=F.col("w"), content=F.coalesce(F.try_element_at("_m", F.coalesce("sub", F.lit(""))), F.lit(0.5)))
        return sorted((r.user, r["rank"], r.id, r.slot) for r in ranking.top_list(rows.drop("_m"), by=["user"], chance=F.col("lot") / 40).collect())

    few = shortlist.contenders(users, places, user="user", km=2.0, chance=F.col("lot"))
    all_ = resolve.within_cells(users.drop("_subs", "_tastes"), places, 2.0)
    want = listed(all_)
    assert listed(few) == want and len(want) > 250
    assert few.count() < all_.count() / 4 and few.groupBy("user").count().agg({"count": "max"}).first()[0] < 200  # what the ranking sees
