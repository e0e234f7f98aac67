"""Candidate, ranking and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import candidates as c
from ..operators import build, ranking, resolve, shortlist
from ..operators.candidates import Constraints, Context
from ..sources import layout
from .registry import query, table
from .tables import EVENTS_SQL, HERE, ITEMS_SQL, SAME_SQL, TAXONOMY, catalogue, events, items, km_sql, m_sql

LAT, LON = HERE
_D = km_sql(str(LAT), str(LON), "lat", "lon")
_BOX = f"lat BETWEEN {LAT} - {{km}} / 110.0 AND {LAT} + {{km}} / 110.0 AND lon BETWEEN {LON} - {{km}} / 110.0 / greatest(0.2, cos(radians({LAT}))) AND {LON} + {{km}} / 110.0 / greatest(0.2, cos(radians({LAT})))"
AT = Context(LAT, LON)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", F.round("dist_km", 6).alias("dist_km"), "popularity")


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items WHERE {_BOX.format(km=3.0)}) SELECT id, name, round(dist, 6) AS dist_km, popularity FROM d WHERE category = 'meal' AND dist <= 3")
def nearby_meals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(c.candidates(catalogue(spark, sf_dir), Constraints("meal", max_distance_km=3.0), AT, TAXONOMY))


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items) SELECT id, name, round(dist, 6) AS dist_km, round(0.6 * popularity + 0.4 * 0.5 - 0.1 * dist / 3.0, 3) AS score, row_number() OVER (ORDER BY round(0.6 * popularity + 0.4 * 0.5 - 0.1 * dist / 3.0, 3) DESC, dist, id) AS rank FROM d WHERE category = 'meal' AND dist <= 3 ORDER BY rank LIMIT 8")
def nearest_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: eight best meals within three kilometres by blended score."""
    pool = c.candidates(catalogue(spark, sf_dir), Constraints("meal", max_distance_km=3.0), AT, TAXONOMY)
    rows = ranking.scored(pool, radius=F.lit(3.0), w=F.lit(0.4), content=F.lit(0.5))
    best = rows.orderBy(F.desc("score"), "dist_km", "id").limit(8)
    from pyspark.sql import Window

    return best.select("id", "name", F.round("dist_km", 6).alias("dist_km"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "dist_km", "id")).cast("long").alias("rank"))


_PASS = [
    ("all", "true"),
    ("category", "category = 'meal'"),
    ("include", "(coalesce(cuisine IN ('c1'), false) OR coalesce(list_has_any(fine, ['f1', 'f2', 'f3']), false))"),
    ("exclude", "NOT (coalesce(list_has_any(fine, ['f4', 'f5']), false) OR coalesce(broad IN ('b0'), false))"),
    ("distance", "dist <= 5"),
]
_TRACE = " UNION ALL ".join(f"SELECT {n} AS step, '{name}' AS rule, count(*) FILTER (WHERE {' AND '.join(p for _, p in _PASS[: n + 1])}) AS n_left FROM {'d' if n else 'items'}" for n, (name, _) in enumerate(_PASS))


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items WHERE {_BOX.format(km=5.0)}) {_TRACE}")
def rule_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = Constraints("meal", include_sub=["noodles", "skewers"], exclude_sub=["pubs"], max_distance_km=5.0)
    return c.trace(catalogue(spark, sf_dir), asked, AT, TAXONOMY)


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items) SELECT id, name, round(dist, 6) AS dist_km, popularity FROM d WHERE category = 'bar' AND dist <= 5 AND (coalesce(list_has_any(fine, ['f1', 'f2', 'f3']), false) OR contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'bolt'))")
def include_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping kinds, and an unknown word looked for in names."""
    return _shown(c.candidates(catalogue(spark, sf_dir), Constraints("bar", include_sub=["Skewers", "bolt"], max_distance_km=5.0), AT, TAXONOMY))


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items) SELECT id, name, round(dist, 6) AS dist_km, popularity FROM d WHERE category = 'bar' AND dist <= 5 AND NOT (coalesce(list_has_any(fine, ['f1', 'f2', 'f3']), false) OR coalesce(cuisine IN ('c1'), false))")
def exclude_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(c.candidates(catalogue(spark, sf_dir), Constraints("bar", exclude_sub=["skewers", "noodles"], max_distance_km=5.0), AT, TAXONOMY))


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items) SELECT id, name, round(dist, 6) AS dist_km, popularity FROM d WHERE category IN ('sight', 'walk', 'shop', 'rest') AND dist <= 5 AND cuisine IS NULL AND sub = 'sub3'")
def include_attraction_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(c.candidates(catalogue(spark, sf_dir), Constraints(include_sub=["Garden"], max_distance_km=5.0), AT, TAXONOMY))


_ATTR = "category IN ('sight', 'walk', 'shop', 'rest')"
_THEMES_SQL = {"famous": "popularity >= 0.6", "local": "local > 0", "known": "known > 0", "hidden": "hidden > 0", "season": "season[4] >= 1.3"}


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items) " + " UNION ALL ".join(f"SELECT '{t}' AS theme, count(*) AS n, round(sum(dist), 4) AS km FROM d WHERE {_ATTR} AND {p} AND dist <= 10" for t, p in _THEMES_SQL.items()))
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for t in _THEMES_SQL:
        rows = c.candidates(catalogue(spark, sf_dir), Constraints(theme=t, month=4, max_distance_km=10.0), AT, TAXONOMY)
        parts.append(rows.agg(F.lit(t).alias("theme"), F.count("*").alias("n"), F.round(F.sum("dist_km"), 4).alias("km")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {ITEMS_SQL} SELECT id, round(popularity, 6) AS famous, round(least(1.0, 0.5 + local / 4), 6) AS local_score, round(least(1.0, 0.3 + (season[7] - 1) / 2), 6) AS season_score FROM items WHERE {_ATTR}")
def theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = {k: c.THEMES[k][1](7) for k in ("famous", "local", "season")}
    return items(spark, sf_dir).where(F.col("category").isin(*c.ATTRACTIONS)).select("id", F.round(score["famous"], 6).alias("famous"), F.round(score["local"], 6).alias("local_score"), F.round(score["season"], 6).alias("season_score"))


@query(f"WITH {ITEMS_SQL} SELECT id, name, brand FROM items WHERE category = 'shop' AND contains(regexp_replace(lower(name || brand), '[^a-z0-9]', '', 'g'), 'brand7')")
def brand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.candidates(items(spark, sf_dir), Constraints("shop", include_brand=["Brand #7"]), Context(), TAXONOMY).select("id", "name", "brand")


@query(f"WITH {ITEMS_SQL} SELECT id, CAST(NULL AS DOUBLE) AS dist_km FROM items WHERE category = 'walk' AND popularity < 0.6")
def local_without_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No location: no distance rule, and distances are null."""
    return c.candidates(items(spark, sf_dir), Constraints("walk", local=True), Context(), TAXONOMY).select("id", "dist_km")


_SEEN = "('p3', 'p10', 'p77', 'p150')"


@query(f"""WITH {ITEMS_SQL}, v AS (SELECT * FROM items WHERE id IN {_SEEN}), d AS (SELECT *, {_D} AS dist FROM items)
SELECT id, name, round(dist, 6) AS dist_km, popularity FROM d WHERE {_ATTR} AND dist <= 15 AND id NOT IN {_SEEN}
AND NOT EXISTS (SELECT 1 FROM v WHERE {km_sql('v.lat', 'v.lon', 'd.lat', 'd.lon')} <= 0.1 AND {SAME_SQL.format(a="regexp_replace(v.name, '[^a-z0-9]', '', 'g')", b="regexp_replace(d.name, '[^a-z0-9]', '', 'g')")})""")
def visited_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Context(LAT, LON, ["p3", "p10", "p77", "p150"])
    return _shown(c.candidates(catalogue(spark, sf_dir), Constraints(max_distance_km=15.0), at, TAXONOMY))


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items WHERE category = 'cafe' AND cuisine = 'c2'),
n AS (SELECT count(*) FILTER (WHERE dist <= 1) AS a, count(*) FILTER (WHERE dist <= 2) AS b, count(*) FILTER (WHERE dist <= 5) AS e FROM d),
r AS (SELECT CASE WHEN a >= 8 THEN 1.0::DOUBLE WHEN b >= 8 THEN 2.0::DOUBLE WHEN e >= 8 THEN 5.0::DOUBLE ELSE 15.0::DOUBLE END AS radius_km FROM n)
SELECT id, round(dist, 6) AS dist_km, radius_km FROM d, r WHERE dist <= radius_km""")
def radius_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least radius with eight candidates, from one pass."""
    pool = c.place(catalogue(spark, sf_dir).where("category = 'cafe' and cuisine = 'c2'"), AT)
    return c.widened(pool, c.ladder(1.0)).select("id", F.round("dist_km", 6).alias("dist_km"), "radius_km")


@query(f"WITH {ITEMS_SQL} SELECT count(*) > 0 AS inside FROM items WHERE {_BOX.format(km=30.0)}")
def service_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.in_service_area(catalogue(spark, sf_dir), LAT, LON)


@query(f"WITH {ITEMS_SQL}, d AS (SELECT *, {_D} AS dist FROM items) SELECT id, round(dist, 6) AS dist_km FROM d ORDER BY dist, id LIMIT 20")
def nearest_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest_first(c.place(items(spark, sf_dir), AT)).select("id", F.round("dist_km", 6).alias("dist_km"))


_PREF = f"""{EVENTS_SQL}, pref AS (SELECT actor, sub, 1.0::DOUBLE + sum(CASE type WHEN 'select' THEN 1.0 WHEN 'save' THEN 0.7 WHEN 'detail' THEN 0.3 ELSE 0 END::DOUBLE) AS a,
 1.0::DOUBLE + sum(CASE WHEN type = 'skip' THEN 0.3::DOUBLE / (1 + k % 8) ELSE 0::DOUBLE END) AS b FROM ev WHERE type IN ('select', 'save', 'detail', 'skip') GROUP BY ALL)"""


@query(f"WITH {_PREF} SELECT actor, sub, round(a, 4) AS a, round(b, 4) AS b FROM pref")
def learned_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("position", F.col("k") % 8)
    return ranking.preferences(rows, user="actor", position="position").select("actor", "sub", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"WITH {EVENTS_SQL} SELECT actor, count(*) FILTER (WHERE type <> 'view') AS n_reactions, round(count(*) FILTER (WHERE type <> 'view') / (count(*) FILTER (WHERE type <> 'view') + 5.0), 6) AS w FROM ev GROUP BY actor")
def reaction_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reactions(events(spark, sf_dir), user="actor").select("actor", "n_reactions", F.round("w", 6).alias("w"))


_TOP = f"""WITH {ITEMS_SQL}, {_PREF}, u AS (SELECT DISTINCT actor, 34.9 + ((actor * 6007) % 20011) * 0.00001::DOUBLE AS u_lat, 138.9 + ((actor * 8081) % 20021) * 0.00001::DOUBLE AS u_lon FROM ev),
w AS (SELECT actor, count(*) FILTER (WHERE type <> 'view') / (count(*) FILTER (WHERE type <> 'view') + 5.0::DOUBLE) AS w FROM ev GROUP BY actor),
d AS (SELECT u.actor, i.*, {km_sql('u_lat', 'u_lon', 'lat', 'lon')} AS dist FROM items i, u WHERE category = 'meal'),
s AS (SELECT d.actor, d.id, d.n, d.sub, d.dist, round(coalesce(a / (a + b), 0.5), 6) AS content, w.w, popularity FROM d JOIN w USING (actor) LEFT JOIN pref USING (actor, sub) WHERE dist <= 2),
r AS (SELECT *, round((1 - w) * popularity + w * content - 0.1 * dist / 2.0, 3) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY score DESC, dist, id) AS rank FROM r),
top AS (SELECT actor, sub FROM k WHERE rank < 8),
x AS (SELECT k.*, row_number() OVER (PARTITION BY actor ORDER BY (NOT EXISTS (SELECT 1 FROM top WHERE top.actor = k.actor AND top.sub = k.sub)) DESC, content + 0.3 * ((n * 1103515 + 12345) % 1000003 / 1000003.0) DESC, id) AS pick FROM k WHERE rank >= 8)
SELECT actor, id, CAST(rank AS INT) AS rank, 'top' AS slot, score FROM k WHERE rank < 8 UNION ALL SELECT actor, id, 8, 'explore', score FROM x WHERE pick = 1"""


@query(_TOP)
def personal_top_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight for every user within two kilometres of where they are, the last to explore; items meet users by cell, and only those that can be on a list are ranked."""
    ev = events(spark, sf_dir).withColumn("position", F.col("k") % 8)
    prefs = resolve.checkpointed(ranking.preferences(ev, user="actor", position="position"))
    content = F.round(F.coalesce(F.col("a") / (F.col("a") + F.col("b")), F.lit(0.5)), 6)
    weights = ranking.reactions(ev, user="actor").select("actor", "w")
    tastes = prefs.groupBy("actor").agg(F.collect_list(F.struct("sub", content.alias("content"))).alias("_t")).select("actor", F.col("_t.sub").alias("_subs"), F.col("_t.content").alias("_tastes"))
    n = F.col("actor")
    users = weights.withColumns({"l_lat": F.lit(34.9) + n * 6007 % 20011 * F.lit(0.00001), "l_lon": F.lit(138.9) + n * 8081 % 20021 * F.lit(0.00001)}).join(tastes, "actor", "left")
    food = items(spark, sf_dir).where("category = 'meal'").select("id", "n", "sub", "popularity", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = shortlist.contenders(users, food, user="actor", km=2.0, chance=F.round(ranking.uniform(F.col("n")) * 1000003).cast("bigint"))
    near = near.withColumn("dist_km", geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where("dist_km <= 2")
    rows = ranking.scored(near.join(prefs, ["actor", "sub"], "left"), radius=F.lit(2.0), w=F.col("w"), content=content)
    return ranking.top_list(rows, by=["actor"], chance=ranking.uniform(F.col("n"))).select("actor", "id", F.col("rank").cast("int").alias("rank"), "slot", "score")


@query(f"WITH {_PREF}, k AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY a / (a + b) DESC, a + b DESC, sub) AS place FROM pref) SELECT actor, CAST(place AS INT) AS place, sub, round(a / (a + b), 4) AS share FROM k WHERE place <= 5")
def strongest_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    prefs = ranking.preferences(events(spark, sf_dir).withColumn("position", F.col("k") % 8), user="actor", position="position", order=["event_id"])
    share = F.col("a") / (F.col("a") + F.col("b"))
    place = F.row_number().over(Window.partitionBy("actor").orderBy(F.desc(share), F.desc(F.col("a") + F.col("b")), "sub"))
    return prefs.withColumn("place", place).where("place <= 5").select("actor", "place", "sub", F.round(share, 4).alias("share"))


_SUP = "sup AS (SELECT s_suppkey AS r_id, 34.9 + ((s_suppkey * 6007) % 20011) * 0.00001::DOUBLE AS r_lat, 138.9 + ((s_suppkey * 8081) % 20021) * 0.00001::DOUBLE AS r_lon, s_nationkey AS r_kind FROM supplier)"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(n.alias("r_id"), (F.lit(34.9) + n * 6007 % 20011 * F.lit(0.00001)).alias("r_lat"), (F.lit(138.9) + n * 8081 % 20021 * F.lit(0.00001)).alias("r_lon"), F.col("s_nationkey").alias("r_kind"))


_NEAR = m_sql("lat", "lon", "r_lat", "r_lon")


@query(f"WITH {ITEMS_SQL}, {_SUP}, p AS (SELECT id, r_id, {_NEAR} AS m FROM items, sup WHERE p_size % 3 = r_kind % 3), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, r_id) AS place FROM p WHERE m <= 800) SELECT id, r_id, round(m, 3) AS dist_m FROM k WHERE place = 1")
def nearest_directory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest matching entry within 800 metres, over cells."""
    left = items(spark, sf_dir).select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), "p_size")
    found = resolve.nearest_match(left, _suppliers(spark, sf_dir), metres=800.0, same=F.col("p_size") % 3 == F.col("r_kind") % 3)
    return found.select(F.col("l_id").alias("id"), "r_id", F.round("dist_m", 3).alias("dist_m"))


@query(f"WITH {ITEMS_SQL}, {_SUP}, p AS (SELECT id, r_id, {_NEAR} AS m FROM items, sup WHERE abs(trunc(lat / 0.001) - trunc(r_lat / 0.001)) <= 1 AND abs(trunc(lon / 0.001) - trunc(r_lon / 0.001)) <= 1), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, r_id) AS place FROM p WHERE m <= 100) SELECT id, r_id, round(m, 3) AS dist_m FROM k WHERE place = 1")
def nearest_directory_match_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = items(spark, sf_dir).select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    return resolve.nearest_match(left, _suppliers(spark, sf_dir), compat=True).select(F.col("l_id").alias("id"), "r_id", F.round("dist_m", 3).alias("dist_m"))


@query(f"WITH {ITEMS_SQL}, {_SUP} SELECT count(DISTINCT id) AS n FROM items, sup WHERE abs(floor(lat / 0.005) - floor(r_lat / 0.005)) <= 1 AND abs(floor(lon / 0.005) - floor(r_lon / 0.005)) <= 1")
def near_any_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = items(spark, sf_dir).select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    return resolve.near_any(left, _suppliers(spark, sf_dir), 0.005).agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS_SQL} SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id < b.id AND a.category = b.category AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.5
AND {SAME_SQL.format(a="regexp_replace(a.name, '[^a-z0-9]', '', 'g')", b="regexp_replace(b.name, '[^a-z0-9]', '', 'g')")}""")
def near_double_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.near_doubles(items(spark, sf_dir), km=0.5)


_SAME_NAMES = SAME_SQL.format(a="regexp_replace(a.name, '[^a-z0-9]', '', 'g')", b="regexp_replace(b.name, '[^a-z0-9]', '', 'g')")


@query(f"""WITH RECURSIVE {ITEMS_SQL}, pr AS (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id <> b.id AND a.category = b.category AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.5 AND {_SAME_NAMES}),
met AS (SELECT id, row_number() OVER (ORDER BY popularity DESC, coalesce(len(fine), -1) DESC, id) AS rn FROM items WHERE id IN (SELECT a FROM pr)),
adj AS (SELECT a AS id, list(b) AS near FROM pr GROUP BY a), nodes AS (SELECT met.id, rn, near FROM met JOIN adj USING (id)),
g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL SELECT rn, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, id) END FROM g JOIN nodes ON rn = i + 1),
k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)), fell AS (SELECT id FROM met WHERE id NOT IN (SELECT id FROM k)),
own AS (SELECT fell.id AS gone, arg_min(pr.b, met.rn) AS taker FROM fell JOIN pr ON pr.a = fell.id JOIN k ON k.id = pr.b JOIN met ON met.id = pr.b GROUP BY fell.id),
src AS (SELECT id, unnest(['map', 's' || (n % 3)]) AS s FROM items), allof AS (SELECT id, s FROM src UNION SELECT own.taker, src.s FROM own JOIN src ON src.id = own.gone)
SELECT id, list(s ORDER BY s) AS sources FROM allof WHERE id NOT IN (SELECT id FROM fell) GROUP BY id""")
def without_near_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy removal, as a pass in order of richness would."""
    return resolve.dedupe_nearby(items(spark, sf_dir), richness=F.coalesce(F.size("fine"), F.lit(-1)), km=0.5).select("id", "sources")


_HASH_SQL = "'0123456789bcdefghjkmnpqrstuvwxyz'"
_X, _Y = "least(floor((lon + 180.0) / 360.0 * 32768)::BIGINT, 32767)", "least(floor((lat + 90.0) / 180.0 * 32768)::BIGINT, 32767)"
_GEO = " || ".join(f"substr({_HASH_SQL}, (" + " + ".join(f"((({_X if b % 2 == 0 else _Y}) >> {14 - b // 2}) & 1) * {1 << (4 - b % 5)}" for b in range(5 * i, 5 * i + 5)) + ")::INT + 1, 1)" for i in range(6))


@query(f"WITH {ITEMS_SQL} SELECT id, {_GEO} AS geohash, floor(lat / 0.05)::BIGINT AS i, floor(lon / 0.05)::BIGINT AS j FROM items")
def geohashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", geo.geohash(F.col("lat"), F.col("lon"), 6).alias("geohash"), geo.cell(F.col("lat"), 0.05).alias("i"), geo.cell(F.col("lon"), 0.05).alias("j"))


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN n % 2 = 0 THEN round(lat, 2) ELSE lat END AS lat, lat BETWEEN 34.95 AND 35.05 AND lon BETWEEN 138.95 AND 139.05 AS inside FROM items")
def coarse_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", geo.coarse(F.col("lat"), F.col("n") % 2 == 0).alias("lat"), geo.in_box(F.col("lat"), F.col("lon"), 34.95, 35.05, 138.95, 139.05).alias("inside"))


@query(f"""WITH {ITEMS_SQL}, h AS (SELECT id, name, cuisine, list_distinct(list_filter([CASE WHEN contains(name, 'ring') AND cuisine = 'c1' THEN 'f1' END, CASE WHEN contains(name, 'bolt') AND cuisine = 'c2' THEN 'f2' END,
 CASE WHEN regexp_matches(name, 'plate|rod') AND cuisine = 'c3' THEN 'f3' END, CASE WHEN regexp_matches(name, '^hot') AND cuisine = 'c1' THEN 'f6' END], lambda x: x IS NOT NULL)) AS named, lat, lon FROM items)
SELECT id, array_to_string(list_sort(named), ',') AS named, CASE WHEN starts_with(name, 'red') AND lat BETWEEN 34.9 AND 35.0 AND lon BETWEEN 138.9 AND 139.1 THEN 'f7' WHEN ends_with(name, 'widget') THEN 'f0' END AS override FROM h""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine kinds by name under their parent, and overrides by name and region."""
    rows = items(spark, sf_dir)
    over = TAXONOMY.overriding(F.col("name"), F.col("lat"), F.col("lon"), done=True)
    return rows.select("id", F.array_join(F.array_sort(TAXONOMY.named(F.col("name"), F.col("cuisine"), done=True)), ",").alias("named"), over["fine"].alias("override"))


@query(f"""WITH {ITEMS_SQL} SELECT id, array_to_string(list_sort(list_distinct(flatten(list_transform(fine, lambda f: CASE f WHEN 'f1' THEN ['f1', 'f2', 'f3'] WHEN 'f4' THEN ['f4', 'f5'] ELSE [f] END)))), ',') AS expanded FROM items WHERE fine IS NOT NULL""")
def overlap_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("fine is not null").select("id", F.array_join(F.array_sort(TAXONOMY.expanded(F.col("fine"))), ",").alias("expanded"))


@query(f"WITH {ITEMS_SQL} SELECT id, array_to_string(list_filter([CASE WHEN popularity >= 0.6 THEN 'famous' END, CASE WHEN local > 0 THEN 'local' END, CASE WHEN season[4] >= 1.3 THEN 'in season' END], lambda x: x IS NOT NULL), ',') AS tags, coalesce('fine:' || fine[1], sub) AS kind FROM items")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    tags = F.array_compact(F.array(F.when(c.THEMES["famous"][0](4), "famous"), F.when(c.THEMES["local"][0](4), "local"), F.when(c.THEMES["season"][0](4), "in season")))
    return rows.select("id", F.array_join(tags, ",").alias("tags"), F.coalesce(F.concat(F.lit("fine:"), F.get("fine", F.lit(0))), "sub").alias("kind"))


@query("""WITH k AS (SELECT p_name AS key, min(p_partkey) AS best, count(*) AS n FROM part GROUP BY p_name)
SELECT key, best, n, CAST(row_number() OVER (ORDER BY key <> 'red widget', NOT starts_with(key, 'red'), length(key), key) AS INT) AS place FROM k WHERE contains(key, 'red') ORDER BY place LIMIT 12""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names holding a word: the exact one first, then those that begin with it, then short ones."""
    from pyspark.sql import Window

    from ..operators.name_index import NameIndex

    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("best"), F.count("*").alias("n"))
    names = NameIndex(spark, layout.once(spark, "part_names", f"{sf_dir}/part.parquet", lambda out: NameIndex.write(names, "key", out)), "key").holding("red")
    order = [F.col("key") != "red widget", ~F.startswith("key", F.lit("red")), F.length("key"), F.col("key")]
    best = names.orderBy(*order).limit(12)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
w AS (SELECT child AS start, parent AS up, 1 AS depth FROM e UNION ALL SELECT start, parent, depth + 1 FROM w JOIN e ON e.child = w.up WHERE depth < 15)
SELECT start, max(depth) AS depth, bool_or(up = 'r1') AS inside FROM w GROUP BY start""")
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page lies below another, at most fifteen parents up."""
    of = lambda prefix, key: F.concat(F.lit(prefix), key)
    nations = table(spark, sf_dir, "nation").select(of("n", "n_nationkey").alias("start"), of("r", "n_regionkey").alias("up"))
    customers = table(spark, sf_dir, "customer").select(of("c", "c_custkey").alias("start"), of("n", "c_nationkey").alias("up"))
    regions = table(spark, sf_dir, "region").select(of("r", "r_regionkey").alias("start"), F.lit("world").alias("up"))
    edges = nations.unionByName(customers).unionByName(regions)
    return build.below(edges, "r1", most=15)


@query(f"""WITH {ITEMS_SQL} SELECT id, name, round({km_sql('35.0', '139.0', 'lat', 'lon')}, 6) AS km FROM items WHERE {km_sql('35.0', '139.0', 'lat', 'lon')} <= 3""")
def places_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within three kilometres, from a catalogue that is laid out by place: the scan skips other boxes."""
    km = geo.haversine_km(F.lit(HERE[0]), F.lit(HERE[1]), F.col("lat"), F.col("lon"))
    return layout.within(catalogue(spark, sf_dir), HERE, 3.0).select("id", "name", F.round(km, 6).alias("km"))
