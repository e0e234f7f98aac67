"""Queries over whole services: search by name, recommendation, catalogue building, chains, and what logs keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chains import fine_codes, without_branch
from ..operators import build, chains, logs, ranking, search
from ..operators import recommend as r
from ..operators.candidates import Constraints, Context
from ..operators.name_index import NameIndex
from ..sources import layout
from .registry import query, table
from .tables import EVENTS_SQL, HERE, ITEMS_SQL, TAXONOMY, catalogue, events, items, km_sql

_SHOPS = "n AS (SELECT p_partkey AS id, p_name || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' 南店' WHEN 2 THEN '(x)' ELSE 'ish' END AS name, 'Q' || (p_size % 7) || '; Q' || (p_partkey % 5) AS keys FROM part)"


def _shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    ending = F.when(size == 0, "").when(size == 1, " 南店").when(size == 2, "(x)").otherwise("ish")
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", ending).alias("name"), F.concat_ws("; ", q(F.col("p_size") % 7), q(F.col("p_partkey") % 5)).alias("keys"))


#: (seq, category, name, start_only), (seq, category, brand_key, name, source) and (category, pattern by priority)
CHAINS = [(0, "grill", "red bolt", False), (1, "cafe", "ring", False), (2, "noodle", "hot", True)]
BRANDS = [(0, "grill", "Q3", "red bolt", "vote"), (1, "cafe", "Q6", "hot", "vote"), (2, "bar", "Q8", "old plate", "manual")]
KEYWORDS = [("bar", "gear"), ("cafe", "plate|ring"), ("grill", "bolt")]
_END = r"($|[\s(（]|\S*店$)"
_KEYWORDS = "list_filter([CASE WHEN contains({0}, 'gear') THEN 'bar' END, CASE WHEN regexp_matches({0}, 'plate|ring') THEN 'cafe' END, CASE WHEN contains({0}, 'bolt') THEN 'grill' END], lambda x: x IS NOT NULL)"


def _distinct(x: str) -> str:
    """The first of each value, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(rf"""WITH {_SHOPS}, h AS (SELECT *, regexp_matches(name, '(^|[\s・])red bolt{_END}') AS a, regexp_matches(name, '(^|[\s・])ring{_END}') AS b, regexp_matches(name, '^hot{_END}') AS c FROM n),
r AS (SELECT *, list_filter([CASE WHEN a THEN 'grill' END, CASE WHEN b THEN 'cafe' END, CASE WHEN c THEN 'noodle' END], lambda x: x IS NOT NULL) AS chains,
 CASE WHEN c THEN replace(CASE WHEN b THEN replace(CASE WHEN a THEN replace(name, 'red bolt', ' ') ELSE name END, 'ring', ' ') WHEN a THEN replace(name, 'red bolt', ' ') ELSE name END, 'hot', ' ')
  WHEN b THEN replace(CASE WHEN a THEN replace(name, 'red bolt', ' ') ELSE name END, 'ring', ' ') WHEN a THEN replace(name, 'red bolt', ' ') ELSE name END AS rest FROM h),
k AS (SELECT id, name, {_KEYWORDS.format('rest')} AS beside, {_KEYWORDS.format('name')} AS kw, chains FROM r),
m AS (SELECT id, CASE WHEN len(beside) > 0 AND NOT list_has_any(chains, beside) THEN [] ELSE chains END AS held, kw FROM k), w AS (SELECT id, held, list_concat(held, kw) AS whole FROM m)
SELECT id, {_distinct('whole')}[1] AS label, array_to_string({_distinct('whole')}, ',') AS matched, CASE WHEN len(held) > 0 THEN 'chain' WHEN len(whole) > 0 THEN 'keyword' END AS kind FROM w""")
def chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains in names, and keywords beside them that outweigh a chain."""
    table = chains.dimension(spark.createDataFrame(CHAINS, "seq int, category string, name string, start_only boolean"), done=True)
    rows = chains.label_by_chains(_shops(spark, sf_dir), table, KEYWORDS)
    return rows.select("id", "label", F.array_join("matched", ",").alias("matched"), "kind")


_BRANDS = [("red bolt", "grill", "vote via Q3"), ("hot", "cafe", "vote via Q6"), ("old plate", "bar", "manual via Q8")]
_BY_NAME = " ".join(f"WHEN regexp_matches(name, '^{b}{_END}') THEN CASE WHEN len({_KEYWORDS.format(f'substr(name, {len(b) + 1})')}) > 0 AND NOT list_contains({_KEYWORDS.format(f'substr(name, {len(b) + 1})')}, '{c}') THEN NULL ELSE '{c}|brand_name|{s}' END" for b, c, s in _BRANDS)


@query(f"""WITH {_SHOPS}, k AS (SELECT id, name, list_filter(list_transform(list_transform(string_split(keys, ';'), lambda q: trim(q)), lambda q: CASE q WHEN 'Q3' THEN 'grill|brand_key|vote' WHEN 'Q6' THEN 'cafe|brand_key|vote' WHEN 'Q8' THEN 'bar|brand_key|manual' END), lambda x: x IS NOT NULL) AS known FROM n)
SELECT id, CASE WHEN len(known) > 0 THEN known[1] {_BY_NAME} END AS brand FROM k""")
def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label by a brand's key, else by its name at the beginning, unless another keyword follows."""
    table = chains.dimension(spark.createDataFrame(BRANDS, "seq int, category string, brand_key string, name string, source string"), done=True)
    rows = chains.label_by_brands(_shops(spark, sf_dir), table, KEYWORDS)
    return rows.select("id", F.when(F.col("label").isNotNull(), F.concat_ws("|", "label", "rule", "source")).alias("brand"))


_BASE = r"CASE WHEN regexp_replace(name, '\s+\S*店$', '') <> name THEN regexp_replace(name, '\s+\S*店$', '') WHEN regexp_replace(name, '\S{1,8}店$', '') <> name AND length(trim(regexp_replace(name, '\S{1,8}店$', ''))) >= 2 THEN trim(regexp_replace(name, '\S{1,8}店$', '')) ELSE name END"


@query(f"WITH {_SHOPS}, b AS (SELECT {_BASE} AS name, keys AS tag, ends_with(name, '店') AS f FROM n), c AS (SELECT name, tag, count(*) AS c, sum(f::INT) AS f FROM b GROUP BY ALL) SELECT name, CAST(sum(c) AS BIGINT) AS n, arg_min(tag, (-c, tag)) AS tag, CAST(sum(f) AS BIGINT) AS flagged FROM c GROUP BY name HAVING sum(c) >= 3")
def unlabelled_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their branch endings that occur three times, with their commonest tags."""
    from ..operators.learning import repeated

    return repeated(_shops(spark, sf_dir), without_branch(F.col("name")), tag="keys", flag=F.col("name").endswith("店"))


@query(f"WITH {ITEMS_SQL}, x AS (SELECT id, cuisine, name FROM items) SELECT id, array_to_string(list_sort(list_filter([CASE WHEN contains(name, 'ring') AND cuisine = 'c1' THEN 'f1' END, CASE WHEN contains(name, 'bolt') AND cuisine = 'c2' THEN 'f2' END, CASE WHEN regexp_matches(name, 'plate|rod') AND cuisine = 'c3' THEN 'f3' END, CASE WHEN regexp_matches(name, '^hot') AND cuisine = 'c1' THEN 'f6' END], lambda v: v IS NOT NULL)), ',') AS named FROM x")
def full_width_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name rules on names in full-width letters."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    wide = F.translate("name", plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    return items(spark, sf_dir).select("id", F.array_join(F.array_sort(TAXONOMY.named(wide, F.col("cuisine"))), ",").alias("named"))


_OBJECTS = """obj AS (SELECT p_partkey AS osm_id, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'k' || p_partkey WHEN p_partkey % 4 = 1 THEN '' END AS ko, CASE p_size % 5 WHEN 0 THEN 'museum' WHEN 1 THEN 'hotel' WHEN 2 THEN 'artwork' END AS tourism, CASE WHEN p_size % 5 = 3 THEN 'place_of_worship' END AS amenity,
 CASE p_partkey % 3 WHEN 0 THEN 'shinto' WHEN 1 THEN 'christian' END AS religion, CASE WHEN p_size % 5 = 4 THEN 'park' END AS leisure, CASE WHEN p_partkey % 2 = 0 THEN 'Q' || (p_size % 40) || '; Q' || (p_partkey % 30) END AS wikidata FROM part),
known AS (SELECT 'Q' || n_nationkey AS qid, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS ko, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 32.0::DOUBLE END AS scaled FROM nation)"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size") % 5
    code = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    tags = {
        "name": F.col("p_name"), "name:ko": F.when(n % 4 == 0, code("k", n)).when(n % 4 == 1, ""), "tourism": F.when(size == 0, "museum").when(size == 1, "hotel").when(size == 2, "artwork"), "amenity": F.when(size == 3, "place_of_worship"),
        "religion": F.when(n % 3 == 0, "shinto").when(n % 3 == 1, "christian"), "leisure": F.when(size == 4, "park"), "wikidata": F.when(n % 2 == 0, F.concat_ws("; ", code("Q", F.col("p_size") % 40), code("Q", n % 30))),
    }
    whole = F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v)))
    return table(spark, sf_dir, "part").select(n.alias("osm_id"), F.map_filter(whole, lambda _, v: v.isNotNull()).alias("tags"), F.lit(35.0).alias("lat"), F.lit(139.0).alias("lon"))


KINDS = build.Kinds(
    categories=[("sight", {"tourism": ["museum", "artwork"]}), ("shrine", {"amenity": ["place_of_worship"]}), ("walk", {"leisure": None})],
    keys=["tourism", "amenity", "leisure"], subs={"tourism=museum": "museum", "leisure=park": "park"}, worship={"shinto": "shrine", "buddhist": "temple"}, skipped=["tourism=artwork"],
)


@query(f"""WITH {_OBJECTS}, o AS (SELECT *, CASE WHEN tourism IN ('museum', 'artwork') THEN 'sight' WHEN amenity = 'place_of_worship' THEN 'shrine' WHEN leisure IS NOT NULL THEN 'walk' END AS category FROM obj),
s AS (SELECT *, CASE WHEN amenity IS NOT NULL AND tourism IS NULL THEN CASE religion WHEN 'shinto' THEN 'shrine' END WHEN tourism = 'museum' THEN 'museum' WHEN leisure = 'park' THEN 'park' ELSE 'other' END AS sub FROM o WHERE category IS NOT NULL AND coalesce(tourism, '') <> 'artwork'),
q AS (SELECT osm_id, unnest(list_transform(string_split(wikidata, ';'), lambda x: trim(x))) AS qid, unnest(generate_series(1, len(string_split(wikidata, ';')))) AS pos FROM s),
f AS (SELECT osm_id, arg_min(known.qid, pos) AS qid FROM q JOIN known USING (qid) GROUP BY osm_id)
SELECT 'osm_' || s.osm_id AS id, coalesce(nullif(known.ko, ''), nullif(s.ko, ''), s.name) AS name, category, sub, CASE WHEN scaled IS NOT NULL THEN round(0.2 + 0.8 * scaled, 3) WHEN f.qid IS NOT NULL THEN 0.1 ELSE 0.05 END::DOUBLE AS popularity,
 CASE WHEN scaled IS NOT NULL THEN 1 WHEN f.qid IS NOT NULL THEN 2 ELSE 3 END AS pop_tier, f.qid AS wikidata, CASE WHEN f.qid IS NULL THEN 'osm' ELSE 'osm,wikidata' END AS sources FROM s LEFT JOIN f USING (osm_id) LEFT JOIN known ON known.qid = f.qid WHERE sub IS NOT NULL""")
def attraction_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects to keep as places: kinds, skipped ones, entities, tiers and names."""
    n = F.col("n_nationkey")
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("Q"), n.cast("string")).alias("qid"), F.when(n % 2 == 0, F.col("n_name")).alias("ko"), F.when(n % 3 > 0, n / 32.0).alias("scaled"))
    rows = build.attractions(_objects(spark, sf_dir), known, KINDS)
    return rows.select("id", "name", "category", "sub", "popularity", "pop_tier", "wikidata", F.array_join("sources", ",").alias("sources"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ko' WHEN c_custkey % 3 = 1 THEN 'en' WHEN c_custkey % 2 = 0 THEN 'ja' END AS lang, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'j' END AS text FROM customer")
def first_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first language of an order that has a text; an empty one is none."""
    n = F.col("c_custkey")
    by = F.create_map(F.lit("en"), F.when(n % 3 == 1, F.col("c_mktsegment")), F.lit("ko"), F.when(n % 3 == 0, F.col("c_name")).otherwise(""), F.lit("ja"), F.when((n % 3 == 2) & (n % 2 == 0), "j"))
    return table(spark, sf_dir, "customer").select(n.alias("id"), build.first_language(by).alias("x")).select("id", "x.lang", "x.text")


@query("WITH l AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part), s AS (SELECT s_suppkey * 3 AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, 'S' || s_nationkey AS site FROM supplier) SELECT l.id, coalesce(s.name, l.name) AS name, brand, site FROM l LEFT JOIN s USING (id)")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the values of another source where it has them; the right side wins."""
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    right = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("site"))
    return build.merged(left, right, "id").select("id", "name", "brand", "site")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN CASE p_type WHEN 'ECONOMY' THEN 'meal' WHEN 'LARGE' THEN 'cafe' ELSE 'other' END ELSE 'other' END AS kind, array_to_string(list_filter(['f1', 'f2'], lambda f: CASE WHEN f = 'f1' THEN p_size % 2 = 0 ELSE p_size % 3 = 0 END), ',') AS codes FROM part")
def mapped_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code by a dictionary with a default, and fine codes by the last part of category paths."""
    size = F.col("p_size")
    paths = F.array(F.when(size % 2 == 0, "Food > Noodle").otherwise("Food > Odd"), F.when(size % 3 == 0, "Bar"), F.lit("Food > Noodle > None"))
    kind = build.mapped(F.when(size % 3 > 0, F.col("p_type")), {"ECONOMY": "meal", "LARGE": "cafe"}, "other")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.array_join(fine_codes(paths, {"Noodle": "f1", "Bar": "f2"}), ",").alias("codes"))


_STATIONS = """st AS (SELECT s_suppkey AS id, 're' || s_nationkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'kore' || s_nationkey END AS ko, CASE WHEN s_suppkey % 2 = 0 THEN 'JR' ELSE '' END AS operator, 34.9 + ((s_suppkey * 6007) % 20011) * 0.00001::DOUBLE AS lat, 138.9 + ((s_suppkey * 8081) % 20021) * 0.00001::DOUBLE AS lon FROM supplier),
sk AS (SELECT id, coalesce(ko, name) AS name, CASE WHEN ko IS NOT NULL THEN name ELSE operator END AS sub, lat, lon, unnest(CASE WHEN ko IS NOT NULL THEN [name, ko] ELSE [name] END) AS key FROM st)"""


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    code = lambda p: F.concat(F.lit(p), F.col("s_nationkey").cast("string"))
    names = F.map_filter(F.create_map(F.lit("name"), code("re"), F.lit("name:ko"), F.when(n % 3 == 0, code("kore"))), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "supplier").select(
        n.alias("id"), names.alias("names"), F.when(n % 2 == 0, "JR").alias("operator"), (F.lit(34.9) + n * 6007 % 20011 * F.lit(0.00001)).alias("lat"), (F.lit(138.9) + n * 8081 % 20021 * F.lit(0.00001)).alias("lon"), n.alias("seq"),
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("name_ja", F.lit(None).cast("string"))


def _station_names(spark: SparkSession, sf_dir: str) -> NameIndex:
    """The index of stations' names, written once for this state of the table."""
    folder = layout.once(spark, "stations", f"{sf_dir}/supplier.parquet", lambda out: NameIndex.write(search.station_index(_stations(spark, sf_dir), done=True), "key", out))
    return NameIndex(spark, folder, "key")


def place_names(spark: SparkSession, sf_dir: str) -> NameIndex:
    """The index of places' names with the columns that searches show."""
    shown = ("id", "name", "name_key", "name_ja", "sub", "popularity", "lat", "lon")
    folder = layout.once(spark, "places", f"{sf_dir}/part.parquet", lambda out: NameIndex.write(_places(spark, sf_dir).select(*shown), "name_key", out))
    return NameIndex(spark, folder, "name_key")


@query(f"""WITH RECURSIVE {ITEMS_SQL}, {_STATIONS}, b AS (SELECT id, min((key <> 're1', NOT starts_with(key, 're1'), length(key), key, id)) AS o, arg_min(name, (key <> 're1', NOT starts_with(key, 're1'), length(key), key)) AS name, any_value(sub) AS sub, any_value(lat) AS lat, any_value(lon) AS lon FROM sk WHERE contains(key, 're1') GROUP BY id),
nb AS (SELECT *, row_number() OVER (ORDER BY o) AS rn FROM b), adj AS (SELECT x.id, list(y.id) FILTER (WHERE y.id IS NOT NULL) AS near FROM nb x LEFT JOIN nb y ON x.id <> y.id AND x.name = y.name AND {km_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')} < 2 GROUP BY x.id),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT nb.rn, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, nb.id) END FROM g JOIN nb ON nb.rn = i + 1 JOIN adj ON adj.id = nb.id),
k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)),
u AS (SELECT 0 AS src, r_regionkey::DOUBLE AS p, '' AS q, 'start' AS source, 'Fare1 ' || r_name AS name, r_name AS sub, 'airport' AS kind FROM region WHERE r_regionkey < 3
 UNION ALL SELECT 1, rn, '', 'station', name, sub, 'station' FROM nb WHERE id IN (SELECT id FROM k)
 UNION ALL SELECT 2, -popularity, id, 'place', name, '', sub FROM items WHERE contains(regexp_replace(name, '[^a-z0-9]', '', 'g'), 're1'))
SELECT row_number() OVER (ORDER BY src, p, q) AS place, source, name, sub, kind FROM u ORDER BY place LIMIT 30""")
def station_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start points, stations (once within two kilometres) and places whose names hold a word."""
    n = F.col("r_regionkey")
    starts = table(spark, sf_dir, "region").select(F.when(n < 3, F.concat(F.lit("Fare1 "), "r_name")).otherwise("none").alias("name"), F.col("r_name").alias("city"), F.lit("XXX").alias("code"), F.lit(35.0).alias("lat"), F.lit(139.0).alias("lon"), n.alias("seq"))
    found = search.find("RE1 Station", starts=starts, index=_station_names(spark, sf_dir), places=place_names(spark, sf_dir), limit=30)
    return found.select(F.col("place").cast("bigint").alias("place"), "source", "name", "sub", "kind")


@query(f"""WITH {ITEMS_SQL}, {_STATIONS}, a AS (SELECT 'station' AS asked, name, round(lat, 5) AS lat FROM sk WHERE key = 're7' ORDER BY {km_sql('35.0', '139.0', 'lat', 'lon')}, id::VARCHAR LIMIT 1),
b AS (SELECT 'place' AS asked, name, round(lat, 5) AS lat FROM items WHERE contains(regexp_replace(name, '[^a-z0-9]', '', 'g'), 'redbolt') ORDER BY popularity DESC, id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b""")
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station by its exact name nearest to here; a place where no station has the name, the most popular."""
    index, places = _station_names(spark, sf_dir), place_names(spark, sf_dir)
    a = search.geocode("re7駅", index=index, places=places, near=HERE).select(F.lit("station").alias("asked"), "name", F.round("lat", 5).alias("lat"))
    return a.unionByName(search.geocode("Red Bolt", index=index, places=places).select(F.lit("place").alias("asked"), "name", F.round("lat", 5).alias("lat")))


@query(f"WITH {ITEMS_SQL} SELECT id, name, popularity FROM items WHERE contains(regexp_replace(name, '[^a-z0-9]', '', 'g'), 'gear') ORDER BY popularity DESC, id LIMIT 20")
def popular_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_name(place_names(spark, sf_dir), "Gear").select("id", "name", "popularity")


@query(f"WITH {ITEMS_SQL} SELECT id, name, sub FROM items WHERE contains(name, 'ring') OR contains(sub, 'b1')")
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list that hold a word in either of two columns."""
    rows = items(spark, sf_dir).select("id", "name", "sub")
    return search.listed(rows.where(~F.contains("sub", F.lit("b1"))), "ring", ("name",)).unionByName(search.listed(rows, "b1", ("sub",)))


_D = km_sql(str(HERE[0]), str(HERE[1]), "lat", "lon")
_POP = "least(1.0::DOUBLE, 0.5::DOUBLE + local / 4)"
_ONE = f"""WITH {ITEMS_SQL}, {EVENTS_SQL}, pref AS (SELECT sub, 1.0::DOUBLE + sum(CASE type WHEN 'select' THEN 1.0 WHEN 'save' THEN 0.7 WHEN 'detail' THEN 0.3 ELSE 0 END::DOUBLE) AS a, 1.0::DOUBLE + sum(CASE WHEN type = 'skip' THEN 0.3::DOUBLE ELSE 0::DOUBLE END) AS b FROM ev WHERE type IN ('select', 'save', 'detail', 'skip') AND actor = 7 GROUP BY sub),
d AS (SELECT *, {_D} AS dist FROM items WHERE category = 'sight' AND local > 0),
n AS (SELECT CASE WHEN count(*) FILTER (WHERE dist <= 5) >= 8 THEN 5.0::DOUBLE ELSE 15.0::DOUBLE END AS radius_km FROM d),
s AS (SELECT d.*, radius_km, round(coalesce(a / (a + b), 0.5), 6) AS taste FROM d JOIN n ON dist <= radius_km LEFT JOIN pref USING (sub)),
r AS (SELECT *, round((1 - 20 / 25.0::DOUBLE) * {_POP} + 20 / 25.0::DOUBLE * taste - 0.1 * dist / radius_km, 3) AS score FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, dist, id) AS rank FROM r),
x AS (SELECT *, row_number() OVER (ORDER BY (sub NOT IN (SELECT sub FROM k WHERE rank < 8)) DESC, taste DESC, id) AS pick FROM k WHERE rank >= 8),
top AS (SELECT *, 'top' AS slot FROM k WHERE rank < 8 UNION ALL SELECT * EXCLUDE (rank, pick), 8 AS rank, 'explore' AS slot FROM x WHERE pick = 1)"""


def _asked(spark: SparkSession, sf_dir: str) -> r.Answer:
    prefs = ranking.preferences(events(spark, sf_dir).where("actor = 7"), user="actor").select("sub", "a", "b")
    words = r.Words(categories={"sight": "sights"}, themes={"local": "local favourites of month {month}"}, kinds={f"f{i}": f"fine {i}" for i in range(4)})
    intent = Constraints("sight", theme="local", month=4, max_distance_km=1.0)
    return r.recommend(catalogue(spark, sf_dir).withColumn("name_ja", F.lit(None).cast("string")), intent, Context(*HERE), TAXONOMY, prefs=prefs, n_reactions=20, words=words)


@query(f"""{_ONE} SELECT rank::INT AS rank, id, slot, score, round(taste, 4) AS taste, CAST(round(dist * 1000) AS BIGINT) AS distance_m, sub AS kind,
 array_to_string(list_filter([CASE WHEN popularity >= 0.6 THEN 'famous' END, CASE WHEN local > 0 THEN 'local' END, CASE WHEN known > 0 THEN 'known' END, CASE WHEN hidden > 0 THEN 'hidden' END, CASE WHEN season[4] >= 1.3 THEN 'month 4' END], lambda v: v IS NOT NULL), ',') AS tags FROM top""")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight places for one user from end to end: a theme, its least radius, the wider radius, taste, and cards."""
    shown = _asked(spark, sf_dir).shown
    return shown.select(F.col("rank").cast("int").alias("rank"), "id", "slot", "score", F.round("taste", 4).alias("taste"), "distance_m", "kind", F.array_join("tags", ",").alias("tags"))


@query(f"""{_ONE} SELECT CASE WHEN count(*) > 0 THEN 'local favourites of month 4: ' || least(count(*), 8) || ' found' ELSE 'nothing fits within 15 km' END AS answer, max(radius_km) AS radius_km, count(*) AS n_candidates, 'few are near: searched up to ' || CAST(max(radius_km) AS INT) || ' km' AS notes FROM s""")
def recommendation_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn says and logs."""
    return _asked(spark, sf_dir).turn.select("answer", "radius_km", "n_candidates", F.array_join("notes", "; ").alias("notes"))


_KEPT = "e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, 34.9 + (event_id % 1000) * 0.00013::DOUBLE AS lat, 138.9 + (event_id % 777) * 0.00017::DOUBLE AS lon FROM events)"


@query(f"""WITH {_KEPT} SELECT event_id, CASE WHEN k % 3 > 0 THEN round(lat, 2) ELSE lat END AS lat, list_filter(['noodle', 'food', 'place'], lambda w: CASE w WHEN 'noodle' THEN true ELSE w <> 'food' AND k % 2 = 0 END) AS kinds, CASE WHEN event_type IN ('click', 'view') THEN 'famous' END AS theme,
 CASE WHEN k < 4 THEN k + 1 END AS place, CASE WHEN k % 5 = 0 THEN 'known' ELSE 'sent' END AS at, CASE WHEN length('{{"k":' || k || ',"s":"' || event_type || '"}}') <= 20 THEN '{{"k":' || k || ',"s":"' || event_type || '"}}' END AS props FROM e""")
def turn_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn's log keeps: a coarse place, kinds without stop words, a theme the message names, ranks and short properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(n, k.alias("k"), "event_type", F.struct((F.lit(34.9) + n % 1000 * F.lit(0.00013)).alias("lat"), (F.lit(138.9) + n % 777 * F.lit(0.00017)).alias("lon")).alias("at"))
    context = r.turn_context(F.col("at"), F.array(F.lit("p1")), 4, source=F.when(F.col("k") % 3 > 0, "gps").otherwise("search"))
    said = F.when(F.col("k") % 2 == 0, F.array(F.lit("noodle"), F.lit("food"), F.lit("place"))).otherwise(F.array(F.lit("noodle"), F.lit("food")))
    theme = r.accepted_theme(F.lit("famous"), F.col("event_type"), "click|view")
    rank = r.shown_rank(F.array(*map(F.lit, range(4))), F.col("k"))
    where = r.located(F.lit("known"), F.when(F.col("k") % 7 >= 0, F.lit("sent")), F.col("k") % 5 > 0)
    return e.select("event_id", context["lat"].alias("lat"), r.without_stop_words(said, ["food"]).alias("kinds"), theme.alias("theme"), rank.cast("int").alias("place"), where.alias("at"), logs.accepted_props(F.struct("k", F.col("event_type").alias("s")), 20).alias("props"))


@query("WITH s AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 2500) AS place_id, o_orderdate AS at FROM orders), r AS (SELECT s.id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS owner, p_name FROM s JOIN part ON place_id = 'p' || p_partkey JOIN orders ON o_orderkey = s.id JOIN customer ON c_custkey = o_custkey) SELECT id, owner, p_name AS name FROM r")
def saved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved places with their names, stale ones dropped; looked-up owners, nulled where the owner was deleted."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 2500).cast("string")).alias("place_id"), "o_custkey")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("owner"))
    rows = logs.saved_places(logs.looked_up(o, users, "o_custkey", "owner"), items(spark, sf_dir), ["name"])
    return logs.unreferenced(rows, table(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), "owner", "c_custkey").select("id", "owner", "name")


@query("SELECT o_orderkey AS id, year(o_orderdate + INTERVAL 4 MONTH) AS season_year, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m') AS before, CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice / 1000, 2) ELSE o_totalprice / 1000 END AS lat FROM orders")
def dates_and_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from September on, the month before, and sessions as they are kept."""
    from ..operators.series import september_year

    session = F.struct((F.col("o_totalprice") / 1000).alias("lat"), F.lit(1.0).alias("lon"), F.lit("x").alias("candidates"))
    kept = logs.stored_profile(session, device=F.col("o_custkey") % 2 == 0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), september_year(F.col("o_orderdate")).cast("bigint").alias("season_year"), logs.month_before(F.col("o_orderdate")).alias("before"), kept["lat"].alias("lat"))


_PREF = f"{EVENTS_SQL}, pref AS (SELECT actor, sub, 1.0::DOUBLE + sum(CASE type WHEN 'select' THEN 1.0 WHEN 'save' THEN 0.7 WHEN 'detail' THEN 0.3 ELSE 0 END::DOUBLE) AS a, 1.0::DOUBLE + sum(CASE WHEN type = 'skip' THEN 0.3::DOUBLE ELSE 0::DOUBLE END) AS b FROM ev WHERE type IN ('select', 'save', 'detail', 'skip') GROUP BY ALL)"


@query(f"WITH {_PREF}, k AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY a / (a + b) DESC, a + b DESC, sub) AS place FROM pref) SELECT actor, CAST(place AS INT) AS place, sub || ' ' || CAST(round(a / (a + b) * 100) AS INT) || '% (' || printf('%.1f', a + b) || ')' AS line FROM k WHERE place <= 5")
def preference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest preferences of each user as text."""
    return ranking.preference_summary(ranking.preferences(events(spark, sf_dir), user="actor", order=["event_id"]), user="actor")


@query(f"WITH {ITEMS_SQL}, e AS (SELECT id, array_to_string(list_filter(fine, lambda f: f <> 'f3'), ',') AS without, array_to_string(list_concat([fine[1]], list_filter(fine, lambda f: f <> fine[1] AND (substr(f, 2)::INT % 5) = (substr(fine[1], 2)::INT % 5))), ',') AS front, array_to_string(list_sort([name, sub]), '|') AS names FROM items WHERE fine IS NOT NULL) SELECT * FROM e")
def array_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value taken out, a code moved to the front of its siblings, and all values of a map."""
    from .tables import TAXONOMY as t

    rows = items(spark, sf_dir).where("fine is not null")
    first = F.get("fine", F.lit(0))
    parents = F.create_map(*(F.lit(x) for pair in t.parent.items() for x in pair))
    front = build.explicit_first(F.col("fine"), first, t.parent, F.try_element_at(parents, first))
    names = F.map_values(F.create_map(F.lit("name"), "name", F.lit("name:en"), "sub"))
    return rows.select("id", F.array_join(F.array_remove("fine", F.lit("f3")), ",").alias("without"), F.array_join(front, ",").alias("front"), F.array_join(F.array_sort(names), "|").alias("names"))


@query("SELECT event_id, 'm1' AS model, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 BETWEEN 1 AND 3 THEN ['x', 'y', 'z'][CAST(json_extract_string(props, '$.k') AS INT) % 5] END AS card FROM events WHERE user_id % 7 <> 3")
def cleaned_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log without test users, stamped with versions, and the card that was picked by its number."""
    ev = events(spark, sf_dir)
    left = logs.stamped(logs.without_actors(ev, ev.where("actor % 7 = 3").select("actor")), {"model": "m1", "rules": "r2"})
    return left.select("event_id", "versions.model", logs.picked(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("k") % 5).alias("card"))


@query(f"""WITH {ITEMS_SQL}, t AS (SELECT s_suppkey AS qid, 34.9 + ((s_suppkey * 6007) % 20011) * 0.00001::DOUBLE AS q_lat, 138.9 + ((s_suppkey * 8081) % 20021) * 0.00001::DOUBLE AS q_lon FROM supplier),
l AS (SELECT n, p_size % 100 AS qid, lat, lon FROM items) SELECT n, qid, round({km_sql('lat', 'lon', 'q_lat', 'q_lon')} * 1000, 2) AS dist_m FROM l JOIN t USING (qid) WHERE {km_sql('lat', 'lon', 'q_lat', 'q_lon')} * 1000 < 5000""")
def near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between records whose places lie near each other."""
    from ..functions import geo

    n = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(n.alias("qid"), (F.lit(34.9) + n * 6007 % 20011 * F.lit(0.00001)).alias("q_lat"), (F.lit(138.9) + n * 8081 % 20021 * F.lit(0.00001)).alias("q_lon"))
    rows = items(spark, sf_dir).select("n", (F.col("p_size") % 100).cast("bigint").alias("qid"), "lat", "lon").join(t, "qid")
    far = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("q_lat"), F.col("q_lon")) * 1000
    return rows.where(far < 5000).select("n", "qid", F.round(far, 2).alias("dist_m"))


@query("""SELECT c_custkey AS id, '{"preferences":{"' || c_mktsegment || '":1.5},"n_reactions":' || c_nationkey || ',"context":{"current":"' || c_name || '","visited":["p' || c_custkey % 7 || '"]}}' AS view FROM customer""")
def ranking_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a profile what ranking reads."""
    visited = F.array(F.concat(F.lit("p"), (F.col("c_custkey") % 7).cast("string")))
    view = r.ranking_view(F.create_map("c_mktsegment", F.lit(1.5)), F.col("c_nationkey"), F.col("c_name"), visited)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.to_json(view).alias("view"))
