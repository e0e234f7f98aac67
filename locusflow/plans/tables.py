"""Stand-ins for the engine's tables, made from the driver's by integer arithmetic, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.taxonomy import Taxonomy
from ..sources import layout
from .registry import table

HERE = (35.0, 139.0)
CATEGORIES = {"ECONOMY": "meal", "LARGE": "cafe", "MEDIUM": "bar", "PROMO": "sight", "SMALL": "walk", "STANDARD": "shop"}

ITEMS_SQL = """items AS (SELECT 'p' || p_partkey AS id, p_partkey AS n, p_name AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'meal' WHEN 'LARGE' THEN 'cafe' WHEN 'MEDIUM' THEN 'bar' WHEN 'PROMO' THEN 'sight' WHEN 'SMALL' THEN 'walk' ELSE 'shop' END AS category,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN CASE WHEN p_size % 11 = 0 THEN 'unknown' ELSE 'c' || (p_size % 5) END END AS cuisine,
  'sub' || (p_partkey % 12) AS sub,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN CASE WHEN p_partkey % 3 = 0 THEN ['f' || (p_size % 8), 'f' || (p_partkey % 8)] ELSE ['f' || (p_size % 8)] END END AS fine,
  CASE WHEN p_size % 7 = 0 THEN 'b' || (p_size % 3) END AS broad, p_brand AS brand,
  34.9 + ((p_partkey * 7919) % 20011) * 0.00001::DOUBLE AS lat, 138.9 + ((p_partkey * 104729) % 20021) * 0.00001::DOUBLE AS lon,
  round((p_retailprice - 900) / 100, 3) AS popularity, ((p_partkey % 9) - 4) / 4.0::DOUBLE AS local, ((p_partkey % 7) - 3) / 3.0::DOUBLE AS known,
  CASE WHEN p_partkey % 4 > 0 THEN ((p_partkey % 5) - 2) / 2.0::DOUBLE END AS hidden,
  list_transform(generate_series(1, 12), lambda m: 0.5::DOUBLE + ((p_partkey + m * 5) % 12) / 8.0::DOUBLE) AS season, p_size FROM part)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n, size = F.col("p_partkey"), F.col("p_size")
    food = F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM")
    category = F.lit("shop")
    for kind, name in CATEGORIES.items():
        category = F.when(F.col("p_type") == kind, name).otherwise(category)
    code = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    rows = p.select(
        code("p", n).alias("id"),
        n.alias("n"),
        F.col("p_name").alias("name"),
        category.alias("category"),
        F.when(food, F.when(size % 11 == 0, "unknown").otherwise(code("c", size % 5))).alias("cuisine"),
        code("sub", n % 12).alias("sub"),
        F.when(food, F.when(n % 3 == 0, F.array(code("f", size % 8), code("f", n % 8))).otherwise(F.array(code("f", size % 8)))).alias("fine"),
        F.when(size % 7 == 0, code("b", size % 3)).alias("broad"),
        F.col("p_brand").alias("brand"),
        (F.lit(34.9) + (n * 7919) % 20011 * F.lit(0.00001)).alias("lat"),
        (F.lit(138.9) + (n * 104729) % 20021 * F.lit(0.00001)).alias("lon"),
        F.round((F.col("p_retailprice") - 900) / 100, 3).alias("popularity"),
        ((n % 9 - 4) / 4.0).alias("local"),
        ((n % 7 - 3) / 3.0).alias("known"),
        F.when(n % 4 > 0, (n % 5 - 2) / 2.0).alias("hidden"),
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.lit(0.5) + (n + m * 5) % 12 / 8.0).alias("season"),
        size.alias("p_size"),
    )
    return rows.withColumns({"keys": text.name_keys(F.col("name"), folded=True), "name_key": text.bare(F.col("name")), "sub_key": text.bare(F.col("sub")), "brand_key": text.bare(F.concat("name", "brand")), "sources": F.array(F.lit("map"), F.concat(F.lit("s"), (F.col("n") % 3).cast("string")))})


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as a table laid out by place, written once for this state of theirs: a box about a point reads its row groups."""
    return spark.read.parquet(layout.once(spark, "catalogue", f"{sf_dir}/part.parquet", lambda out: layout.write_by_place(items(spark, sf_dir), out)))


TAXONOMY = Taxonomy(
    parent={**{f"f{i}": f"c{i % 5}" for i in range(8)}},
    also={"f1": ["f2", "f3"], "f4": ["f5"]},
    terms={"noodles": {"coarse": ["c1"]}, "skewers": {"fine": ["f1"]}, "pubs": {"broad": ["b0"], "fine": ["f4"]}},
    subs={"garden": "sub3", "tower": "sub5"},
    name_rules=[("f1", "ring"), ("f2", "bolt"), ("f3", "plate|rod"), ("f6", "^hot")],
    overrides=[{"pattern": "^red", "fine": "f7", "parent": "c2", "note": "red", "box": (34.9, 35.0, 138.9, 139.1)}, {"pattern": "widget$", "fine": "f0", "parent": "c0", "note": "widget"}],
)

KM_SQL = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return KM_SQL.format(a=lat1, b=lat2, c=lon1, d=lon2)


M_SQL = "6371000 * sqrt(pow(radians({d} - {c}) * cos(radians(({a} + {b}) / 2)), 2) + pow(radians({b} - {a}), 2))"


def m_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return M_SQL.format(a=lat1, b=lat2, c=lon1, d=lon2)


SAME_SQL = "(contains({a}, {b}) OR contains({b}, {a}))"
EVENTS_SQL = """ev AS (SELECT event_id, ts, user_id AS actor, 'sub' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 12 AS VARCHAR) AS sub,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, value,
  CASE event_type WHEN 'purchase' THEN 'select' WHEN 'signup' THEN 'save' WHEN 'click' THEN 'detail' WHEN 'error' THEN 'skip' ELSE 'view' END AS type FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    named = F.when(kind == "purchase", "select").when(kind == "signup", "save").when(kind == "click", "detail").when(kind == "error", "skip").otherwise("view")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.concat(F.lit("sub"), (k % 12).cast("string")).alias("sub"), k.alias("k"), "value", named.alias("type"))
