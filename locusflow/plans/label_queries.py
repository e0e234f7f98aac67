"""Labelling, set-operation, scalar and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import labels as l
from ..operators import resolve
from .registry import query, table
from .tables import ITEMS_SQL, items


@query("SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS cat, max(o_orderkey) AS seq FROM orders GROUP BY ALL")
def last_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("cat"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("_seq"))
    return l.last_wins(rows, ["id"], "_seq").select("id", "cat", "seq")


@query("SELECT o_custkey AS id, arg_min(o_orderstatus, o_orderkey) AS cat, min(o_orderkey) AS seq FROM orders GROUP BY ALL")
def first_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("cat"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("_seq"))
    return l.first_wins(rows, ["id"], "_seq").select("id", "cat", "seq")


@query("""WITH a AS (SELECT p_partkey AS id, 'rule' AS method, p_type AS label FROM part WHERE p_size % 3 = 0), b AS (SELECT p_partkey AS id, 'model' AS method, p_brand AS label FROM part WHERE p_size % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit("rule").alias("method"), F.col("p_type").alias("label"))
    b = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("model").alias("method"), F.col("p_brand").alias("label"))
    return l.precedence_union([a, b], ["id"])


_VOTES = "v AS (SELECT p_name AS key, CASE WHEN p_size % 9 = 0 THEN p_type ELSE 'STANDARD' END AS value FROM part), c AS (SELECT key, value, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key) AS BIGINT) AS whole, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS place FROM c)"


@query(f"WITH {_VOTES} SELECT key, value, n, whole AS of FROM t WHERE place = 1 AND n >= 2 AND n / whole >= 0.8")
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.when(F.col("p_size") % 9 == 0, F.col("p_type")).otherwise("STANDARD").alias("value"))
    return l.majority(rows, "key", "value")


@query("""WITH v AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'x' || (p_size % 3) END AS a, CASE WHEN p_partkey % 3 > 0 THEN 'x' || (p_partkey % 3) END AS b, CASE WHEN p_partkey % 5 = 0 THEN 'x0' END AS c, CASE WHEN p_partkey % 101 = 0 THEN 'hand' END AS manual FROM part),
n AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS cast_ FROM v), k AS (SELECT *, len(cast_) AS m, len(list_distinct(cast_)) AS d,
 list_max(list_transform(['x0', 'x1', 'x2'], lambda x: len(list_filter(cast_, lambda y: y = x)))) AS top FROM n)
SELECT id, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN m = 0 THEN 'none' WHEN d = 1 AND m > 1 THEN 'high' WHEN m = 1 THEN 'single' WHEN top > 1 THEN 'majority' ELSE 'conflict' END AS grade,
 CASE WHEN manual IS NOT NULL THEN manual WHEN m = 0 OR (d > 1 AND top = 1) THEN NULL ELSE list_reverse_sort(list_filter(['x0', 'x1', 'x2'], lambda x: len(list_filter(cast_, lambda y: y = x)) = top))[1] END AS decision FROM k""")
def three_way_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size")
    code = lambda x: F.concat(F.lit("x"), x.cast("string"))
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.when(size % 2 == 0, code(size % 3)).alias("a"), F.when(n % 3 > 0, code(n % 3)).alias("b"), F.when(n % 5 == 0, "x0").alias("c"), F.when(n % 101 == 0, "hand").alias("manual"))
    return l.three_way_vote(rows, ["a", "b", "c"], manual="manual").select("id", "grade", "decision")


@query("WITH c AS (SELECT p_name AS key, p_type AS value, count(*) AS n, min(p_partkey) AS seq FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, seq) AS place FROM c) SELECT key, value FROM k WHERE place = 1")
def commonest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value"), F.col("p_partkey").alias("seq"))
    return l.mode(rows, "key", "value", "seq")


@query("WITH c AS (SELECT p_name AS key, p_type AS value, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY key) AS whole FROM c) SELECT key, list(value ORDER BY value) AS labels FROM k WHERE n >= 0.2 * whole GROUP BY key")
def share_threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.share_labels(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value")), "key", "value")


_SPACED = "CASE p_size % 5 WHEN 0 THEN '  ' || p_name WHEN 1 THEN p_name || ' ' WHEN 2 THEN upper(p_name) WHEN 3 THEN ' .- ' ELSE p_name END"


@query(f"WITH r AS (SELECT trim({_SPACED}) AS key, p_type AS value FROM part WHERE regexp_matches({_SPACED}, '[a-zA-Z0-9]')), c AS (SELECT key, value, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY key) AS whole FROM c) SELECT key, list(value ORDER BY value) AS labels FROM k WHERE n >= 0.2 * whole GROUP BY key")
def labels_of_written_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the trimmed name as it is written; names without a letter or digit go."""
    name = F.expr(_SPACED)
    rows = l.named(table(spark, sf_dir, "part").select(name.alias("key"), F.col("p_type").alias("value")), "key", done=True)
    return l.share_labels(rows, "key", "value")


@query("SELECT p_partkey AS id, p_name || 'カラオケ' || chr(CAST(12353 + p_size % 80 AS INT)) AS name FROM part".replace("カラオケ", "からおけ"))
def hiragana_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katakana of names as hiragana."""
    from ..functions.kana import hiragana

    one = F.decode(F.unhex(F.concat(F.lit("30"), F.lpad(F.hex(F.col("p_size") % 80 + 0xA1), 2, "0"))), "UTF-16BE")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hiragana(F.concat("p_name", F.lit("カラオケ"), one)).alias("name"))


_U = "(p_partkey * 1103515 + 12345) % 1000003"


@query(f"WITH k AS (SELECT p_partkey AS id, p_type AS label, row_number() OVER (PARTITION BY p_type ORDER BY {_U}, p_partkey) AS n FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY label) AS whole FROM k WHERE n <= 40) SELECT id, label, CASE WHEN n <= greatest(1, floor(whole * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM c")
def capped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most forty a class in a seeded order, the first twentieth for validation."""
    from ..operators.ranking import uniform

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    return l.capped(rows, "label", [uniform(F.col("id")), F.col("id")], 40)


@query(f"WITH k AS (SELECT p_partkey AS id, p_brand AS stratum, row_number() OVER (PARTITION BY p_brand ORDER BY {_U}, p_partkey) AS n FROM part) SELECT id, stratum FROM k WHERE n <= 3")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import uniform

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("stratum"))
    n = F.row_number().over(Window.partitionBy("stratum").orderBy(uniform(F.col("id")), "id"))
    return rows.withColumn("n", n).where("n <= 3").drop("n")


_CASC = """b AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE 'c' || (p_size % 5) END AS base, CASE WHEN p_partkey % 3 = 0 THEN 'f' || (p_partkey % 8) END AS dir, CASE WHEN p_partkey % 3 = 0 THEN 'c' || (p_partkey % 8 % 5) END AS par,
 CASE WHEN p_size % 7 = 0 THEN 'cafe' END AS broad, 'c' || (p_partkey % 5) AS pred, p_retailprice >= 980 AS sure, CASE WHEN starts_with(p_name, 'red') THEN 'c2' END AS over FROM part)"""


@query(f"""WITH {_CASC} SELECT id, CASE WHEN over IS NOT NULL THEN over WHEN base = 'unknown' AND par IS NOT NULL THEN par WHEN base = 'unknown' AND broad = 'cafe' THEN 'cafe' WHEN base <> 'unknown' AND dir IS NOT NULL AND par <> base THEN par WHEN base = 'unknown' AND sure THEN pred ELSE base END AS label,
CASE WHEN over IS NOT NULL THEN 'override' WHEN base = 'unknown' AND (par IS NOT NULL OR coalesce(broad = 'cafe', false)) THEN 'directory' WHEN base <> 'unknown' AND dir IS NOT NULL AND par <> base THEN 'directory' WHEN base = 'unknown' AND sure THEN 'model' ELSE 'base' END AS method FROM b""")
def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size")
    code = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    label, method = l.cascade(
        F.when(size % 4 == 0, "unknown").otherwise(code("c", size % 5)), F.when(n % 3 == 0, code("f", n % 8)), F.when(n % 3 == 0, code("c", n % 8 % 5)),
        F.when(size % 7 == 0, "cafe"), code("c", n % 5), F.col("p_retailprice") >= 980, F.when(F.startswith("p_name", F.lit("red")), "c2"),
    )
    return table(spark, sf_dir, "part").select(n.alias("id"), label.alias("label"), method.alias("method"))


RULES = [("round", "ring|gizmo"), ("flat", "plate"), ("long", "rod|bolt"), ("toy", r"\bwidget\b")]
_RULES_SQL = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(p_name, '{p}') THEN '{k}' END" for k, p in RULES) + "], lambda x: x IS NOT NULL))"


@query(f"SELECT p_partkey AS id, {_RULES_SQL}[1] AS label, CAST(len({_RULES_SQL}) AS INT) AS matched FROM part")
def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, hits = text.first_match(F.col("p_name"), RULES, done=True)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), F.size(hits).alias("matched"))


@query("SELECT p_partkey AS id, CAST(floor((row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) / 25) AS BIGINT) AS chunk FROM part")
def chunks_of_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return l.chunked(rows, [F.desc("p_retailprice"), "id"], 25).select("id", "chunk")


@query("""WITH k AS (SELECT o_orderkey AS id, unnest(['c' || (o_custkey + 700), 'c' || o_custkey, 'c' || (o_custkey % 10)]) AS key, unnest([1, 2, 3]) AS pos FROM orders), d AS (SELECT 'c' || c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0),
h AS (SELECT id, arg_min(key, pos) AS matched_key, arg_min(value, pos) AS value FROM k JOIN d USING (key) GROUP BY id) SELECT o_orderkey AS id, matched_key, value FROM orders LEFT JOIN h ON h.id = o_orderkey""")
def first_known_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several keys that a dimension holds."""
    c = F.col("o_custkey")
    part = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("; ", part(c + 700), part(c), part(c % 10)).alias("key"))
    dim = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    return resolve.first_known_key(rows, dim, key="key", value="value").select("id", "matched_key", "value")


@query(f"WITH {ITEMS_SQL} SELECT id, coalesce(CASE WHEN hidden IS NOT NULL THEN 'hidden=' || CAST(n % 5 AS VARCHAR) END, CASE WHEN broad IS NOT NULL THEN 'broad=' || broad END, '') AS tag, array_to_string(list_sort(list_distinct(['map', 's' || (n % 3)])), '+') AS sources, nullif(cuisine, 'unknown') AS cuisine FROM items")
def tag_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First key that is present as `k=v`, sorted sources, and a value turned into null."""
    tag = text.first_key({"hidden": F.when(F.col("hidden").isNotNull(), (F.col("n") % 5).cast("string")), "broad": F.col("broad")})
    return items(spark, sf_dir).select("id", tag.alias("tag"), F.array_join(F.array_sort(F.array_distinct("sources")), "+").alias("sources"), F.nullif("cuisine", F.lit("unknown")).alias("cuisine"))


@query(f"WITH {ITEMS_SQL} SELECT parent, kid FROM (SELECT 'c' || (substr(kid, 2)::INT % 5) AS parent, kid FROM (SELECT DISTINCT unnest(fine) AS kid FROM items)) QUALIFY count(*) OVER (PARTITION BY parent) = 1")
def only_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = items(spark, sf_dir).select(F.explode("fine").alias("kid")).distinct().withColumn("parent", F.concat(F.lit("c"), (F.substring("kid", 2, 9).cast("int") % 5).cast("string")))
    return kids.groupBy("parent").agg(F.count("*").alias("n"), F.min("kid").alias("kid")).where("n = 1").select("parent", "kid")


@query("""SELECT page_id, md5(left(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 160)) AS plain, len(regexp_extract_all(html, '<p>')) AS paragraphs, split_part(url, '/', 3) AS host, list_extract(string_split(url, '/'), -1) AS tail FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"), 160)).alias("plain"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), text.leaf(F.col("url"), "/").alias("tail"))


@query("""SELECT p_partkey AS id, list_extract(string_split('A > ' || p_type || ' > ' || p_name, ' > '), -1) AS leaf, regexp_extract('amenity=x brand=' || p_brand || ' name=' || p_name, 'brand=(\\S+)', 1) AS brand,
 left('xn76urx1', 4) AS area, md5(p_name) AS hash, substr(sha256(p_name), 1, 8) AS short FROM part""")
def text_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    tags = F.concat(F.lit("amenity=x brand="), "p_brand", F.lit(" name="), name)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.leaf(F.concat(F.lit("A > "), "p_type", F.lit(" > "), name)).alias("leaf"), F.regexp_extract(tags, r"brand=(\S+)", 1).alias("brand"),
        F.left(F.lit("xn76urx1"), F.lit(4)).alias("area"), F.md5(name).alias("hash"), F.substring(F.sha2(name, 256), 1, 8).alias("short"),
    )


@query("""WITH t AS (SELECT o_orderkey AS id, 'lunch for ¥' || (o_custkey * 7) || ' or ' || CAST(o_totalprice / 100 AS INT) || ' yen' AS s FROM orders),
n AS (SELECT id, list_min(list_filter([o_custkey * 7, CAST(o_totalprice / 100 AS INT)], lambda x: x >= 50 AND x >= 10)) AS p FROM t JOIN orders ON o_orderkey = id)
SELECT id, CASE WHEN p < 1000 THEN 'low' WHEN p < 3000 THEN 'mid' WHEN p IS NOT NULL THEN 'high' END AS bucket FROM n""")
def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.round(F.col("o_totalprice") / 100, 0).cast("int")
    s = F.concat(F.lit("lunch for ¥"), (F.col("o_custkey") * 7).cast("string"), F.lit(" or "), n.cast("string"), F.lit(" yen"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.price_bucket(s).alias("bucket"))


@query("SELECT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm, length(p_name) AS n FROM part GROUP BY ALL")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC runs once per distinct name, in Arrow batches."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", text.norm(F.col("name")).alias("norm"), F.length("name").cast("long").alias("n"))


@query("SELECT p_partkey AS id, 'https://x.org/' || replace(p_name, ' ', '%20') AS url, replace(p_brand, '#', '_') || '-' || replace(p_name, ' ', '_') AS slug FROM part")
def urls_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://x.org/"), text.quoted(F.col("p_name"))).alias("url"), text.slug(F.col("p_brand"), F.col("p_name")).alias("slug"))


@query("SELECT p_name AS name, count(*) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands, min(p_partkey) AS some FROM part GROUP BY p_name HAVING count(*) >= 3")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("brands"), F.min("p_partkey").alias("some"))
    return g.where("n >= 3")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, name LIMIT 15")
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(15)


@query("SELECT DISTINCT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    ids = c.select(F.col("c_custkey").alias("id"))
    return ids.intersect(o.select(F.col("o_custkey").alias("id"))).exceptAll(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_yet_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import not_done

    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    return not_done(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), done, "id")


@query("SELECT p_partkey AS id, p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 1) AS seen_in_train FROM part WHERE p_partkey % 50 > 1")
def seen_in_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    train = p.where("p_partkey % 50 = 1").select("p_name").distinct().withColumn("seen", F.lit(True))
    return p.where("p_partkey % 50 > 1").join(train, "p_name", "left").select(F.col("p_partkey").alias("id"), F.col("seen").isNotNull().alias("seen_in_train"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey < 500 THEN 'A' WHEN o_custkey BETWEEN 500 AND 899 THEN 'B' WHEN o_custkey BETWEEN 1000 AND 1300 THEN 'C' END AS country FROM orders")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range that holds a value, by an equi-join on buckets."""
    ranges = spark.createDataFrame([(0, 499, "A"), (500, 899, "B"), (1000, 1300, "C")], "lo long, hi long, country string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return resolve.in_ranges(rows, ranges, "o_custkey", 100).select("id", "country")


@query(f"WITH {ITEMS_SQL} SELECT category, count(*) AS n, count(*) FILTER (WHERE cuisine = 'unknown') AS unknown, round(avg(lat), 5) AS lat, round(avg(popularity), 5) AS popularity, count(DISTINCT sub) AS subs FROM items GROUP BY ALL")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("cuisine") == "unknown").alias("unknown"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("popularity"), 5).alias("popularity"), F.count_distinct("sub").alias("subs"))


@query(f"WITH {ITEMS_SQL} SELECT id, CAST(list_position(season, list_max(season)) AS BIGINT) AS peak, list_contains(fine, 'f3') AS has, array_to_string(list_concat(['f0'], list_filter(fine, lambda f: f <> 'f0')), ',') AS front FROM items WHERE fine IS NOT NULL")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = F.concat(F.array(F.lit("f0")), F.filter("fine", lambda f: f != "f0"))
    return items(spark, sf_dir).where("fine is not null").select("id", F.array_position("season", F.array_max("season")).alias("peak"), F.array_contains("fine", "f3").alias("has"), F.array_join(front, ",").alias("front"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, length(props) <= 9 AS small, epoch(date_trunc('second', ts))::BIGINT AS at, month(ts + INTERVAL 9 HOUR) AS mo FROM events")
def json_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    there = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), ts)
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), (F.length("props") <= 9).alias("small"), F.unix_seconds(ts.cast("timestamp")).alias("at"), F.month(there).cast("long").alias("mo"))
