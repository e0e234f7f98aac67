"""Queries around models, labels and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as e
from ..operators import learning as m
from ..operators import resolve, series
from .registry import query, table
from .tables import EVENTS_SQL, ITEMS_SQL, events, items, m_sql

LABELS = ["a", "b", "c", "d"]
_LOGITS = "v AS (SELECT vec_id, list_transform(CAST(embedding[1:4] AS DOUBLE[]), lambda x: 1 / (1 + exp(-10 * x))) AS p, list_filter(['a', 'b', 'c', 'd'], lambda l: (vec_id + (CASE l WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 ELSE 3 END)) % 3 = 0) AS labels FROM embeddings)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.filter(F.array(*map(F.lit, LABELS)), lambda l: (F.col("vec_id") + F.instr(F.lit("abcd"), l) - 1) % 3 == 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: m.sigmoid(10 * x.cast("double"))).alias("p"), labels.alias("labels"))


@query(f"WITH {_LOGITS} SELECT vec_id, ['a', 'b', 'c', 'd'][list_position(p, list_max(p))] AS label, round(list_max(p), 5) AS score, list_max(p) >= 0.8 AS sure, array_to_string(list_transform(['a', 'b', 'c', 'd'], lambda l: list_contains(labels, l)::INT), '') AS hot FROM v")
def decided_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigmoids of logits, the label of the greatest, whether it is sure, and a multi-hot form of the right labels."""
    d = m.decided(F.col("p"), LABELS)
    hot = F.array_join(F.transform(m.multi_hot(F.col("labels"), LABELS), lambda x: x.cast("string")), "")
    return _logits(spark, sf_dir).select("vec_id", d["label"].alias("label"), F.round(d["score"], 5).alias("score"), d["sure"].alias("sure"), hot.alias("hot"))


@query(f"""WITH {_LOGITS}, x AS (SELECT vec_id, list_contains(labels, ['a', 'b', 'c', 'd'][k])::INT AS y, (p[k] >= 0.5)::INT AS z, k, (k = list_position(p, list_max(p)))::INT AS first FROM v, (SELECT unnest([1, 2, 3, 4]) AS k)),
s AS (SELECT k, sum(y * z) AS tp, sum((1 - y) * z) AS fp, sum(y * (1 - z)) AS fn FROM x GROUP BY k)
SELECT (SELECT count(*) FROM v) AS n, (SELECT round(sum(y * first) / count(DISTINCT vec_id), 5) FROM x) AS hit1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 5) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 5) AS micro_f1 FROM s""")
def multi_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.multi_label_figures(_logits(spark, sf_dir), "labels", "p", LABELS).select("n", *(F.round(c, 5).alias(c) for c in ("hit1", "macro_f1", "micro_f1")))


_HITS = "h AS (SELECT p_partkey AS id, 'f' || (p_size % 8) AS predicted, (p_partkey * 37 % 101) / 100.0::DOUBLE AS score, CASE WHEN p_partkey % 4 = 0 THEN ['f' || (p_size % 8), 'f1'] ELSE ['f' || (p_partkey % 8)] END AS gold FROM part)"
_OVER = "(list_contains(gold, predicted) OR list_has_any(CASE predicted WHEN 'f1' THEN ['f2', 'f3'] WHEN 'f4' THEN ['f5'] ELSE [] END, gold) OR list_has_any(flatten(list_transform(gold, lambda g: CASE g WHEN 'f1' THEN ['f2', 'f3'] WHEN 'f4' THEN ['f5'] ELSE [] END)), [predicted]))"


@query(f"""WITH {_HITS}, x AS (SELECT *, list_contains(gold, predicted)::INT AS e, list_contains(list_transform(gold, lambda g: substr(g, 2)::INT % 5), substr(predicted, 2)::INT % 5)::INT AS p, {_OVER}::INT AS o FROM h), t AS (SELECT unnest([0.5, 0.8])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS covered, round(avg((score >= threshold)::INT), 5) AS coverage, round(avg(e) FILTER (WHERE score >= threshold), 5) AS precision, round(avg(p) FILTER (WHERE score >= threshold), 5) AS parent_hit, round(avg(o) FILTER (WHERE score >= threshold), 5) AS overlap_hit FROM x, t GROUP BY threshold""")
def hits_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of sure predictions, and how many share a parent or an overlap with a right label."""
    from .tables import TAXONOMY as t

    n, code = F.col("p_partkey"), lambda x: F.concat(F.lit("f"), x.cast("string"))
    rows = table(spark, sf_dir, "part").select(n, code(F.col("p_size") % 8).alias("predicted"), (n * 37 % 101 / 100.0).alias("score"), F.when(n % 4 == 0, F.array(code(F.col("p_size") % 8), F.lit("f1"))).otherwise(F.array(code(n % 8))).alias("gold"))
    out = m.hit_thresholds(rows, predicted="predicted", score="score", gold="gold", parents=t.parent, also=t.also, marks=[0.5, 0.8])
    return out.select("threshold", "covered", *(F.round(c, 5).alias(c) for c in ("coverage", "precision", "parent_hit", "overlap_hit")))


@query("WITH v AS (SELECT vec_id, list_transform(generate_series(0, 3), lambda i: CAST(embedding[i * 8 + 1:i * 8 + 8] AS DOUBLE[])) AS vs FROM embeddings), s AS (SELECT vec_id, list_transform(generate_series(1, 8), lambda j: (vs[1][j] + CASE WHEN vec_id % 2 = 0 THEN vs[2][j] ELSE 0 END + vs[3][j]) / CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 2 END) AS mean FROM v), l AS (SELECT *, sqrt(list_inner_product(mean, mean)) AS len FROM s) SELECT vec_id, round(mean[1] / len, 5) AS x, round(mean[8] / len, 5) AS y FROM l")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked means of four vectors, scaled to length one."""
    parts = F.array(*(F.transform(F.slice("embedding", 8 * i + 1, 8), lambda x: x.cast("double")) for i in range(4)))
    mask = F.array(F.lit(1), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0), F.lit(1), F.lit(0))
    v = m.pooled(parts, mask)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(v, F.lit(0)), 5).alias("x"), F.round(F.get(v, F.lit(7)), 5).alias("y"))


_ROUND = "f{n} AS (SELECT node, sum(x) AS x FROM (SELECT s.a AS node, 0.2::DOUBLE * s.s * f{m}.x AS x FROM s JOIN f{m} ON f{m}.node = s.b UNION ALL SELECT node, x FROM f0) GROUP BY node)"


@query(f"""WITH l AS (SELECT 'p' || (l_partkey % 40) AS a, 's' || (l_suppkey % 30) AS b, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL), bo AS (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l), dg AS (SELECT a, sum(w) AS d FROM bo GROUP BY a),
s AS (SELECT bo.a, bo.b, w / sqrt(x.d * y.d) AS s FROM bo JOIN dg x ON x.a = bo.a JOIN dg y ON y.a = bo.b), f0 AS (SELECT 'p' || n_nationkey AS node, 0.8::DOUBLE * (n_nationkey % 2) AS x FROM nation), {', '.join(_ROUND.format(n=n, m=n - 1) for n in range(1, 5))} SELECT node, round(x, 6) AS score FROM f4""")
def spread_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of some nodes spread over a weighted graph, four rounds."""
    code = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    links = table(spark, sf_dir, "lineitem").groupBy(code("p", F.col("l_partkey") % 40).alias("a"), code("s", F.col("l_suppkey") % 30).alias("b")).agg(F.count("*").cast("double").alias("weight"))
    seeds = table(spark, sf_dir, "nation").select(code("p", F.col("n_nationkey")).alias("node"), (F.col("n_nationkey") % 2).cast("double").alias("y"))
    return m.spread(links, seeds, rounds=4).select("node", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT o_orderpriority AS model, o_custkey AS i, o_orderkey % 500 AS o, o_orderstatus = 'F' AS batch FROM orders) SELECT model, count(*) AS requests, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum((i * 0.25::DOUBLE + o * 2.0::DOUBLE) / 1e6 * CASE WHEN batch THEN 0.5 ELSE 1.0 END), 6) AS dollars FROM q GROUP BY model")
def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and dollars of a log of model calls."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("tokens_in"), (F.col("o_orderkey") % 500).alias("tokens_out"), (F.col("o_orderstatus") == "F").alias("batch"))
    return m.costs(rows, by="model", dollars_in=0.25, dollars_out=2.0).withColumn("dollars", F.round("dollars", 6))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_type END AS cat FROM part WHERE p_partkey % 2 = 1 AND (p_partkey % 5 = 0 OR p_size % 3 = 0) ORDER BY id LIMIT 100")
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the first pass wasn't sure of."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.col("p_type")).alias("cat"), F.when(n % 5 == 0, "low").otherwise("high").alias("conf"), (n % 2).alias("stage"))
    return m.second_pass(rows, 100).select("id", "cat")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND p_type IN ('ECONOMY', 'PROMO') AND NOT regexp_matches(p_name, '(?i)gear|BOLT') THEN 'unknown' ELSE p_type END AS label FROM part")
def corrected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that an object's tag calls for is doubted where the name has no word for it."""
    tag = F.when(F.col("p_size") % 2 == 0, "amenity=pub").otherwise("amenity=cafe")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), m.corrected(F.col("p_type"), tag, F.col("p_name"), ["gear", "BOLT"], wrong=["ECONOMY", "PROMO"], tags="amenity=pub").alias("label"))


@query("WITH b AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY md5(p_brand), p_brand LIMIT 10), k AS (SELECT p_partkey AS id, p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR)) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM b)) SELECT id, brand FROM k WHERE n = 1")
def one_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each of ten brands, in an order by hash."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return m.one_each(rows, "brand", F.md5(F.col("id").cast("string").cast("binary")), 10)


@query("SELECT event_type AS list, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) % 6 > 0) AS rated, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 6 > 0 THEN CAST(json_extract_string(props, '$.k') AS INT) % 6 END), 5) AS mean FROM events GROUP BY ALL")
def list_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("k") % 6).alias("rating"), "event_id").join(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("list")), "event_id")
    return m.ratings(rows, "list").withColumn("mean", F.round("mean", 5))


@query("""WITH k AS (SELECT p_partkey AS id, p_name AS name, floor((row_number() OVER (ORDER BY p_partkey) - 1) / 25)::BIGINT AS request, row_number() OVER (ORDER BY p_partkey) AS p FROM part)
SELECT floor(request / 4)::BIGINT AS file, request, count(*) AS n, '{"custom_id":"r' || request || '","prompt":"label","rows":[' || string_agg('{"id":' || id || ',"name":"' || name || '"}', ',' ORDER BY p) || ']}' AS body FROM k GROUP BY request""")
def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in requests of 25 as JSON bodies, four requests a file."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return m.requests(rows, per_request=25, per_file=4, columns=["id", "name"], order=["id"], prompt="label")


@query("SELECT p_partkey AS id, regexp_matches(p_name, 'small|old')::INT AS cheap, regexp_matches(p_name, '\\bred\\b')::INT AS local, CASE WHEN p_size % 2 = 0 THEN '鳥' || p_size WHEN p_size % 3 = 0 THEN 'カ' END AS ja FROM part")
def attributes_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by patterns, and the first alternative name in Japanese letters."""
    f = m.attribute_flags(F.upper("p_name"), {"cheap": "small|old", "local": r"\bred\b"})
    names = F.concat_ws(" or ", F.lit("plain"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x; 鳥"), F.col("p_size").cast("string"), F.lit(" "))), F.when(F.col("p_size") % 3 == 0, "カ"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), f["cheap"].alias("cheap"), f["local"].alias("local"), m.alternative_name(names).alias("ja"))


@query("""WITH g AS (SELECT p_partkey AS id, p_type AS label FROM part WHERE p_partkey % 3 > 0), a AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'PROMO' ELSE p_type END AS label FROM part WHERE p_partkey % 5 > 0), b AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'PROMO' ELSE p_type END AS label FROM part),
x AS (SELECT g.label AS g, a.label AS a, b.label AS b FROM g JOIN a USING (id) JOIN b USING (id)), c AS (SELECT label, count(*) AS n FROM g GROUP BY label)
SELECT 'before' AS version, count(*) AS n, round(avg((g = a)::INT), 5) AS agreement FROM x UNION ALL SELECT 'after', count(*), round(avg((g = b)::INT), 5) FROM x
UNION ALL SELECT 'gold', count(*), round(avg((g.label = a.label)::INT), 5) FROM g JOIN a USING (id) UNION ALL SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1), NULL, round(max(n) / sum(n), 5) FROM c""")
def versions_and_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label versions against a directory, one against gold labels, and the commonest label alone."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), "p_size")
    gold = p.where("id % 3 > 0").select("id", "label")
    before = p.where("id % 5 > 0").select("id", F.when(F.col("p_size") % 4 == 0, "PROMO").otherwise(F.col("label")).alias("label"))
    after = p.select("id", F.when(F.col("p_size") % 9 == 0, "PROMO").otherwise(F.col("label")).alias("label"))
    out = e.two_versions(before, after, gold, "id", "label").unionByName(e.scored_against(gold, before, "id", "label").select(F.lit("gold").alias("version"), "n", F.col("accuracy").alias("agreement")))
    base = e.majority_baseline(gold, "label").select(F.col("label").alias("version"), F.lit(None).cast("bigint").alias("n"), F.col("share").alias("agreement"))
    return out.unionByName(base).withColumn("agreement", F.round("agreement", 5))


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT 34.9 + ((s_suppkey * 6007) % 20011) * 0.00001::DOUBLE AS r_lat, 138.9 + ((s_suppkey * 8081) % 20021) * 0.00001::DOUBLE AS r_lon FROM supplier),
h AS (SELECT DISTINCT id FROM items, s WHERE abs(floor(lat / 0.006) - floor(r_lat / 0.006)) <= 1 AND abs(floor(lon / 0.006) - floor(r_lon / 0.006)) <= 1)
SELECT sub, count(*) AS n, count(h.id) AS near FROM items LEFT JOIN h USING (id) GROUP BY sub HAVING count(h.id) >= 0.6 * count(*)""")
def mostly_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups most of whose members have a row of another table near by."""
    n = F.col("s_suppkey")
    right = table(spark, sf_dir, "supplier").select((F.lit(34.9) + n * 6007 % 20011 * F.lit(0.00001)).alias("r_lat"), (F.lit(138.9) + n * 8081 % 20021 * F.lit(0.00001)).alias("r_lon"))
    left = items(spark, sf_dir).select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), "sub")
    return resolve.mostly_near(left, right, 0.006, "sub", 0.6)


_ALT = "regexp_replace({0}.name, '[^a-z0-9]', '', 'g')"


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT s_suppkey AS r_id, 34.9 + ((s_suppkey * 6007) % 20011) * 0.00001::DOUBLE AS r_lat, 138.9 + ((s_suppkey * 8081) % 20021) * 0.00001::DOUBLE AS r_lon, CASE s_suppkey % 3 WHEN 0 THEN ['redbolt', 'gear'] WHEN 1 THEN ['plate'] ELSE ['oldring', 'xx'] END AS alt FROM supplier),
p AS (SELECT r_id, id, {m_sql('r_lat', 'r_lon', 'lat', 'lon')} AS d, row_number() OVER (PARTITION BY r_id ORDER BY {m_sql('r_lat', 'r_lon', 'lat', 'lon')}, id) AS n FROM w, items i WHERE len(list_filter(alt, lambda a: contains(a, {_ALT.format('i')}) OR contains({_ALT.format('i')}, a))) > 0 AND {m_sql('r_lat', 'r_lon', 'lat', 'lon')} <= 900)
SELECT r_id AS page, id, round(d, 3) AS dist_m FROM p WHERE n = 1""")
def any_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place of which any name is any of an entry's names."""
    n = F.col("s_suppkey")
    names = F.when(n % 3 == 0, F.array(F.lit("redbolt"), F.lit("gear"))).when(n % 3 == 1, F.array(F.lit("plate"))).otherwise(F.array(F.lit("oldring"), F.lit("xx")))
    left = table(spark, sf_dir, "supplier").select(n.alias("l_id"), (F.lit(34.9) + n * 6007 % 20011 * F.lit(0.00001)).alias("l_lat"), (F.lit(138.9) + n * 8081 % 20021 * F.lit(0.00001)).alias("l_lon"), names.alias("l_keys"))
    right = items(spark, sf_dir).select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.array("name_key").alias("r_keys"))
    found = resolve.nearest_match(left, right, metres=900.0, names=True)
    return found.select(F.col("l_id").alias("page"), F.col("r_id").alias("id"), F.round("dist_m", 3).alias("dist_m"))


@query("""WITH k AS (SELECT o_orderkey AS id, unnest(list_distinct(['c' || (o_custkey + 700), 'c' || o_custkey, 'c' || (o_custkey % 10)])) AS key FROM orders) SELECT id, key, c_mktsegment AS value FROM k JOIN customer ON key = 'c' || c_custkey WHERE c_custkey % 2 = 0""")
def all_known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a joined key that a dimension holds."""
    c = F.col("o_custkey")
    part = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("; ", part(c + 700), part(c), part(c % 10)).alias("key"))
    dim = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(part(F.col("c_custkey")).alias("key"), F.col("c_mktsegment").alias("value"))
    return resolve.all_known_keys(rows, dim, key="key", value="value")


@query(f"WITH {EVENTS_SQL}, t AS (SELECT type AS policy, CAST(ts AS DATE)::VARCHAR AS day, value > 30 AS chosen, k % 8 + 1 AS rank FROM ev) SELECT policy, day, count(*) AS turns, round(avg(chosen::INT), 5) AS success, round(avg(rank) FILTER (WHERE chosen), 5) AS mean_rank FROM t GROUP BY ALL")
def simulation_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).select(F.col("type").alias("policy"), F.to_date("ts").cast("string").alias("day"), (F.col("value") > 30).alias("chosen"), F.lit(1).alias("turn"), (F.col("k") % 8 + 1).alias("rank"), F.lit(8).alias("shown"), F.lit(1).alias("subs"))
    return e.simulation_summary(t, "policy", "day").select("policy", "day", "turns", F.round("success", 5).alias("success"), F.round("mean_rank", 5).alias("mean_rank"))


@query("""WITH m AS (SELECT c_nationkey AS qid, strftime(o_orderdate, '%Y%m') AS ym, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT qid % 5 AS kind, string_agg(ym || ':' || v, ',' ORDER BY ym) AS months FROM (SELECT qid % 5 AS qid, ym, sum(v)::BIGINT AS v FROM m GROUP BY ALL) GROUP BY ALL""")
def added_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of months to views added up by kind."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("ym"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m_ = o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "ym").agg(F.count("*").alias("v"))
    maps = m_.groupBy((F.col("c_nationkey") % 5).alias("kind"), "c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("ym", "v"))).alias("monthly"))
    out = series.added_up(maps, "kind", "monthly")
    line = F.transform(F.array_sort(F.map_entries("monthly")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return out.select("kind", F.array_join(line, ",").alias("months"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a&b <c> é' ELSE 'a&b' END AS plain, 'k=v w=' || page_id AS tags, CASE WHEN page_id % 3 = 0 THEN 'q' || page_id END AS snippet FROM pages")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as characters, percent codes as letters, maps as text, and a second look-up where the first has nothing."""
    n = F.col("page_id")
    raw = F.when(n % 2 == 0, "a&amp;b &lt;c&gt; &eacute;").otherwise(F.url_decode(F.lit("a%26b")))
    tags = text.map_string(F.create_map(F.lit("k"), F.lit("v"), F.lit("w"), n.cast("string")))
    first, second = F.when(n % 6 == 0, F.concat(F.lit("q"), n.cast("string"))), F.when(n % 6 == 3, F.concat(F.lit("q"), n.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", text.unescape(raw).alias("plain"), tags.alias("tags"), F.coalesce(first, second).alias("snippet"))


_WIKI = "'intro {{eat|name=A' || p_partkey || '|price=x}}' || chr(10) || '== Eat ==' || chr(10) || '{{Listing | NAME=' || p_name || ' | alt=[[a|b]] | lat=1}} {{listing|lat=2}}' || chr(10) || '== See ==' || chr(10) || '{{listing|name=no}}{{drink|name=D|name=E' || p_size || '}}'"


@query("SELECT p_partkey AS page, unnest([0, 2, 6]) AS place, unnest(['eat', 'eat', 'drink']) AS kind, unnest([NULL, 'eat', 'see']) AS section, unnest(['A' || p_partkey, p_name, 'E' || p_size]) AS name, unnest([NULL, '[[a|b]]', NULL]) AS alt FROM part")
def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates on pages with the section they stand in."""
    from ..operators import build

    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.expr(_WIKI.replace("chr(10)", "char(10)")).alias("body"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return build.listings(pages, "page", "body").select("page", "place", "kind", "section", field("name").alias("name"), field("alt").alias("alt"))


@query("""WITH r AS (SELECT p_name AS name, CASE WHEN p_size % 5 = 0 THEN ['f' || (p_size % 3), 'f' || (p_partkey % 4)] WHEN p_size % 7 > 0 THEN ['f' || (p_size % 3)] ELSE [] END AS fine FROM part), k AS (SELECT name, list_distinct(fine) AS fine, fine[1] AS first FROM r WHERE len(fine) > 0),
o AS (SELECT name, count(*) AS whole FROM k GROUP BY name), c1 AS (SELECT name, first, count(*) AS n FROM k GROUP BY ALL), l AS (SELECT name, arg_min(first, (-n, first)) AS label FROM c1 GROUP BY name),
c AS (SELECT name, code, count(*) AS n FROM (SELECT name, unnest(fine) AS code FROM k) GROUP BY ALL), x AS (SELECT c.name, list(code ORDER BY code) FILTER (WHERE code <> label) AS others FROM c JOIN o USING (name) JOIN l USING (name) WHERE n >= 0.2 * whole GROUP BY c.name),
w AS (SELECT l.name, label, list_concat([label], coalesce(others, [])) AS labels, row_number() OVER (PARTITION BY label ORDER BY md5(l.name), l.name) AS p FROM l LEFT JOIN x USING (name)), q AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM w WHERE p <= 20)
SELECT name, label, array_to_string(labels, ',') AS labels, CASE WHEN p <= greatest(1, floor(n * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM q""")
def name_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set of names from the codes of the places that bear them."""
    from ..operators import labels

    size = F.col("p_size")
    code = lambda x: F.concat(F.lit("f"), x.cast("string"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.when(size % 5 == 0, F.array(code(size % 3), code(F.col("p_partkey") % 4))).when(size % 7 > 0, F.array(code(size % 3))).otherwise(F.array().cast("array<string>")).alias("fine"))
    out = labels.dataset(rows, F.col("name"), text.bare(F.col("name")), "fine", cap=20)
    return out.select("name", "label", F.array_join("labels", ",").alias("labels"), "part")


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY ALL")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters after a second lot of events."""
    from ..operators import logs

    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    have = ev.where("event_id % 3 = 0").groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return logs.counted_up(have, ev.where("event_id % 3 = 2"), ["user_id", "day"])


@query(f"WITH {EVENTS_SQL} SELECT type AS policy, round(avg((value > 30)::INT) FILTER (WHERE k % 3 = 0 AND k % 4 > 0), 5) AS food_success, round(avg(CASE WHEN k % 5 > 0 THEN (k % 2 = 0)::INT END), 5) AS compliance FROM ev GROUP BY ALL")
def simulation_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t = events(spark, sf_dir).select(F.col("type").alias("policy"), (F.col("value") > 30).alias("chosen"), F.lit(1).alias("turn"), F.lit(1).alias("rank"), F.lit(8).alias("shown"), F.lit(1).alias("subs"), k)
    out = e.simulation_summary(t, "policy", plain_food=(k % 3 == 0) & (k % 4 > 0), complied=F.when(k % 5 > 0, k % 2 == 0))
    return out.select("policy", F.round("food_success", 5).alias("food_success"), F.round("compliance", 5).alias("compliance"))


@query("""WITH f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS query, min(s_name) AS one, count(*) AS n FROM part JOIN supplier ON s_suppkey = p_partkey % 100 + 1 WHERE p_size % 3 > 0 GROUP BY ALL),
a AS (SELECT p_partkey AS id, p_name AS name, p_brand AS area FROM part) SELECT a.id, coalesce(x.one, y.one) AS snippet FROM a LEFT JOIN f x ON x.query = a.name || ' ' || a.area LEFT JOIN f y ON y.query = a.name""")
def snippets_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found for a name with its area, or else for the name alone."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    asked = F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    met = part.where("p_size % 3 > 0").join(supplier, F.col("s_suppkey") == F.col("p_partkey") % 100 + 1)
    found = met.groupBy(asked.alias("query")).agg(F.array(F.min("s_name")).alias("snippets"))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"))
    return m.with_snippets(rows, found, name="name", area="area").select("id", F.get("snippets", F.lit(0)).alias("snippet"))
