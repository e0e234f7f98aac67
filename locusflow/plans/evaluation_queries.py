"""Evaluation queries over labels, vectors and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as e
from .registry import query, table

_P = "p AS (SELECT p_partkey AS id, p_type AS gold, CASE WHEN p_partkey % 4 = 0 THEN 'PROMO' ELSE p_type END AS predicted, (p_partkey * 37 % 101) / 100.0::DOUBLE AS score, p_brand AS method FROM part)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(n.alias("id"), F.col("p_type").alias("gold"), F.when(n % 4 == 0, "PROMO").otherwise(F.col("p_type")).alias("predicted"), (n * 37 % 101 / 100.0).alias("score"), F.col("p_brand").alias("method"))


@query(f"""WITH {_P}, l AS (SELECT DISTINCT gold AS label FROM p UNION SELECT predicted FROM p), f AS (SELECT label, count(*) FILTER (WHERE gold = label AND predicted = label) AS tp, count(*) FILTER (WHERE gold <> label AND predicted = label) AS fp, count(*) FILTER (WHERE gold = label AND predicted <> label) AS fn FROM l, p GROUP BY label)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2 * tp / (2 * tp + fp + fn), 5) AS f1 FROM f""")
def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.per_class(_predictions(spark, sf_dir), "gold", "predicted").withColumn("f1", F.round("f1", 5))


@query(f"""WITH {_P}, l AS (SELECT DISTINCT gold AS label FROM p), f AS (SELECT label, 2 * count(*) FILTER (WHERE gold = label AND predicted = label) / (count(*) FILTER (WHERE gold = label) + count(*) FILTER (WHERE predicted = label)) AS f1 FROM l, p GROUP BY label)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((gold = predicted)::INT) FROM p), 5) AS accuracy, round(avg(f1), 5) AS macro_f1 FROM f""")
def accuracy_and_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.scores(_predictions(spark, sf_dir), "gold", "predicted").select("n", F.round("accuracy", 5).alias("accuracy"), F.round("macro_f1", 5).alias("macro_f1"))


@query(f"WITH {_P} SELECT gold, predicted, count(*) AS n FROM p WHERE gold <> predicted GROUP BY ALL ORDER BY n DESC, gold, predicted LIMIT 8")
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.confusion(_predictions(spark, sf_dir), "gold", "predicted")


@query(f"WITH {_P}, t AS (SELECT unnest([0.5, 0.7, 0.8, 0.9])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS covered, round(avg((score >= threshold)::INT), 5) AS coverage, round(avg((gold = predicted)::INT) FILTER (WHERE score >= threshold), 5) AS precision FROM p, t GROUP BY threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.thresholds(_predictions(spark, sf_dir), "score", F.col("gold") == F.col("predicted"), [0.5, 0.7, 0.8, 0.9])
    return rows.select("threshold", "covered", F.round("coverage", 5).alias("coverage"), F.round("precision", 5).alias("precision"))


@query(f"WITH {_P} SELECT method, count(*) AS n, round(avg((gold = predicted)::INT), 5) AS agreement FROM p GROUP BY ALL")
def agreement_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.agreement(_predictions(spark, sf_dir), "method", F.col("gold") == F.col("predicted")).withColumn("agreement", F.round("agreement", 5))


@query(f"WITH {_P} SELECT method, count(*) FILTER (WHERE gold = 'PROMO') AS promo, count(*) FILTER (WHERE gold = 'SMALL') AS small FROM p GROUP BY ALL")
def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).groupBy("method").pivot("gold", ["PROMO", "SMALL"]).count()
    return rows.select("method", F.coalesce("PROMO", F.lit(0)).alias("promo"), F.coalesce("SMALL", F.lit(0)).alias("small"))


@query("""WITH s AS (SELECT toxic AS y, n_chars % 500 AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, avg(k) OVER (PARTITION BY s) AS k FROM (SELECT *, row_number() OVER (ORDER BY s) AS k FROM s))
SELECT round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 6) AS auc FROM r""")
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 500).alias("s"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("toxic").alias("y"), "s")
    return e.auc(rows, "y", "s").select(F.round("auc", 6).alias("auc"))


_N = """n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm, label FROM embeddings),
s AS (SELECT q.vec_id, r.vec_id AS neighbour, round(list_inner_product(q.v, r.v) / (q.norm * r.norm), 6) AS similarity FROM n q JOIN n r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS place FROM s)"""


@query(f"WITH {_N} SELECT vec_id, neighbour, round(similarity, 4) AS similarity FROM k WHERE place <= 10")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return e.neighbours(rows.where("vec_id % 50 = 0"), rows).select("vec_id", "neighbour", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {_N}, v AS (SELECT k.vec_id, n.label, round(sum(similarity), 6) AS w FROM k JOIN n ON n.vec_id = neighbour WHERE place <= 10 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) AS p FROM v) SELECT vec_id, label AS voted FROM t WHERE p = 1")
def neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return e.voted(e.neighbours(rows.where("vec_id % 50 = 0"), rows), rows.select("vec_id", "label"))


@query("WITH k AS (SELECT event_type AS endpoint, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT endpoint, max(n) AS n, CAST(count(*) FILTER (WHERE value > 60) AS BIGINT) AS errors, max(value) FILTER (WHERE place = least(n - 1, floor(n * 0.5::DOUBLE)::BIGINT)) AS p50, max(value) FILTER (WHERE place = least(n - 1, floor(n * 0.95::DOUBLE)::BIGINT)) AS p95, max(value) FILTER (WHERE place = least(n - 1, floor(n * 0.99::DOUBLE)::BIGINT)) AS p99 FROM k GROUP BY endpoint")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), "value")
    return e.latency(rows, by="endpoint", ms="value", failed=F.col("value") > 60)


@query("WITH a AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey % 3 > 0), b AS (SELECT p_partkey AS id, p_size + (p_partkey % 10 = 0)::INT AS v FROM part WHERE p_partkey % 4 > 0) SELECT id, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id)")
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    b = p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + (F.col("p_partkey") % 10 == 0).cast("int")).alias("v"))
    return e.compared(a, b, ["id"], "v")


@query("WITH c AS (SELECT p_type AS label, count(*) AS n FROM part GROUP BY ALL) SELECT label, n, round(pow(n, -0.5) / (SELECT avg(pow(n, -0.5)) FROM c), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.class_weights(table(spark, sf_dir, "part").select(F.col("p_type").alias("label")), "label").withColumn("weight", F.round("weight", 6))


#: The tables and their columns; `d` a number with a fraction (hashed in hundredths), `t` a time, `v` a vector (in thousandths), others as text.
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal:d c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal:d",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:d", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:d o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag l_linestatus l_shipdate:t", "events": "event_id ts:t user_id event_type value:d props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:v label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _hash_sql(name: str) -> str:
    def part(column: str) -> str:
        c, _, kind = column.partition(":")
        shown = {"d": "CAST(CAST(round({} * 100) AS BIGINT) AS VARCHAR)", "t": "CAST(epoch_us({}) AS VARCHAR)", "v": "array_to_string(list_transform({}, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)), ',')"}.get(kind, "CAST({} AS VARCHAR)").format(c)
        return f"coalesce({shown}, chr(30))"

    row = " || chr(31) || ".join(map(part, _COLUMNS[name].split()))
    return f"SELECT '{name}' AS name, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS sum FROM {name}"


@query(" UNION ALL ".join(map(_hash_sql, _COLUMNS)))
def table_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and an order-free hash of all columns of each table."""

    def part(column: str):
        c, _, kind = column.partition(":")
        x = F.col(c)
        if kind == "d":
            x = F.round(x * 100).cast("bigint")
        elif kind == "t":
            x = F.unix_micros(x.cast("timestamp"))
        elif kind == "v":
            x = F.array_join(F.transform(x, lambda v: F.round(v.cast("double") * 1000).cast("bigint").cast("string")), ",")
        return F.coalesce(x.cast("string"), F.lit("\x1e"))

    parts = []
    for name, columns in _COLUMNS.items():
        row = F.concat_ws("\x1f", *map(part, columns.split()))
        hashed = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
        parts.append(table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(hashed).cast("string").alias("sum")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {name}" for name in _COLUMNS))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table: no column is read."""
    parts = [table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in _COLUMNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("WITH t AS (SELECT event_type AS policy, value > 30 AS chosen, CAST(event_id % 7 AS INT) + 1 AS turn, CAST(event_id % 8 AS INT) + 1 AS rank, 8 - (event_id % 11 = 0)::INT AS shown, CAST(event_id % 5 AS INT) + 3 AS subs FROM events) SELECT policy, count(*) AS turns, round(avg(chosen::INT), 5) AS success, round(avg(chosen::INT) FILTER (WHERE turn >= 4), 5) AS late_success, round(avg(rank) FILTER (WHERE chosen), 5) AS mean_rank, round(avg(subs), 5) AS kinds, round(avg((shown < 8)::INT), 5) AS short FROM t GROUP BY ALL")
def simulation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("policy"), (F.col("value") > 30).alias("chosen"), (n % 7 + 1).alias("turn"), (n % 8 + 1).alias("rank"), (8 - (n % 11 == 0).cast("int")).alias("shown"), (n % 5 + 3).alias("subs"))
    out = e.simulation_summary(t, "policy")
    return out.select("policy", "turns", *(F.round(c, 5).alias(c) for c in ("success", "late_success", "mean_rank", "kinds", "short")))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) - 1 AS best, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def vector_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(v, F.array_max(v)) - 1).alias("best"), F.round(norm, 5).alias("norm"))


@query()
def simulated_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success of four ranking policies over simulated users; tested against single walks."""
    from ..operators.simulate import simulate
    from .tables import items

    turns = simulate(items(spark, sf_dir), 40)
    out = e.simulation_summary(turns, "policy")
    return out.select("policy", "turns", *(F.round(c, 5).alias(c) for c in ("success", "late_success", "mean_rank", "kinds", "short")))
