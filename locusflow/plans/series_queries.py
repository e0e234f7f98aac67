"""Monthly-series queries over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import series as s
from .registry import query, table

_M = "m AS (SELECT c_nationkey AS qid, o_orderpriority AS lang, strftime(o_orderdate, '%Y%m') AS ym, count(*) AS views FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), q AS (SELECT qid, ym, CAST(sum(views) AS BIGINT) AS views FROM m GROUP BY ALL)"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyyMM").alias("ym"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("qid"), F.col("o_orderpriority").alias("lang"), "ym").agg(F.count("*").alias("views"))


def _by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).groupBy("qid", "ym").agg(F.sum("views").alias("views"))


@query(f"WITH {_M} SELECT qid, lang, ym, round((views + 5) / (sum(views + 5) OVER (PARTITION BY lang, ym)) * count(*) OVER (PARTITION BY lang, ym), 6) AS share FROM m")
def smoothed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.share(_monthly(spark, sf_dir), "views", ["lang", "ym"]).select("qid", "lang", "ym", F.round("share", 6).alias("share"))


@query(f"""WITH {_M}, sh AS (SELECT qid, lang, ym, (views + 5) / (sum(views + 5) OVER (PARTITION BY lang, ym)) * count(*) OVER (PARTITION BY lang, ym) AS share FROM m),
p AS (SELECT qid, ym, max(share) FILTER (WHERE lang = '1-URGENT') AS a, max(share) FILTER (WHERE lang = '2-HIGH') AS b, max(share) FILTER (WHERE lang = '5-LOW') AS c FROM sh GROUP BY ALL)
SELECT qid, ym, round(log2(a / b), 5) AS local, round(least(log2(a / b), log2(a / c)), 5) AS known FROM p WHERE a IS NOT NULL AND (b IS NOT NULL OR c IS NOT NULL)""")
def language_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log ratios of shares between languages; the least of those that exist."""
    sh = s.share(_monthly(spark, sf_dir), "views", ["lang", "ym"])
    pick = lambda lang: F.max(F.when(F.col("lang") == lang, F.col("share")))
    p = sh.groupBy("qid", "ym").agg(pick("1-URGENT").alias("a"), pick("2-HIGH").alias("b"), pick("5-LOW").alias("c")).where("a is not null and (b is not null or c is not null)")
    ab, ac = s.log_ratio(F.col("a"), F.col("b")), s.log_ratio(F.col("a"), F.col("c"))
    return p.select("qid", "ym", F.round(ab, 5).alias("local"), F.round(F.least(ab, ac), 5).alias("known"))


@query(f"WITH {_M} SELECT qid, ym, round(views / avg(views) OVER (PARTITION BY qid), 6) AS ratio FROM q")
def own_mean_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.own_ratio(_by_place(spark, sf_dir), "qid", "views").select("qid", "ym", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_M}, k AS (SELECT qid, count(*) AS n, sum(views) AS total, avg(views) AS mean FROM q GROUP BY qid HAVING count(*) >= 12 AND sum(views) >= 100),
r AS (SELECT qid, CAST(substr(ym, 5) AS INT) AS mo, avg(views / mean) AS r FROM q JOIN k USING (qid) GROUP BY ALL) SELECT qid, mo, round(r, 3) AS r FROM r""")
def season_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ratio to the own mean by month of the year."""
    rows = _by_place(spark, sf_dir)
    known = rows.groupBy("qid").agg(F.count("*").alias("n"), F.sum("views").alias("total"), F.avg("views").alias("mean")).where("n >= 12 and total >= 100")
    return rows.join(known, "qid").groupBy("qid", F.substring("ym", 5, 2).cast("int").alias("mo")).agg(F.round(F.avg(F.col("views") / F.col("mean")), 3).alias("r"))


@query(f"""WITH {_M}, k AS (SELECT qid FROM q GROUP BY qid HAVING count(*) >= 12 AND sum(views) >= 100) SELECT qid, array_to_string(list(CAST(coalesce(CAST(round(r * 100) AS INT), 100) AS VARCHAR) ORDER BY m.m), ',') AS season FROM k CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m) m
LEFT JOIN (SELECT qid, CAST(substr(ym, 5) AS INT) AS m, avg(views / mean) AS r FROM q JOIN (SELECT qid, avg(views) AS mean FROM q GROUP BY qid) USING (qid) GROUP BY ALL) s USING (qid, m) GROUP BY qid""")
def season_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.seasonality(_by_place(spark, sf_dir), "qid", "views", F.substring("ym", 5, 2).cast("int"), least_total=100)
    return rows.select("qid", F.array_join(F.transform("season", lambda v: F.round(v * 100).cast("int").cast("string")), ",").alias("season"))


@query(f"""WITH {_M}, d0 AS (SELECT qid, CAST(substr(ym, 5) AS INT) AS m, median(views) AS med FROM q GROUP BY ALL), d AS (SELECT qid, m, med / list_extract([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], m) AS d FROM d0)
SELECT qid, m, round(d / sum(d) OVER (PARTITION BY qid), 6) AS part FROM d""")
def month_of_year_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.month_profile(_by_place(spark, sf_dir), "qid", "views", F.substring("ym", 5, 2)).select("qid", "m", F.round("part", 6).alias("part"))


@query(f"WITH {_M}, d AS (SELECT qid, substr(ym, 5) AS m, median(views) AS med FROM q GROUP BY ALL) SELECT qid, round(sum(med) * 12 / count(*), 4) AS level FROM d GROUP BY qid")
def annual_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.annual_level(_by_place(spark, sf_dir), "qid", "views", F.substring("ym", 5, 2)).select("qid", F.round("level", 4).alias("level"))


_P = "CASE WHEN ym >= '199501' AND ym < '199601' THEN 1 WHEN ym >= '199701' AND ym < '199801' THEN 2 WHEN ym >= '199901' AND ym < '200001' THEN 3 END"


@query(f"""WITH {_M}, y AS (SELECT qid, sum(CASE WHEN {_P} = 1 THEN views ELSE 0 END)::DOUBLE AS y1, sum(CASE WHEN {_P} = 2 THEN views ELSE 0 END)::DOUBLE AS y2, sum(CASE WHEN {_P} = 3 THEN views ELSE 0 END)::DOUBLE AS y3 FROM q GROUP BY qid),
t AS (SELECT sum(y1) AS t1, sum(y2) AS t2, sum(y3) AS t3 FROM y), z AS (SELECT qid, y1 / t1 AS s1, y2 / t2 AS s2, y3 / t3 AS s3, (y3 / t3 + 1e-7) / (y1 / t1 + 1e-7) AS c FROM y, t)
SELECT qid, round(s1, 6) AS s1, round(s3, 6) AS s3, round(c, 5) AS change, CASE WHEN c >= 1.3 THEN 'rising' WHEN c >= 1.15 THEN 'growing' WHEN c <= 1 / 1.3 THEN 'falling' ELSE 'steady' END AS trend FROM z""")
def share_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ym = F.col("ym")
    period = F.when((ym >= "199501") & (ym < "199601"), 1).when((ym >= "199701") & (ym < "199801"), 2).when((ym >= "199901") & (ym < "200001"), 3)
    return s.trend(_by_place(spark, sf_dir), "qid", "views", period).select("qid", F.round("s1", 6).alias("s1"), F.round("s3", 6).alias("s3"), F.round("change", 5).alias("change"), "trend")


@query(f"""WITH {_M}, g AS (SELECT qid, log2((sum(CASE WHEN ym >= '199801' THEN views ELSE 0 END) + 50) / (sum(CASE WHEN ym < '199801' THEN views ELSE 0 END) + 50)::DOUBLE) AS g FROM q GROUP BY qid) SELECT qid, round(g - (SELECT median(g) FROM g), 5) AS growth FROM g""")
def median_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = F.sum(F.when(F.col("ym") < "199801", F.col("views")).otherwise(0)), F.sum(F.when(F.col("ym") >= "199801", F.col("views")).otherwise(0))
    return s.growth(_by_place(spark, sf_dir), "qid", before, after).select("qid", F.round("growth", 5).alias("growth"))


@query(f"WITH {_M}, n AS (SELECT qid, count(DISTINCT ym) AS n FROM q WHERE ym BETWEEN '199601' AND '199612' GROUP BY qid) SELECT qid FROM n WHERE n = 12")
def complete_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = [f"1996{m:02d}" for m in range(1, 13)]
    return s.complete(_by_place(spark, sf_dir), "qid", months).select("qid").distinct()


@query("SELECT round(quantile_cont(o_totalprice, 0.01), 4) AS p1, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def interpolated_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered.interpolated(table(spark, sf_dir, "orders"), "o_totalprice", {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    return found.select(*(F.round(n, 4).alias(n) for n in ("p1", "p50", "p99")))


@query("WITH k AS (SELECT o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice) - 1 AS place, count(*) OVER () AS n FROM orders) SELECT q, value FROM k, (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) v(q) WHERE place = least(n - 1, floor(q * n)::BIGINT)")
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.nearest_rank(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("value")), "value", [0.01, 0.5, 0.99])


@query("""WITH k AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS place, count(*) OVER () AS n FROM orders),
c AS (SELECT ln(1 + max(v) FILTER (WHERE place = floor(0.01::DOUBLE * n)::BIGINT)) AS lo, ln(1 + max(v) FILTER (WHERE place = floor(0.99::DOUBLE * n)::BIGINT)) AS hi FROM k)
SELECT o_orderkey, round(0.2 + 0.8 * least(greatest((ln(1 + o_totalprice) - lo) / (hi - lo), 0), 1), 6) AS scaled FROM orders, c""")
def clipped_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.clipped_scale(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice) / (SELECT max(ln(1 + o_totalprice)) FROM orders), 6) AS level, CASE WHEN o_totalprice >= 400000 THEN 1 WHEN o_totalprice >= 100000 THEN 2 ELSE 3 END AS tier FROM orders")
def popularity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max(F.log1p("o_totalprice")).alias("top"))
    tier = F.when(F.col("o_totalprice") >= 400000, 1).when(F.col("o_totalprice") >= 100000, 2).otherwise(3)
    return o.join(F.broadcast(top)).select("o_orderkey", F.round(F.log1p("o_totalprice") / F.col("top"), 6).alias("level"), tier.alias("tier"))


@query("WITH n AS (SELECT o_custkey, least(count(*), 10) AS links FROM orders GROUP BY ALL) SELECT links, count(*) AS n FROM n GROUP BY ALL")
def link_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.least(F.count("*"), F.lit(10)).alias("links"))
    return counts.groupBy("links").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_extendedprice < 10000 THEN '0-10k' WHEN l_extendedprice < 50000 THEN '10-50k' ELSE '50k+' END AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def distance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(p < 10000, "0-10k").when(p < 50000, "10-50k").otherwise("50k+").alias("bucket")).agg(F.count("*").alias("n"))


_CURVE = f"{_M}, md AS (SELECT qid, CAST(substr(ym, 5) AS INT) AS mo, median(views) AS v FROM q GROUP BY ALL)"


@query(f"WITH {_CURVE}, z AS (SELECT qid, list(v ORDER BY mo) AS vs, avg(v) AS mean, stddev_pop(v) AS sd FROM md GROUP BY qid) SELECT qid, list_transform(vs, lambda v: round((v - mean) / sd, 5)) AS z FROM z")
def curve_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir).select("qid", F.transform(s.z_scores(F.col("vs")), lambda v: F.round(v, 5)).alias("z"))


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = _by_place(spark, sf_dir).groupBy("qid", F.substring("ym", 5, 2).cast("int").alias("mo")).agg(F.median("views").alias("v"))
    return md.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("mo", "v"))), lambda x: x["v"]).alias("vs"))


@query(f"WITH {_CURVE}, l AS (SELECT qid, list(v ORDER BY mo) AS vs FROM md GROUP BY qid) SELECT qid, list_position(vs, list_max(vs)) AS peak, list_position(vs, list_min(vs)) AS trough, CASE WHEN list_position(vs, list_max(vs)) IN (12, 1, 2) THEN 'winter' WHEN list_position(vs, list_max(vs)) <= 5 THEN 'spring' WHEN list_position(vs, list_max(vs)) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM l")
def peaks_and_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = s.peak_month(F.col("vs"))
    return _curves(spark, sf_dir).select("qid", peak.cast("int").alias("peak"), s.trough_month(F.col("vs")).cast("int").alias("trough"), s.season_name(peak).alias("season"))


@query()
def season_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage over some curves; tested against a plain implementation."""
    return s.clustered(_curves(spark, sf_dir), "qid", "vs", 4)


@query(f"""WITH {_M}, g AS (SELECT CAST(substr(ym, 5) AS INT) AS mo, median(views) AS base FROM q GROUP BY ALL), c AS (SELECT qid % 5 AS kind, CAST(substr(ym, 5) AS INT) AS mo, median(views) AS v FROM q GROUP BY ALL)
SELECT kind, mo, round(v / base, 5) AS relative FROM c JOIN g USING (mo)""")
def relative_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_place(spark, sf_dir).withColumn("mo", F.substring("ym", 5, 2).cast("int"))
    rows = rows.select((F.col("qid") % 5).alias("kind"), "mo", "views")
    base = ordered.interpolated(rows, "views", {"base": 0.5}, ["mo"])
    kinds = ordered.interpolated(rows, "views", {"v": 0.5}, ["kind", "mo"])
    return kinds.join(base, "mo").select("kind", "mo", F.round(F.col("v") / F.col("base"), 5).alias("relative"))


@query(f"""WITH {_M}, a AS (SELECT qid % 5 AS kind, CAST(substr(ym, 5) AS INT) AS mo, sum(CASE WHEN lang = '1-URGENT' THEN views END) AS x, sum(CASE WHEN lang = '5-LOW' THEN views END) AS y FROM m GROUP BY ALL) SELECT kind, round(corr(x, y), 5) AS r FROM a GROUP BY kind""")
def curve_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir)
    part = lambda lang: F.sum(F.when(F.col("lang") == lang, F.col("views")))
    a = m.groupBy((F.col("qid") % 5).alias("kind"), F.substring("ym", 5, 2).alias("mo")).agg(part("1-URGENT").alias("x"), part("5-LOW").alias("y"))
    return a.groupBy("kind").agg(F.round(F.corr("x", "y"), 5).alias("r"))


@query(f"WITH {_M}, l AS (SELECT qid, sum(views) AS level FROM q GROUP BY qid) SELECT qid % 5 AS kind, round(median(level), 3) AS mid, round(quantile_cont(level, 0.25), 3) AS low, round(quantile_cont(level, 0.75), 3) AS high FROM l GROUP BY ALL")
def level_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _by_place(spark, sf_dir).groupBy("qid").agg(F.sum("views").alias("level"))  # noqa: E741
    found = ordered.interpolated(l.select((F.col("qid") % 5).alias("kind"), "level"), "level", {"mid": 0.5, "low": 0.25, "high": 0.75}, ["kind"])
    return found.select("kind", *(F.round(n, 3).alias(n) for n in ("mid", "low", "high")))


@query(f"WITH {_M}, a AS (SELECT qid, ym, views FROM m WHERE lang = '1-URGENT'), b AS (SELECT qid, ym, views FROM m WHERE lang = '5-LOW') SELECT a.qid, count(*) AS months, CAST(sum(a.views) AS BIGINT) AS a, CAST(sum(b.views) AS BIGINT) AS b FROM a JOIN b USING (qid, ym) GROUP BY ALL")
def language_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that both languages have, in one pass without a self-join."""
    m = _monthly(spark, sf_dir).where(F.col("lang").isin("1-URGENT", "5-LOW"))
    part = lambda lang: F.sum(F.when(F.col("lang") == lang, F.col("views")))
    both = m.groupBy("qid", "ym").agg(part("1-URGENT").alias("a"), part("5-LOW").alias("b")).where("a is not null and b is not null")
    return both.groupBy("qid").agg(F.count("*").alias("months"), F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("SELECT DISTINCT day(o_orderdate) AS d, month(o_orderdate) AS mo, CASE WHEN day(o_orderdate) <= 7 THEN [(month(o_orderdate) + 10) % 12 + 1, month(o_orderdate)] WHEN day(o_orderdate) <= 23 THEN [month(o_orderdate)] ELSE [month(o_orderdate), month(o_orderdate) % 12 + 1] END AS months FROM orders")
def season_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(d.cast("long").alias("d"), m.cast("long").alias("mo"), F.transform(s.season_months(d, m), lambda x: x.cast("long")).alias("months")).distinct()


@query(f"WITH {_CURVE} SELECT qid, string_agg(substr('▁▂▃▄▅▆▇█', CAST(floor((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 7) + 1 AS INT), 1), '' ORDER BY mo) AS spark FROM (SELECT *, min(v) OVER (PARTITION BY qid) AS lo, max(v) OVER (PARTITION BY qid) AS hi FROM md) GROUP BY qid")
def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import sparkline

    return _curves(spark, sf_dir).select("qid", sparkline(F.col("vs")).alias("spark"))


@query(f"""WITH {_CURVE}, p AS (SELECT qid % 4 AS cluster, qid, row_number() OVER (PARTITION BY qid ORDER BY mo) AS m, v FROM md), g AS (SELECT cluster, m, avg(v) AS v, count(DISTINCT qid) AS n FROM p GROUP BY ALL),
w AS (SELECT cluster, max(n) AS members, list(round(v, 4) ORDER BY m) AS curve, arg_max(m, (v, -m)) AS peak FROM g GROUP BY cluster) SELECT cluster, members, array_to_string(curve, ',') AS curve, CAST(peak AS INT) AS peak FROM w""")
def curves_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean curve of each given cluster of curves, and the month of its peak."""
    curves = _curves(spark, sf_dir)
    found = s.cluster_curves(curves, curves.select("qid", (F.col("qid") % 4).alias("cluster")), "qid", "vs")
    return found.select("cluster", "members", F.array_join(F.transform("curve", lambda v: F.round(v, 4).cast("string")), ",").alias("curve"), F.col("peak").cast("int").alias("peak"))
