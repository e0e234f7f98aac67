"""Monthly series: shares, log ratios, seasonality, trends, quantiles and clustering of curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import interpolated, nearest_rank

SMOOTHING = 5


def unfold(rows: DataFrame, key: str, monthly: str, lang: str | None = None) -> DataFrame:
    """(key[, lang], ym, views) from a map of YYYYMM to views."""
    keys = [key] + ([lang] if lang else [])
    return rows.select(*keys, F.explode(monthly).alias("ym", "views"))


def complete(series: DataFrame, key: str, months: list[str], ym: str = "ym") -> DataFrame:
    """Series that have every one of the months, cut to them."""
    inside = series.where(F.col(ym).isin(*months))
    whole = inside.groupBy(key).agg(F.count_distinct(ym).alias("_n")).where(F.col("_n") == len(months)).select(key)
    return inside.join(whole, key, "left_semi")


def share(series: DataFrame, value: str, by: list[str], smoothing: float = SMOOTHING) -> DataFrame:
    """`share`: (v + s) over the mean of (v + s) of the same period; periods are summed before they meet the series again."""
    mean = series.groupBy(*by).agg(F.avg(F.col(value) + smoothing).alias("_mean"))
    return series.join(mean, by).withColumn("share", (F.col(value) + smoothing) / F.col("_mean")).drop("_mean")


def log_ratio(a: Column, b: Column) -> Column:
    return F.log2(a / b)


def own_ratio(series: DataFrame, key: str, value: str) -> DataFrame:
    """`ratio`: a value over the mean of its own series."""
    return series.withColumn("ratio", F.try_divide(F.col(value), F.avg(value).over(Window.partitionBy(key))))


def seasonality(series: DataFrame, key: str, value: str, month: Column, *, least_months: int = 12, least_total: float = 1200) -> DataFrame:
    """(key, season): twelve mean ratios to the own mean, 1.0 for months without data."""
    known = series.groupBy(key).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"), F.avg(value).alias("_avg")).where((F.col("_n") >= least_months) & (F.col("_sum") >= least_total))
    ratios = series.withColumn("_m", month).join(known, key)
    by_month = ratios.groupBy(key, "_m").agg(F.round(F.avg(F.col(value) / F.col("_avg")), 2).alias("_r"))
    return by_month.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_m", "_r"))).alias("_by")).select(key, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.try_element_at("_by", m), F.lit(1.0))).alias("season"))


def month_profile(series: DataFrame, key: str, value: str, month: Column) -> DataFrame:
    """(key, m, part): medians by month of the year per day, made to sum to one."""
    days = F.element_at(F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), F.col("m"))
    per_day = series.withColumn("m", month.cast("int")).groupBy(key, "m").agg(F.median(value).alias("_med")).withColumn("_d", F.col("_med") / days)
    return per_day.withColumn("part", F.col("_d") / F.sum("_d").over(Window.partitionBy(key))).select(key, "m", "part")


def annual_level(series: DataFrame, key: str, value: str, month: Column) -> DataFrame:
    """(key, level): the sum of monthly medians, scaled to twelve months."""
    medians = series.withColumn("_m", month).groupBy(key, "_m").agg(F.median(value).alias("_med"))
    return medians.groupBy(key).agg((F.sum("_med") * 12 / F.count("*")).alias("level"))


def z_scores(values: Column) -> Column:
    """Array values less their mean, over their population deviation (zero deviation: zeros)."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    deviation = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return F.transform(values, lambda v: F.when(deviation > 0, (v - mean) / deviation).otherwise(0.0))


def trend(series: DataFrame, key: str, value: str, period: Column, *, epsilon: float = 1e-7, peak: Column | None = None) -> DataFrame:
    """(key, s1, s2, s3, change, trend): shares of three years and a class by how they change.

    `period` is 1, 2, 3. Totals of all keys come from a one-row aggregate.
    """
    years = [F.sum(F.when(period == p, F.col(value)).otherwise(0)) for p in (1, 2, 3)]
    rows = series.groupBy(key).agg(*(y.cast("double").alias(f"y{p}") for p, y in enumerate(years, 1)), *([peak.alias("peak")] if peak is not None else []))
    totals = series.agg(*(y.cast("double").alias(f"t{p}") for p, y in enumerate(years, 1)))
    rows = rows.join(F.broadcast(totals)).withColumns({f"s{p}": F.try_divide(F.col(f"y{p}"), F.col(f"t{p}")) for p in (1, 2, 3)})
    change = (F.col("s3") + epsilon) / (F.col("s1") + epsilon)
    kind = F.when(change >= 1.3, "rising").when(change >= 1.15, "growing").when(change <= 1 / 1.3, "falling").otherwise("steady")
    if peak is not None:
        kind = F.when(F.col("peak") >= 0.3, "event").otherwise(kind)
    return rows.withColumns({"change": change, "trend": kind}).select(key, "s1", "s2", "s3", "change", "trend")


def growth(series: DataFrame, key: str, before: Column, after: Column, smoothing: float = 50) -> DataFrame:
    """(key, growth): log2 of after over before, less the median of all."""
    rows = series.groupBy(key).agg(before.alias("_a"), after.alias("_b")).withColumn("_g", F.log2((F.col("_b") + smoothing) / (F.col("_a") + smoothing)))
    middle = interpolated(rows, "_g", {"_m": 0.5})
    return rows.join(F.broadcast(middle)).select(key, (F.col("_g") - F.col("_m")).alias("growth"))


def clipped_scale(rows: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """`scaled`: log1p of the value, cut to its low and high nearest-rank quantiles, onto 0.2 .. 1.0 (0.2 where the cuts are equal)."""
    marks = nearest_rank(rows, value, [low, high]).agg(F.log1p(F.min(value)).alias("_lo"), F.log1p(F.max(value)).alias("_hi"))
    x = (F.log1p(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return rows.join(F.broadcast(marks)).withColumn("scaled", 0.2 + 0.8 * F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def peak_month(values: Column) -> Column:
    return F.array_position(values, F.array_max(values))


def trough_month(values: Column) -> Column:
    return F.array_position(values, F.array_min(values))


def season_name(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("autumn")


def season_months(day: Column, month: Column) -> Column:
    """Months on offer: with the one before until the 7th, with the next from the 24th."""
    before, after = F.pmod(month - 2, F.lit(12)) + 1, F.pmod(month, F.lit(12)) + 1
    return F.when(day <= 7, F.array(before, month)).when(day <= 23, F.array(month)).otherwise(F.array(month, after))


def average_linkage(curves: list[list[float]], k: int) -> list[int]:
    """Clusters 1..k of curves by average linkage on correlation distance; numbered by first member.

    The mean distance of two groups is one less the product of their mean unit curves, so a group is its
    mean and its size. Chains of nearest neighbours give the merges in any order; the closest n - k of
    them count. Memory grows with the curves, time with their square.
    """
    x = np.asarray(curves, dtype=float)
    x = x - x.mean(axis=1, keepdims=True)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    mean, size, alive = x / np.where(norms > 0, norms, 1), np.ones(len(x)), np.ones(len(x), bool)
    merges, chain = [], []
    while alive.sum() > 1:
        chain = chain or [int(np.argmax(alive))]
        apart = np.where(alive, 1 - mean @ mean[chain[-1]], np.inf)
        apart[chain[-1]] = np.inf
        if len(chain) > 1 and apart[chain[-2]] <= apart.min():
            a, b = sorted((chain.pop(), chain.pop()))
            merges.append((float(1 - mean[a] @ mean[b]), a, b))
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(int(np.argmin(apart)))
    group = np.arange(len(x))
    for _, a, b in sorted(merges)[: len(x) - k]:
        group[group == group[b]] = group[a]
    _, first, back = np.unique(group, return_index=True, return_inverse=True)
    return (np.argsort(np.argsort(first))[back] + 1).tolist()


def clustered(curves: DataFrame, key: str, values: str, k: int) -> DataFrame:
    """(key, cluster) of the curves of categories: a dimension, which one task takes."""
    kind = curves.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        return pd.DataFrame({key: part[key], "cluster": average_linkage(part[values].tolist(), k)})

    return curves.select(key, values, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, f"{key} {kind}, cluster int")


def cluster_curves(curves: DataFrame, clusters: DataFrame, key: str, values: str) -> DataFrame:
    """(cluster, members, curve, peak): the mean curve of each cluster and its month of the greatest mean, in order of that month."""
    points = curves.join(clusters, key).select("cluster", key, F.posexplode(values).alias("m", "v"))
    by_month = points.groupBy("cluster", "m").agg(F.avg("v").alias("v"), F.count_distinct(key).alias("n"))
    whole = by_month.groupBy("cluster").agg(F.max("n").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda p: p["v"]).alias("curve"))
    return whole.withColumn("peak", peak_month(F.col("curve"))).orderBy("peak", "cluster")


def september_year(day: Column) -> Column:
    """The year that begins in September of the year before."""
    return F.year(F.add_months(day, 4))


def added_up(maps: DataFrame, key: str, monthly: str) -> DataFrame:
    """(key, monthly): maps of YYYYMM to views of one key, added up month by month."""
    sums = unfold(maps, key, monthly).groupBy(key, "ym").agg(F.sum("views").alias("views"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ym", "views")))).alias(monthly))
