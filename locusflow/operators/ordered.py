"""Places, running totals and order statistics of whole tables or large groups, without a task that sorts them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import checkpointed

RANGES, SMALL = 256, 16_384


def _sorted_parts(rows: DataFrame, order: list) -> DataFrame:
    """Rows in one total order over partitions, written so that both readings below see the same ones."""
    return checkpointed(rows.orderBy(*order)).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})


def _offsets(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What lies before each partition: a row a partition."""
    each = parts.groupBy("_part").agg(*(c.alias(f"_s_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_part", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """`place` from 0 in a total order of all rows: a range sort, then a count a partition."""
    parts = _sorted_parts(rows, order)
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return parts.join(F.broadcast(_offsets(parts, {"n": F.count("*")})), "_part").withColumn(name, F.col("_before_n") + within).drop("_part", "_at", "_before_n")


def running_totals(rows: DataFrame, order: list, values: list[str]) -> DataFrame:
    """`<value>_before`: the sum of a value over all rows before, in a total order."""
    parts = _sorted_parts(rows, order)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    out = summed.join(F.broadcast(_offsets(parts, {v: F.sum(v) for v in values})), "_part")
    return out.withColumns({f"{v}_before": F.col(f"_before_{v}") + F.col(f"_in_{v}") for v in values}).drop("_part", "_at", *(f"_{k}_{v}" for k in ("in", "before") for v in values))


def order_statistics(rows: DataFrame, value: str, marks: dict[str, Callable[[Column], Column]], by: list[str] | None = None) -> DataFrame:
    """(by, mark, n, value): the values at places 0..n-1 of the sorted rows that aren't null; marks give a place from n.

    Spark's percentile sketch brackets each mark's value between two cuts; one pass counts what lies below each
    bracket, and only values inside it - three in 256, or all of a small group - are counted by value and
    sorted. The brackets are written first, for both readings must use the same ones.
    """
    by = by or []
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sketch = F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 16 * RANGES)
    groups = known.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_cuts")).where("n > 0")
    names, brackets = list(marks), []
    for i, place in enumerate(marks.values()):
        at = place(F.col("n")).cast("bigint")
        j = F.floor(at * RANGES / F.col("n")).cast("int")  # cuts[t] is the value of (t + 1) / RANGES
        small = F.col("n") <= SMALL
        low = F.when(small | (j < 2), F.col("_min")).otherwise(F.get("_cuts", j - 2))
        high = F.when(small | (j + 1 > RANGES - 2), F.col("_max")).otherwise(F.get("_cuts", j + 1))
        brackets += [at.alias(f"_at{i}"), low.alias(f"_low{i}"), high.alias(f"_high{i}")]
    cuts = checkpointed(groups.select(*by, "n", *brackets))
    met = known.join(cuts, by) if by else known.join(F.broadcast(cuts))
    sums = met.groupBy(*by).agg(*(F.count_if(F.col("_v") < F.col(f"_low{i}")).alias(f"_b{i}") for i in range(len(names))))
    each = F.array(*(F.struct(F.lit(m).alias("mark"), F.col(f"_b{i}").alias("before")) for i, m in enumerate(names)))
    before = sums.select(*by, F.explode(each).alias("_x")).select(*by, "_x.mark", "_x.before")
    inside = F.array(*(F.when(F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}")), F.struct(F.lit(m).alias("mark"), F.col(f"_at{i}").alias("at"))) for i, m in enumerate(names)))
    held = F.lit(False)
    for i in range(len(names)):
        held |= F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}"))
    near = met.where(held).select(*by, "n", "_v", F.explode(F.array_compact(inside)).alias("_x"))
    near = near.groupBy(*by, "n", F.col("_x.mark").alias("mark"), F.col("_x.at").alias("at"), "_v").agg(F.count("*").alias("_c"))
    near = near.join(before if by else F.broadcast(before), [*by, "mark"])
    upto = F.col("before") + F.sum("_c").over(Window.partitionBy(*by, "mark").orderBy("_v"))
    found = near.withColumn("_upto", upto).where((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_c")))
    return found.select(*by, "mark", "n", F.col("_v").alias(value))


def nearest_rank(rows: DataFrame, value: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value): the element at place floor(q n) of the sorted values, at most the last."""
    marks = {repr(float(q)): (lambda q: lambda n: F.least(n - 1, F.floor(n * F.lit(float(q)))))(q) for q in quantiles}
    return order_statistics(rows, value, marks, by).select(*(by or []), F.col("mark").cast("double").alias("q"), value)


def interpolated(rows: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, names): quantiles by linear interpolation between the two values about place q (n - 1)."""
    marks = {}
    for name, q in quantiles.items():
        marks[f"{name}<"] = (lambda q: lambda n: F.floor((n - 1) * F.lit(float(q))))(q)
        marks[f"{name}>"] = (lambda q: lambda n: F.ceil((n - 1) * F.lit(float(q))))(q)
    found = order_statistics(rows, value, marks, by)
    pick = lambda m: F.max(F.when(F.col("mark") == m, F.col(value)))
    sides = found.groupBy(*(by or [])).agg(F.max("n").alias("_n"), *(pick(m).alias(f"_{m}") for m in marks))

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"`_{name}<`"), F.col(f"`_{name}>`")
        part = (F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q)))
        return (low + (high - low) * part).alias(name)

    return sides.select(*(by or []), *(between(name, q) for name, q in quantiles.items()))
