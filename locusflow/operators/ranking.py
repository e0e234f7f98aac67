"""Ranking: blended scores, top lists with an exploration slot, and learned preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 8
SETTLING, DISTANCE_WEIGHT = 5, 0.1
#: event -> (side, weight)
EVENTS = {"select": ("a", 1.0), "save": ("a", 0.7), "detail": ("a", 0.3), "skip": ("b", 0.3), "say_like": ("a", 3.0), "say_dislike": ("b", 3.0)}


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from an integer key, alike in any engine: one step of a linear congruence."""
    return F.pmod(key * 1103515 + 12345 + seed * 7919, F.lit(1000003)) / 1000003.0


def preferences(events: DataFrame, *, user: str = "user", value: str = "sub", kind: str = "type", position: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(user, value, a, b): Beta counts from 1; a skip counts less the further down it was shown.

    `order` (unique within a user's value): the weights are added one after the other in it, so equal shares come out
    alike however the rows are dealt out; without it, sums differ in the last digit with the partitions.
    """
    weight = {side: F.lit(0.0) for side in "ab"}
    for event, (side, w) in EVENTS.items():
        amount = F.lit(w) / (1 + F.coalesce(position, F.lit(0))) if event == "skip" and position else F.lit(w)
        weight[side] = weight[side] + F.when(F.col(kind) == event, amount).otherwise(0.0)
    known = events.where(F.col(kind).isin(*EVENTS) & F.col(value).isNotNull())
    if order:
        upto = Window.partitionBy(user, value).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        known = known.select(user, value, F.sum(weight["a"]).over(upto).alias("_a"), F.sum(weight["b"]).over(upto).alias("_b"))
        return known.groupBy(user, value).agg((F.lit(1.0) + F.max("_a")).alias("a"), (F.lit(1.0) + F.max("_b")).alias("b"))  # they only grow: the greatest is the last
    return known.groupBy(user, value).agg((F.lit(1.0) + F.sum(weight["a"])).alias("a"), (F.lit(1.0) + F.sum(weight["b"])).alias("b"))


def reactions(events: DataFrame, *, user: str = "user", kind: str = "type") -> DataFrame:
    """(user, n_reactions, w): stated preferences are no reactions; w = n / (n + 5)."""
    n = F.count_if(F.col(kind).isin(*(k for k in EVENTS if not k.startswith("say_"))))
    return events.groupBy(user).agg(n.alias("n_reactions")).withColumn("w", F.col("n_reactions") / (F.col("n_reactions") + SETTLING))


def scored(pool: DataFrame, *, radius: Column, w: Column, content: Column, popularity: Column | None = None) -> DataFrame:
    """Rows with popularity, content, w and a score rounded to three places."""
    pop = F.col("popularity") if popularity is None else popularity
    score = (1 - w) * pop + w * content - DISTANCE_WEIGHT * F.col("dist_km") / radius
    return pool.withColumns({"pop": pop, "content": content, "w": w, "score": F.round(score, 3)})


def top_list(rows: DataFrame, *, by: list[str] | None = None, n: int = SHOWN, chance: Column | None = None) -> DataFrame:
    """n rows per group: n - 1 by score, and one to explore among kinds (`sub`) not yet shown, else among all others.

    Order: score, then distance, then id; the explored one has the greatest pick, then the least id. Columns rank and slot are
    added. One pass over the rows: each enters its group's list by score and that of its kind by pick, tasks cut
    every list to n rows before the shuffle, and a group's lists, n rows and n a kind at most, decide the rest. The first
    n picks of a kind hold its best row outside the n - 1 by score, whichever those are. A null kind is one of its own.
    """
    by = by or []
    pick = F.col("content") + 0.3 * (chance if chance is not None else F.lit(0.0))
    entry = lambda top, kind, a, b: F.struct(F.lit(top).alias("top"), kind.alias("kind"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    lists = F.array(entry(True, F.lit(None).cast("string"), -F.col("score"), F.col("dist_km")), entry(False, F.col("sub").cast("string"), -pick, F.lit(0.0)))
    entered = rows.select(*by, F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), F.explode(lists).alias("_l"))
    order = Window.partitionBy(*by, "_l.top", "_l.kind").orderBy(F.col("_l.a").asc_nulls_first(), F.col("_l.b").asc_nulls_first(), F.asc("_row.id"))
    cut = entered.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    held = cut.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("_l.top") & (F.col("_n") < n), F.struct("_n", "_row")))).alias("_top"),
        F.collect_list(F.when(~F.col("_l.top"), F.struct(F.col("_l.a").alias("a"), F.col("_row.id").alias("id"), "_row"))).alias("_others"),
    )
    others = F.filter("_others", lambda x: ~F.exists("_top", lambda t: t["_row"]["id"].eqNullSafe(x["id"])))
    stale = lambda x: F.exists("_top", lambda t: t["_row"]["sub"].eqNullSafe(x["_row"]["sub"]))
    best = F.array_min(F.transform(others, lambda x: F.struct(stale(x).alias("stale"), x["a"].alias("a"), x["id"].alias("id"), x["_row"].alias("_row"))))
    shown = F.transform("_top", lambda t: F.struct(t["_n"].alias("rank"), F.lit("top").alias("slot"), t["_row"].alias("_row")))
    explored = F.when(best.isNotNull(), F.array(F.struct(F.lit(n).alias("rank"), F.lit("explore").alias("slot"), best["_row"].alias("_row"))))
    whole = held.select(F.explode(F.when(explored.isNotNull(), F.concat(shown, explored)).otherwise(shown)).alias("_s"))
    return whole.select(*(F.col(f"_s._row.`{c}`").alias(c) for c in rows.columns), "_s.rank", "_s.slot")


def preference_summary(prefs: DataFrame, *, user: str = "user", value: str = "sub", most: int = 5) -> DataFrame:
    """(user, place, line): the strongest preferences as text."""
    share, sure = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    order = Window.partitionBy(user).orderBy(F.desc(share), F.desc(sure), F.asc(value))
    line = F.concat(F.col(value), F.lit(" "), F.round(share * 100, 0).cast("int").cast("string"), F.lit("% ("), F.format_number(sure, 1), F.lit(")"))
    return prefs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(user, "place", line.alias("line"))


def nearest_first(items: DataFrame, n: int = 20) -> DataFrame:
    return items.orderBy("dist_km", "id").limit(n)
