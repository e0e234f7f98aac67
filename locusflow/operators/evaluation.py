"""Evaluation: accuracy, F1, thresholds, agreement, AUC, neighbours, latency and simulation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import nearest_rank, running_totals

#: A bound in bytes for a block of query vectors that is broadcast.
BLOCK_BYTES = 64 << 20


def per_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, f1) of every gold or predicted label."""
    right = F.col(gold) == F.col(predicted)
    parts = rows.select(F.col(gold).alias("label"), F.when(right, 1).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(right, 0).otherwise(1).alias("fn"))
    other = rows.where(~right).select(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    sums = parts.unionByName(other).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return sums.withColumn("f1", F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, and macro F1 over gold classes."""
    whole = rows.agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(predicted)).cast("int")).alias("accuracy"))
    macro = per_class(rows, gold, predicted).where("tp + fn > 0").agg(F.avg("f1").alias("macro_f1"))
    return whole.join(F.broadcast(macro))


def confusion(rows: DataFrame, gold: str, predicted: str, most: int = 8) -> DataFrame:
    wrong = rows.where(F.col(gold) != F.col(predicted)).groupBy(gold, predicted).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), gold, predicted).limit(most)


def thresholds(rows: DataFrame, score: str, right: Column, marks: list[float]) -> DataFrame:
    """(threshold, covered, coverage, precision) from one pass over the rows."""
    hits = rows.select(F.col(score).alias("_s"), right.cast("int").alias("_r"))
    sums = hits.agg(F.count("*").alias("_n"), *(x for i, m in enumerate(marks) for x in (F.count_if(F.col("_s") >= m).alias(f"_c{i}"), F.sum(F.when(F.col("_s") >= m, F.col("_r"))).alias(f"_t{i}"))))
    each = F.array(*(F.struct(F.lit(float(m)).alias("threshold"), F.col(f"_c{i}").alias("covered"), (F.col(f"_c{i}") / F.col("_n")).alias("coverage"), (F.col(f"_t{i}") / F.nullif(F.col(f"_c{i}"), F.lit(0))).alias("precision")) for i, m in enumerate(marks)))
    return sums.select(F.inline(each))


def agreement(rows: DataFrame, by: str, same: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(same.cast("int")).alias("agreement"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row (auc) by rank sums with mean ranks for ties, from counts per distinct score."""
    counts = rows.groupBy(F.col(score).alias("_s")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) != 1).cast("bigint")).alias("q"))
    sums = running_totals(counts, ["_s"], ["q"]).agg(F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2)).alias("_u"), F.sum("p").alias("_np"), F.sum("q").alias("_nq"))
    return sums.select(F.try_divide(F.col("_u"), F.col("_np") * F.col("_nq")).alias("auc"))


def neighbours(queries: DataFrame, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, places: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, neighbour, similarity, place): the k most similar rows by cosine, itself excluded, exact.

    A stated query set against all rows, in blocks: the queries are measured first, and each block of at
    most `block_bytes` goes over the table once. There, 256 queries at a time meet an Arrow batch in one
    matrix product and keep their k best, so what leaves a task is k rows a query.
    """
    packed = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    took = packed.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0
    blocks = max(1, -(-took // block_bytes))
    near = None
    for n in range(blocks):
        part = packed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n) if blocks > 1 else packed
        found = _nearest(part, rows, key, vector, k, places)
        near = found if near is None else near.unionByName(found)
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _nearest(packed: DataFrame, rows: DataFrame, key: str, vector: str, k: int, places: int) -> DataFrame:
    """The k best of each task's rows for one block of queries."""
    import numpy as np
    import pandas as pd

    got = packed.orderBy("q").toPandas()  # one block
    ids = got["q"].to_numpy()
    unit = np.stack(got["v"].to_list()).astype("float64") if len(got) else np.zeros((0, 1))
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    shared = rows.sparkSession.sparkContext.broadcast((ids, unit))

    def run(batches):
        q, u = shared.value
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            own = batch["r"].to_numpy()
            x = np.stack(batch["v"].to_list()).astype("float64")
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for at in range(0, len(q), 256):
                s = np.round(u[at : at + 256] @ x.T, places)
                s[q[at : at + 256, None] == own[None, :]] = -np.inf
                for i, line in enumerate(s):
                    best = np.lexsort((own, -line))[:k]
                    best = best[np.isfinite(line[best])]
                    yield pd.DataFrame({key: q[at + i], "neighbour": own[best], "similarity": line[best]})

    return rows.select(F.col(key).cast("long").alias("r"), F.col(vector).alias("v")).where(F.col("v").isNotNull()).mapInPandas(run, f"{key} bigint, neighbour bigint, similarity double")


def voted(near: DataFrame, labels: DataFrame, *, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, voted): the label with the greatest summed similarity among neighbours; ties: the smaller."""
    votes = near.join(labels.select(F.col(key).alias("neighbour"), F.col(label)), "neighbour").groupBy(key, label).agg(F.round(F.sum("similarity"), 6).alias("_w"))
    return votes.groupBy(key).agg(F.min_by(label, F.struct(-F.col("_w"), F.col(label))).alias("voted"))


def latency(rows: DataFrame, *, by: str, ms: str, failed: Column, seconds: float | None = None) -> DataFrame:
    """(by, n, errors, p50, p95, p99[, rate]) with nearest-rank percentiles; `seconds`: the length of the test, for requests a second."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(failed.cast("int")).alias("errors"))
    marks = nearest_rank(rows, ms, [0.5, 0.95, 0.99], [by])
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col(ms)))
    out = counts.join(marks.groupBy(by).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99")), by, "left")
    return out.withColumn("rate", F.col("n") / F.lit(float(seconds))) if seconds else out


def two_versions(before: DataFrame, after: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    """(version, n, agreement) of two runs against a directory, over the rows that all three have."""
    met = gold.select(key, F.col(value).alias("_g")).join(before.select(key, F.col(value).alias("_b")), key).join(after.select(key, F.col(value).alias("_a")), key)
    both = F.array(F.struct(F.lit("before").alias("version"), F.col("_b").alias("v")), F.struct(F.lit("after").alias("version"), F.col("_a").alias("v")))
    rows = met.select("_g", F.explode(both).alias("x")).select("_g", "x.version", "x.v")
    return agreement(rows, "version", F.col("v").eqNullSafe(F.col("_g")))


def scored_against(gold: DataFrame, predictions: DataFrame, key: str, label: str) -> DataFrame:
    """`scores` over the keys that both have."""
    return scores(gold.select(key, F.col(label).alias("gold")).join(predictions.select(key, F.col(label).alias("predicted")), key), "gold", "predicted")


def majority_baseline(rows: DataFrame, label: str) -> DataFrame:
    """One row (label, share): the commonest label and how often it is right."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), (F.max("n") / F.sum("n")).alias("share"))


def compared(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after, change) of two runs: added, removed, same or changed."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("change", kind)


def content_hash(rows: DataFrame) -> DataFrame:
    """One row (n, sha): a hash of the rows that doesn't depend on their order."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.struct(*rows.columns)).cast("decimal(38,0)")).cast("string").alias("sha"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): frequency to the power -1/2, scaled to a mean of one."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("_w", F.pow("n", F.lit(-0.5)))
    mean = counts.agg(F.avg("_w").alias("_m"))
    return counts.join(F.broadcast(mean)).select(label, "n", (F.col("_w") / F.col("_m")).alias("weight"))


def simulation_summary(turns: DataFrame, *by: str, plain_food: Column | None = None, complied: Column | None = None) -> DataFrame:
    """(by, turns, success, late_success, mean_rank, kinds, short[, food_success][, compliance]): figures of simulated turns.

    turns: chosen BOOLEAN, turn INT, rank INT, shown INT, subs INT. `by` may name several columns, such as the day.
    plain_food: whether a turn asks for food without a kind; complied: whether a list keeps to what was asked, null where
    nothing was.
    """
    more = [F.avg(F.when(plain_food, F.col("chosen").cast("int"))).alias("food_success")] if plain_food is not None else []
    more += [F.avg(complied.cast("int")).alias("compliance")] if complied is not None else []
    hit = F.col("chosen").cast("int")
    return turns.groupBy(*by).agg(F.count("*").alias("turns"), F.avg(hit).alias("success"), F.avg(F.when(F.col("turn") >= 4, hit)).alias("late_success"), F.avg(F.when(F.col("chosen"), F.col("rank"))).alias("mean_rank"), F.avg("subs").alias("kinds"), F.avg((F.col("shown") < 8).cast("int")).alias("short"), *more)
