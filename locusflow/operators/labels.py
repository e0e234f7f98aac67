"""Labelling: keyed unions, votes, modes, share thresholds, per-class caps and the label cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ordered import numbered


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The record of the greatest seq for each key."""
    return _by_seq(rows, keys, seq, F.max_by)


def first_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _by_seq(rows, keys, seq, F.min_by)


def _by_seq(rows: DataFrame, keys: list[str], seq: str, pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def precedence_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first frame that has the key."""
    tagged = [p.withColumn("_source", F.lit(n)) for n, p in enumerate(parts)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return first_wins(whole, keys, "_source").drop("_source")


def majority(rows: DataFrame, key: str, value: str, *, least: int = 2, share: float = 0.8) -> DataFrame:
    """(key, value, n, of) where the commonest value has enough support and share; ties: the smaller value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.sum("n").alias("of"), F.max_by(F.struct("n", value), F.struct("n", F.lit(0))).alias("_t"), F.max("n").alias("n"))
    best = counts.join(top.select(key, "of", F.col("n").alias("_n")), key).where("n = _n").groupBy(key, "n", "of").agg(F.min(value).alias(value))
    return best.where((F.col("n") >= least) & (F.col("n") / F.col("of") >= share)).select(key, value, "n", "of")


def three_way_vote(rows: DataFrame, votes: list[str], *, manual: str | None = None, excluded: Column | None = None) -> DataFrame:
    """`decision` and `grade` from up to three votes: manual, excluded, high, majority, single, conflict or none."""
    cast = F.array_compact(F.array(*votes))
    kinds = F.array_distinct(cast)
    counted = F.transform(kinds, lambda k: F.struct(F.size(F.filter(cast, lambda v: v == k)).alias("n"), k.alias("k")))
    best = F.array_max(counted)
    grade = F.when(F.size(cast) == 0, "none").when((F.size(kinds) == 1) & (F.size(cast) > 1), "high").when(F.size(cast) == 1, "single").when(best["n"] > 1, "majority").otherwise("conflict")
    decision = F.when(grade.isin("high", "single", "majority"), best["k"])
    if excluded is not None:
        grade, decision = F.when(excluded, "excluded").otherwise(grade), F.when(~excluded, decision)
    if manual:
        grade, decision = F.when(F.col(manual).isNotNull(), "manual").otherwise(grade), F.coalesce(F.col(manual), decision)
    return rows.withColumns({"decision": decision, "grade": grade})


def mode(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value): the commonest, of equals the one seen first."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(seq).alias("_first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def share_labels(rows: DataFrame, key: str, value: str, share: float = 0.2) -> DataFrame:
    """(key, labels): every value with at least this share of the key's rows, sorted."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    of = Window.partitionBy(key)
    kept = counts.withColumn("_of", F.sum("_n").over(of)).where(F.col("_n") >= share * F.col("_of"))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("labels"))


def named(rows: DataFrame, name: str, *, done: bool = False) -> DataFrame:
    """The rows with their name trimmed, without those whose name has no letter or digit: names are told apart as they are written, not by their keys."""
    return rows.where(text.bare(text.folded(F.col(name), done)) != "").withColumn(name, F.trim(name))


def dataset(rows: DataFrame, name: Column, key: Column, fine: str, *, cap: int, share: float = 0.2, validation: float = 0.05, order: Column | None = None) -> DataFrame:
    """(name, label, labels, part): one training row a name from the fine codes of the places that bear it.

    The label is the commonest first code of a name's places (of equals the smaller), labels are it and, sorted, every
    other code that a share of the places has; classes are cut to `cap` names in an order, by default one by hash.
    Names are compared after trimming; those whose key is empty, and places without a code, stay out.
    """
    known = rows.select(F.trim(name).alias("name"), F.col(fine).alias("_f"), key.alias("_k")).where((F.size("_f") > 0) & (F.col("_k") != ""))
    places = known.groupBy("name").agg(F.count("*").alias("_of"))
    first = known.groupBy("name", F.get("_f", F.lit(0)).alias("label")).agg(F.count("*").alias("_n")).groupBy("name").agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("label"))
    codes = known.select("name", F.explode(F.array_distinct("_f")).alias("code")).groupBy("name", "code").agg(F.count("*").alias("_n")).join(places, "name").where(F.col("_n") >= share * F.col("_of"))
    others = codes.groupBy("name").agg(F.array_sort(F.collect_list("code")).alias("_codes"))
    whole = first.join(others, "name", "left").select("name", "label", F.concat(F.array("label"), F.filter(F.coalesce("_codes", F.array().cast("array<string>")), lambda c: c != F.col("label"))).alias("labels"))
    return capped(whole, "label", [order if order is not None else F.md5(F.col("name").cast("binary")), F.col("name")], cap, validation)


def capped(rows: DataFrame, by: str, order: list[Column], cap: int, validation: float = 0.05) -> DataFrame:
    """At most `cap` rows a class in the given order; `part` is val for the first share of them, else train."""
    window = Window.partitionBy(by).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= cap)
    of = F.count("*").over(Window.partitionBy(by))
    return numbered.withColumn("part", F.when(F.col("_n") <= F.greatest(F.lit(1), F.floor(of * validation)), "val").otherwise("train")).drop("_n")


def cascade(base: Column, directory: Column, parent_of_directory: Column, broad: Column, predicted: Column, sure: Column, override: Column) -> tuple[Column, Column]:
    """(label, method): base label, the directory for unknown ones or where it disagrees, then model and override."""
    unknown = F.coalesce(base, F.lit("unknown")) == "unknown"
    disagrees = ~unknown & directory.isNotNull() & (parent_of_directory != base)
    label = (
        F.when(override.isNotNull(), override)
        .when(unknown & parent_of_directory.isNotNull(), parent_of_directory)
        .when(unknown & (broad == "cafe"), "cafe")
        .when(disagrees, parent_of_directory)
        .when(unknown & sure & predicted.isNotNull(), predicted)
        .otherwise(F.coalesce(base, F.lit("unknown")))
    )
    method = (
        F.when(override.isNotNull(), "override")
        .when((unknown & (parent_of_directory.isNotNull() | F.coalesce(broad == "cafe", F.lit(False)))) | F.coalesce(disagrees, F.lit(False)), "directory")
        .when(F.coalesce(unknown & sure & predicted.isNotNull(), F.lit(False)), "model")
        .otherwise("base")
    )
    return label, method


def chunked(rows: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """`chunk` numbers of `size` rows each, in order within groups, or over all rows."""
    if not by:
        return numbered(rows, order, "_place").withColumn("chunk", F.floor(F.col("_place") / size).cast("long")).drop("_place")
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(window) - 1) / size).cast("long"))
