"""Around models: inputs, a batch interface, thresholds, multi-label figures, label spreading, and the log of costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import checkpointed

#: A classifier of a batch of texts: a row of logits a text, a column a label.
Classifier = Callable[[list[str]], np.ndarray]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def multi_hot(labels: Column, known: list[str]) -> Column:
    """A 0/1 array over the known labels."""
    return F.array(*(F.coalesce(F.array_contains(labels, label), F.lit(False)).cast("int") for label in known))


def classified(rows: DataFrame, text: str, make: Callable[[], Classifier], *, batch: int = 256, out: str = "logits") -> DataFrame:
    """Rows with an array of logits. The classifier is made once a task and sees batches of texts; null texts count as empty."""
    schema = rows.withColumn(out, F.array(F.lit(0.0))).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts = part[text].fillna("").tolist()
            found = [model(texts[at : at + batch]) for at in range(0, len(texts), batch)]
            yield part.assign(**{out: [row.astype("float64").tolist() for block in found for row in block]})

    return rows.mapInPandas(run, schema)


def decided(scores: Column, labels: list[str], threshold: float = 0.8) -> Column:
    """(label, score, sure) of the greatest score; of equals the first."""
    best = F.array_max(scores)
    return F.struct(F.get(F.array(*map(F.lit, labels)), (F.array_position(scores, best) - 1).cast("int")).alias("label"), best.alias("score"), (best >= threshold).alias("sure"))


def multi_label_figures(rows: DataFrame, labels: str, scores: str, known: list[str], threshold: float = 0.5) -> DataFrame:
    """One row (n, hit1, macro_f1, micro_f1): labels as an array of names, scores as an array over `known`.

    A label without any hit, right or wrong, counts as 0 in the macro mean.
    """
    y = multi_hot(F.col(labels), known)
    first = F.get(y, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    whole = rows.agg(F.count("*").alias("n"), F.avg(first).alias("hit1"))
    each = rows.select(F.posexplode(F.arrays_zip(y.alias("y"), F.transform(scores, lambda s: (s >= threshold).cast("int")).alias("p"))).alias("at", "v")).select("at", "v.y", "v.p")
    sums = each.groupBy("at").agg(F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum((1 - F.col("y")) * F.col("p")).alias("fp"), F.sum(F.col("y") * (1 - F.col("p"))).alias("fn"))
    f1 = lambda tp, fp, fn: F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    macro = sums.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))
    return whole.join(F.broadcast(macro))


def hit_thresholds(rows: DataFrame, *, predicted: str, score: str, gold: str, parents: dict[str, str], also: dict[str, list[str]], marks: list[float]) -> DataFrame:
    """(threshold, covered, coverage, precision, parent_hit, overlap_hit) of predictions against arrays of right labels, in one pass.

    A parent hit shares the parent of a right label; an overlap hit is a right label or one that overlaps it.
    """
    up = F.create_map(*(F.lit(x) for pair in parents.items() for x in pair))
    wide = F.create_map(*(x for k, v in also.items() for x in (F.lit(k), F.array(*map(F.lit, v)))), F.lit("\x00"), F.array(F.lit("\x00")))
    exact = F.array_contains(gold, F.col(predicted))
    parent = F.exists(F.col(gold), lambda g: F.try_element_at(up, g) == F.try_element_at(up, F.col(predicted)))
    overlap = exact | F.coalesce(F.arrays_overlap(F.try_element_at(wide, F.col(predicted)), F.col(gold)), F.lit(False)) | F.exists(F.col(gold), lambda g: F.coalesce(F.array_contains(F.try_element_at(wide, g), F.col(predicted)), F.lit(False)))
    hits = rows.select(F.col(score).alias("s"), *(F.coalesce(x, F.lit(False)).cast("int").alias(n) for n, x in (("e", exact), ("p", parent), ("o", overlap))))
    over = lambda c, m: F.sum(F.when(F.col("s") >= m, F.col(c)))
    sums = hits.agg(F.count("*").alias("n"), *(x for i, m in enumerate(marks) for x in (F.count_if(F.col("s") >= m).alias(f"c{i}"), *(over(k, m).alias(f"{k}{i}") for k in "epo"))))
    part = lambda c, i: F.col(f"{c}{i}") / F.nullif(F.col(f"c{i}"), F.lit(0))
    lines = F.array(*(F.struct(F.lit(float(m)).alias("threshold"), F.col(f"c{i}").alias("covered"), (F.col(f"c{i}") / F.nullif(F.col("n"), F.lit(0))).alias("coverage"), part("e", i).alias("precision"), part("p", i).alias("parent_hit"), part("o", i).alias("overlap_hit")) for i, m in enumerate(marks)))
    return sums.select(F.inline(lines))


def with_snippets(rows: DataFrame, found: DataFrame, *, name: str, area: str, query: str = "query", snippets: str = "snippets") -> DataFrame:
    """The rows with what a search gave for `name area`, or where that is nothing for the name alone; an empty list where both are.

    found: a row a query, as a search has answered it before.
    """
    both = F.trim(F.concat(F.col(name), F.lit(" "), F.coalesce(area, F.lit(""))))
    some = found.where(F.size(snippets) > 0)
    first = some.select(F.col(query).alias("_both"), F.col(snippets).alias("_first"))
    second = some.select(F.col(query).alias("_name"), F.col(snippets).alias("_second"))
    met = rows.withColumns({"_both": both, "_name": F.col(name)}).join(first, "_both", "left").join(second, "_name", "left")
    return met.withColumn(snippets, F.coalesce("_first", "_second", F.array().cast("array<string>"))).drop("_both", "_name", "_first", "_second")


def spread(links: DataFrame, seeds: DataFrame, *, alpha: float = 0.2, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """(node, score): label spreading over a weighted graph, F = alpha S F + (1 - alpha) Y with S the normalised weights.

    links: a, b, weight (either way, each once); seeds: node, y. A round is one join and one sum by node,
    which tasks begin before the shuffle; every third round ends in a reliable checkpoint. With a tolerance, rounds end early,
    at a checkpoint since which no score has moved by more.
    """
    both = links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    degree = both.groupBy("a").agg(F.sum("weight").alias("d"))
    s = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("s"))
    s = checkpointed(s)
    start = seeds.select("node", (F.col("y") * (1 - alpha)).alias("score"))
    now = before = start
    for n in range(rounds):
        moved = s.join(now.select(F.col("node").alias("b"), "score"), "b").select(F.col("a").alias("node"), (F.col("s") * F.col("score") * alpha).alias("score"))
        now = moved.unionByName(start).groupBy("node").agg(F.sum("score").alias("score"))
        if n % 3 == 2:
            now = checkpointed(now)
            if tolerance is not None:
                moved = now.join(before.withColumnRenamed("score", "_was"), "node", "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0)))))
                if (moved.first()[0] or 0.0) <= tolerance:
                    break
                before = now
    return now


def pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is set, scaled to length one (zeros where none is)."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    n = F.size(kept)
    total = F.aggregate(kept, F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.greatest(n, F.lit(1)))
    length = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(mean, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def costs(requests: DataFrame, *, by: str, dollars_in: float, dollars_out: float, discount: float = 0.5) -> DataFrame:
    """(by, requests, tokens_in, tokens_out, dollars) of a log of model calls; prices are for a million tokens, batches are discounted."""
    price = (F.col("tokens_in") * dollars_in + F.col("tokens_out") * dollars_out) / 1e6 * F.when(F.col("batch"), discount).otherwise(1.0)
    return requests.groupBy(by).agg(F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(price).alias("dollars"))


def second_pass(labels: DataFrame, n: int | None = None) -> DataFrame:
    """First-pass labels that a model wasn't sure of or didn't know, in order of id, `n` at most where given."""
    rows = labels.where((F.col("stage") == 1) & ((F.col("conf") == "low") | (F.col("cat") == "unknown")))
    return rows.orderBy("id").limit(n) if n is not None else rows


def corrected(label: Column, tag: Column, name: Column, words: list[str], *, wrong: list[str], tags: str, instead: str = "unknown") -> Column:
    """A label of `wrong` on an object with the tag whose name holds none of the words becomes `instead`."""
    spoken = name.rlike("(?iu)" + "|".join(words)) if words else F.lit(False)
    return F.when(F.contains(tag, F.lit(tags)) & label.isin(*wrong) & ~F.coalesce(spoken, F.lit(False)), instead).otherwise(label)


def one_each(rows: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """One row of each of n keys, keys and rows in an order that looks random and depends on nothing but their values."""
    chosen = rows.select(key).distinct().orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.join(F.broadcast(chosen), key, "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")


def repeated(rows: DataFrame, name: Column, *, tag: str, flag: Column, least: int = 3) -> DataFrame:
    """(name, n, tag, flagged): names of several rows, their commonest tag (of equals the smaller) and how many are flagged."""
    marked = rows.select(name.alias("name"), F.col(tag).alias("tag"), flag.cast("int").alias("f"))
    counts = marked.groupBy("name", "tag").agg(F.count("*").alias("c"), F.sum("f").alias("f"))
    whole = counts.groupBy("name").agg(F.sum("c").alias("n"), F.min_by("tag", F.struct(-F.col("c"), F.col("tag"))).alias("tag"), F.sum("f").alias("flagged"))
    return whole.where(F.col("n") >= least)


def ratings(rows: DataFrame, by: str, rating: str = "rating") -> DataFrame:
    """(by, n, rated, mean): the mean of ratings that were given; 0 and null are none."""
    given = F.when(F.col(rating) > 0, F.col(rating))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count(given).alias("rated"), F.avg(given).alias("mean"))


def requests(rows: DataFrame, *, per_request: int, per_file: int, columns: list[str], order: list[str], prompt: str) -> DataFrame:
    """(file, request, n, body): rows of a request as a JSON body, requests of a file under one number."""
    from .ordered import numbered

    placed = numbered(rows, order, "_p").withColumn("request", F.floor(F.col("_p") / per_request).cast("bigint"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_p", F.struct(*columns).alias("r")))), lambda x: x["r"])
    bodies = placed.groupBy("request").agg(F.count("*").alias("n"), lines.alias("rows"))
    body = F.to_json(F.struct(F.concat(F.lit("r"), F.col("request").cast("string")).alias("custom_id"), F.lit(prompt).alias("prompt"), "rows"))
    return bodies.select(F.floor(F.col("request") / per_file).cast("bigint").alias("file"), "request", "n", body.alias("body"))


def attribute_flags(s: Column, patterns: dict[str, str]) -> Column:
    """A 0/1 field for each pattern that a text matches."""
    low = F.lower(F.coalesce(s, F.lit("")))
    return F.struct(*(low.rlike(p).cast("int").alias(k) for k, p in patterns.items()))


def alternative_name(s: Column, letters: str = "[぀-ヿ一-鿿]") -> Column:
    """The first part of a list of names that has such letters."""
    parts = F.split(s, "[,;/()（）]| or ")
    return F.get(F.transform(F.filter(parts, lambda p: p.rlike(letters)), lambda p: F.trim(p)), F.lit(0))
