"""Benchmark decontamination with DataFrame functions only.

A window is `WINDOW` consecutive words of a benchmark item (a shorter item is one window). Equal windows are one, whatever
number of items hold it. Of each window the n-gram of `ANCHOR` words with the least hash is its anchor, so
neighbouring windows mostly share one. Every position of every document is probed with its n-gram's hash, inside
generated code. About a hit, the words that a window with this anchor would take are hashed, met with the
windows of that hash, and verified word by word. Only verified windows count, so hashes never decide a result.
Documents' hits are the windows in them; items come last, once for each distinct set of windows that documents hold. So
a preamble that every item has costs a document no more than one that one item has.

The anchors' hashes are counted. Up to `BROADCAST_BYTES` they are broadcast together, beyond it in as many slices as keep
each below the bound, a pass over the table for each. The windows, with their words, are broadcast up to the same
bound; beyond it the few positions found, with the words near them, meet the windows in a shuffled
join. Documents never travel.

Cases: a null or empty text has no words; items without words have no windows; the same window in
several items counts for each; equal rows are scanned once per copy and each keeps its own result
row; rows of one doc_id with different texts stay apart, null keys too; columns of any further name
pass through `remove_spans`; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut

WINDOW = 10
ANCHOR = 5
#: The bound in bytes for each thing that is broadcast; an anchor's row, a window's beside its words and a document's hits are reckoned to take so many.
BROADCAST_BYTES = 32 << 20
ANCHOR_BYTES, WINDOW_BYTES, HIT_BYTES = 96, 128, 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words before A-Z are lowered, as a Java class and as characters to trim.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
TRIMMED = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def raw_words(text: Column) -> Column:
    """Words of a text with their letters as they are."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIMMED))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, RAW_SEPARATORS + "+"))


def lowered(words: Column) -> Column:
    """A-Z to a-z in each word."""
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def word_hashes(words: Column) -> Column:
    """A hash of each word in full lower case: words equal in `lowered` have equal hashes."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def occurrences(bench: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """A row per item and place of a window: (item, at, len, off, size, a_hash, w_hash, words).

    `off` is where in the window its anchor of `size` words begins; all but (item, at) depend on the words alone.
    """
    words = bench.select(F.col(item).cast("string").alias("item"), raw_words(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    words = words.withColumn("h", word_hashes(F.col("w"))).withColumn("len", F.least(F.size("w"), F.lit(window))).withColumn("size", F.least("len", F.lit(anchor)))
    placed = words.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at")).withColumn("wh", F.slice("h", F.col("at") + 1, F.col("len")))
    grams = F.transform(F.sequence(F.lit(0), F.col("len") - F.col("size")), lambda off: F.struct(F.xxhash64(F.slice("wh", off + 1, F.col("size"))).alias("hash"), off.alias("off")))
    placed = placed.withColumn("least", F.array_min(grams))
    return placed.select("item", "at", "len", F.col("least.off").alias("off"), "size", F.col("least.hash").alias("a_hash"), F.xxhash64("wh").alias("w_hash"), lowered(F.slice("w", F.col("at") + 1, F.col("len"))).alias("words"))


def distinct_windows(found: DataFrame) -> DataFrame:
    """A row per distinct window: (window, len, off, size, a_hash, w_hash, words); `window` names the least item and place that hold it."""
    first = F.min(F.struct("item", "at"))
    same = found.groupBy("len", "off", "size", "a_hash", "w_hash", "words").agg(first.alias("first"))
    return same.withColumn("window", F.concat_ws(":", F.col("first.at").cast("string"), "first.item")).drop("first")


def find_hits(docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, anchor: int = ANCHOR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per distinct (key, text): (k, text_hash, text_length, copies, n_words, hits, windows).

    `hits` are the word positions inside occurrences of windows, `windows` the names of the distinct windows found, in order.
    """
    known = distinct_windows(occurrences(bench, item=item, window=window, anchor=anchor))
    letters = F.sum(F.aggregate("words", F.lit(WINDOW_BYTES), lambda n, w: n + F.octet_length(w) + F.lit(16)))
    sizes = {r["size"]: (r["n"], r["bytes"]) for r in known.groupBy("size").agg(F.count_distinct("a_hash").alias("n"), letters.alias("bytes")).collect()}  # at most `anchor` rows
    sides = known.select("len", "off", "w_hash", "words", "window")
    if sum(b for _, b in sizes.values()) <= broadcast_bytes:
        sides = F.broadcast(sides)
    scanned = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("text_length"), raw_words(F.col(text)).alias("w"))
    scanned = scanned.withColumn("h", word_hashes(F.col("w")))
    reach = window - 1  # a window about an anchor begins and ends within so many words of it
    parts = []
    for number, size in enumerate(sorted(sizes, reverse=True) or [anchor]):
        # a window about an anchor: `form` is its length and how far before the anchor it begins, in one number
        marks = known.where(F.col("size") == size).groupBy("a_hash").agg(F.sort_array(F.collect_set(F.col("len") * (window + 1) + F.col("off"))).alias("forms"))  # at most window * size forms
        slices = max(1, -(-ANCHOR_BYTES * sizes.get(size, (0, 0))[0] // max(broadcast_bytes, ANCHOR_BYTES)))
        for s in range(slices):
            # The first pass has a position -1 for every document: it matches nothing and keeps the document.
            first = -1 if number == 0 and s == 0 else 0
            at = scanned.where(F.size("h") >= size) if first == 0 else scanned
            at = at.withColumn("pos", F.explode(F.sequence(F.lit(first), F.greatest(F.size("h") - size, F.lit(first)))))
            at = at.withColumn("a_hash", F.when(F.col("pos") >= 0, F.xxhash64(*(F.get("h", F.col("pos") + i) for i in range(size)))))
            own = marks if slices == 1 else marks.where(F.pmod("a_hash", F.lit(slices)) == s)
            met = at.join(F.broadcast(own), "a_hash", "left").where(F.col("forms").isNotNull() | (F.col("pos") < 0))
            low = F.greatest(F.col("pos") - reach, F.lit(0))
            parts.append(met.select(*("k", "text_hash", "text_length", "pos", "forms"), F.when(F.col("pos") < 0, F.size("w")).alias("n_words"), low.alias("low"), *(F.when(F.col("pos") >= 0, F.slice(c, low + 1, F.lit(2 * window + size))).alias(f"near_{c}") for c in ("w", "h"))))
    few = parts[0]
    for part in parts[1:]:
        few = few.unionByName(part)
    few = few.select("*", F.explode_outer("forms").alias("form"))
    few = few.withColumns({"len": F.floor(F.col("form") / (window + 1)).cast("int"), "off": F.pmod("form", F.lit(window + 1)).cast("int")})
    few = few.withColumn("start", F.col("pos") - F.col("off"))
    few = few.withColumn("within", F.coalesce((F.col("start") >= 0) & (F.col("start") - F.col("low") + F.col("len") <= F.size("near_h")), F.lit(False)))
    # rows without a window to look up go by a hash of their own, so that they don't meet in one task
    few = few.withColumn("w_hash", F.when(F.col("within"), F.xxhash64(F.slice("near_h", F.col("start") - F.col("low") + 1, F.col("len")))).otherwise(F.xxhash64("k", "text_hash", "pos"))).drop("near_h", "forms", "form")
    there = lowered(F.slice("near_w", F.col("start") - F.col("low") + 1, F.col("len")))
    joined = few.join(sides, ["w_hash", "len", "off"], "left")
    hit = F.col("within") & F.coalesce(there == F.col("words"), F.lit(False))
    found = joined.select("k", "text_hash", "text_length", "n_words", F.when(hit, F.struct("start", "len")).alias("span"), F.when(hit, F.col("window")).alias("window"))
    whole = found.groupBy("k", "text_hash", "text_length").agg(F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("window")).alias("windows"))
    hits = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    return whole.select("k", "text_hash", "text_length", "copies", "n_words", hits.alias("hits"), "windows")


def item_sets(hits: DataFrame, bench: DataFrame, *, item: str = "item_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(windows, items): the ids, as strings in order, of the items that hold one of the windows; a row per distinct set of windows."""
    found = occurrences(bench, item=item, window=window, anchor=anchor)
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("len", "w_hash", "words")]
    holders = distinct_windows(found).alias("l").join(found.alias("r"), same).select("l.window", "r.item").distinct()
    sets = hits.where(F.size("windows") > 0).select("windows").distinct()
    met = sets.select("windows", F.explode("windows").alias("window")).join(holders, "window")
    return met.groupBy("windows").agg(F.sort_array(F.collect_set("item")).alias("items"))


def remove_spans(docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """The same columns with every hit word and the separators after it taken out of the text.

    Documents without hits pass unchanged; documents left without a word go. Documents with hits are
    few: their positions are written to a checkpoint, measured, and broadcast where the bound allows.
    """
    hits = find_hits(docs, bench, key=key, text=text, broadcast_bytes=broadcast_bytes, **options).where(F.size("hits") > 0).select("k", "text_hash", "text_length", "hits")
    hits = cut(hits)
    took = hits.agg(F.sum(F.size("hits") * 8 + HIT_BYTES)).first()[0] or 0
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("own_k"), F.xxhash64(text).alias("own_hash"), F.length(text).alias("own_length"))
    same = F.col("own_k").eqNullSafe(F.col("k")) & (F.col("own_hash") == F.col("text_hash")) & F.col("own_length").eqNullSafe(F.col("text_length"))
    joined = base.join(F.broadcast(hits) if took <= broadcast_bytes else hits, same, "left")
    whole = F.col("row")[text]
    lead = F.regexp_extract(whole, "^" + RAW_SEPARATORS + "*", 0)
    word = RAW_SEPARATORS.replace("[", "[^", 1)
    parts = F.regexp_extract_all(whole, F.lit(f"({word}+{RAW_SEPARATORS}*)"), F.lit(1))
    inside = F.map_from_arrays("hits", F.transform("hits", lambda _: F.lit(True)))
    kept = F.filter(parts, lambda _, i: ~F.map_contains_key(inside, i))
    left = F.when(F.col("hits").isNotNull(), F.concat(lead, F.array_join(kept, "")))
    joined = joined.select("row", left.alias("left"))
    bare = F.btrim("left", F.lit(TRIMMED))
    changed = F.when(F.col("left").isNull(), whole).otherwise(F.col("left"))
    return joined.where(F.col("left").isNull() | (bare != "")).select(*(changed.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = cut(find_hits(docs, bench))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    sets = item_sets(found, bench).select("windows", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"))
    rows = found.join(sets, "windows", "left").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        F.col("k").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM
  (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM
  (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS at FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
