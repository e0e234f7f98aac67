"""Phrase collocation mining by pivot partitioning.

Texts, lower-cased in A-Z, are split into pieces and those into words; everything is counted per language. Words
that occur `MIN_COUNT` times and more are ranked from the most frequent on. An n-gram belongs to its pivot, the
rarest of its words (the leftmost place of it). Of every text the fragment about each place is
rewritten for the word there as pivot: at most two words on either side, cut at the first that is rarer than the
pivot or too rare to matter (on the left also at the pivot itself). Fragments that hold no n-gram vanish, equal ones of
a chunk travel once with their number, and go to the pivot's bucket, where the n-grams with the pivot are
mined from whole counts. So the most frequent words, which could flood a task, own almost nothing. A pivot
that occurs over `HOT_PIVOT` times is spread further by the word next to it, which each of its n-grams has.

Words get their ranks without a broadcast: tasks gather texts into chunks, each with a dictionary of distinct words and
their counts and the texts as places in it; the dictionaries add up to the counts, and the ranks return to
the chunks that asked. Chunks, ranks and mined n-grams are checkpoints in the shared folder. The buckets grow in number
with the words of the corpus, so a bucket's size doesn't. A phrase's parts get their counts from joins over mined n-grams.

Chunk dictionaries tell words apart by 64-bit hashes within one chunk; counts and ranks go by the words themselves.

Cases: a null or empty text has no words; a null language is `und`; a language without a phrase has no rows; repeated
rows count each time; keys aren't read, nor are other columns; ties in score and count are in the order of the
phrase's bytes; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import bounded_batches, cut
from .textblocks import LOWER, Block, blocks, mix, segments, span_hashes

MIN_COUNT, COVERED_PERCENT, TOP = 10, 50, 2_000
#: Distinct words of a chunk and places in its texts, beside one block's; dictionary entries in a row.
CHUNK_WORDS, CHUNK_PLACES, ROW_WORDS = 1 << 17, 1 << 21, 4_096
#: Words of the corpus for each bucket, and occurrences beyond which a pivot is spread by its neighbours.
BUCKET_WORDS, HOT_PIVOT = 1 << 20, 1 << 19
#: Rows that one task ranks at a time, and how many such lists are ranked together.
RANKED_ROWS, FAN_IN = 1 << 18, 64
#: A place that no phrase crosses; greater than every rank.
BLANK = np.int64(1) << 40
NONE = np.uint32(0xFFFFFFFF)

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True


def piece_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, whether it opens a piece) of the words of a block."""
    data = block.array
    starts, ends, rows = segments(~(_BREAK | _GAP)[data], block.offsets)
    breaks = np.cumsum(_BREAK[data])
    opens = np.ones(len(starts), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    return starts, ends, rows, opens


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of equal length as little-endian unsigned 32-bit numbers, their bytes in planes, compressed."""
    table = np.stack([c.astype("<u4") for c in columns])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(packed: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(columns, -1)


class Dictionary:
    """Distinct words of a chunk by hash, in the order of their coming, with their counts."""

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.counts = np.zeros(0, np.int64)
        self.held = 0

    def add(self, block: Block, langs: list[str]) -> np.ndarray:
        """The block's places: 1 + the word's number, and 0 before each piece."""
        starts, ends, rows, opens = piece_words(block)
        if not len(starts):
            return np.zeros(0, np.int64)
        spoken = sorted(set(langs))
        number = {x: i for i, x in enumerate(spoken)}
        seeds = np.array([span_hashes(np.frombuffer(x.encode() or b"\0", np.uint8), np.array([0]), np.array([max(len(x.encode()), 1)]), 1)[0] for x in spoken])
        lang = np.array([number[x] for x in langs])[rows]
        keys = mix(span_hashes(block.array, starts, ends) + seeds[lang])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        distinct, many = ranked[begins], np.diff(np.append(begins, len(ranked)))
        spot = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != distinct[inside]
        first = order[begins[new]]
        self.places = np.insert(self.places, spot[new], len(self.keys) + np.arange(len(first)))
        self.keys = np.insert(self.keys, spot[new], distinct[new])
        self.words += [block.data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.langs += [spoken[i] for i in lang[first].tolist()]
        self.counts = np.concatenate([self.counts, np.zeros(len(first), np.int64)])
        own = self.places[np.searchsorted(self.keys, distinct)]
        self.counts[own] += many
        place = np.empty(len(keys), np.int64)
        place[order] = np.repeat(own, many)
        out = np.zeros(len(keys) + int(opens.sum()), np.int64)
        out[np.arange(len(keys)) + np.cumsum(opens)] = place + 1
        self.held += len(out)
        return out

    def full(self) -> bool:
        return len(self.words) >= CHUNK_WORDS or self.held >= CHUNK_PLACES


def chunked(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of texts (chunk, places) and of dictionary entries (chunk, place of the first, words, langs, counts)."""
    schema = "chunk bigint, place bigint, places binary, words array<string>, langs array<string>, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, own = (context.partitionId() if context else 0) << 32, Dictionary()
        kinds = {"chunk": pa.int64(), "place": pa.int64(), "places": pa.binary(), "words": pa.list_(pa.string()), "langs": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}

        def rows(n: int, **have: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([have.get(c, pa.nulls(n, t)) for c, t in kinds.items()], list(kinds))

        def entries() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(own.words), ROW_WORDS):
                to = slice(at, at + ROW_WORDS)
                yield rows(1, chunk=pa.array([number]), place=pa.array([at]), words=pa.array([[w.decode() for w in own.words[to]]]), langs=pa.array([own.langs[to]]), counts=pa.array([own.counts[to].tolist()]))

        for batch in batches:
            spoken = batch.column("l").to_pylist()
            for block in blocks(batch.column("t")):
                lowered = Block(block.first_row, block.data.translate(LOWER), block.offsets)
                places = own.add(lowered, spoken[block.first_row : block.first_row + len(block)])
                if len(places):
                    yield rows(1, chunk=pa.array([number]), places=pa.array([pack_numbers(places)], pa.binary()))
                if own.full():
                    yield from entries()
                    number, own = number + 1, Dictionary()
        yield from entries()

    spoken = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    return docs.select(F.col(f"`{text}`").cast("string").alias("t"), spoken.alias("l")).mapInArrow(run, schema)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows and their numbers from 0 on in a global order, as `rank`; no task sees more than its range of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, at = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
            at += n

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    found = cut(df.orderBy(*order).mapInArrow(run, f"{kinds}, part bigint, at bigint"))
    sizes = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    begins, total = [], 0
    for part, n in sizes:
        begins.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(begins, "part bigint, begin bigint")
    return found.join(F.broadcast(starts), "part").withColumn("rank", F.col("begin") + F.col("at")).drop("part", "at", "begin")


def fragments(ranks: np.ndarray, hot: int) -> np.ndarray:
    """Rewritten fragments of a sequence of ranks: rows (side, l2, l1, pivot, r1, r2), a column for each, NONE where cut.

    Side 1 has only the n-grams that reach left of the pivot: those of hot pivots (ranks below `hot`)
    go apart from the ones that begin with it.
    """
    padded = np.concatenate([[BLANK, BLANK], ranks, [BLANK, BLANK]])
    at = np.flatnonzero(padded < BLANK)
    p = padded[at]
    l1, l2, r1, r2 = (padded[at + d] for d in (-1, -2, 1, 2))
    has_l1, has_r1 = l1 < p, r1 <= p
    has_l2, has_r2 = has_l1 & (l2 < p), has_r1 & (r2 <= p)
    side = np.zeros(len(p), np.int64)
    whole = np.stack([side, *(np.where(ok, w, NONE) for ok, w in ((has_l2, l2), (has_l1, l1))), p, *(np.where(ok, w, NONE) for ok, w in ((has_r1, r1), (has_r2, r2)))])
    spread = p < hot
    left, right = whole[:, spread & has_l1], whole[:, spread & has_r1]
    left[0], left[5] = 1, NONE
    right[1:3] = NONE
    return np.concatenate([whole[:, ~spread & (has_l1 | has_r1)], left, right], axis=1)


def bucket_of(rows: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    """The bucket of each fragment: its pivot's, or of a hot pivot that of the pivot and the word beside it."""
    pivot = rows[3].astype(np.uint64)
    beside = np.where(rows[0] == 1, rows[2] * 2, rows[4] * 2 + 1).astype(np.uint64)
    key = mix(pivot + np.uint64(1))
    return (np.where(rows[3] < hot, mix(key ^ (beside + np.uint64(0x9E37))), key) % np.uint64(buckets)).astype(np.int64)


def merged(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns once, with their numbers; a hash only brings equal ones together."""
    n = rows.shape[1]
    key = np.zeros(n, np.uint64)
    for row in rows:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    rows = rows[:, order]
    begins = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if n else np.zeros(0, np.int64)
    if counts is None:
        return rows[:, begins], np.diff(np.append(begins, n))
    return rows[:, begins], np.add.reduceat(counts[order], begins) if n else counts


def mined(rows: np.ndarray, counts: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as columns of three ranks, their counts) of a bucket's fragments, those of `min_count` and more."""
    _, l2, l1, p, r1, r2 = rows
    none, begins = np.full(len(p), NONE, np.int64), rows[0] == 0
    out = []
    for kinds in ([(l1, p, none, l1 < NONE), (p, r1, none, begins & (r1 < NONE))], [(l2, l1, p, l2 < NONE), (l1, p, r1, (l1 < NONE) & (r1 < NONE)), (p, r1, r2, begins & (r2 < NONE))]):
        grams = np.concatenate([np.stack([a[ok], b[ok], c[ok]]) for a, b, c, ok in kinds], axis=1)
        many = np.concatenate([counts[ok] for *_, ok in kinds])
        order = np.lexsort((grams[2], grams[0] << 32 | grams[1]))
        grams, many = grams[:, order], many[order]
        if grams.shape[1]:
            first = np.flatnonzero(np.concatenate([[True], (grams[:, 1:] != grams[:, :-1]).any(axis=0)]))
            total = np.add.reduceat(many, first)
            enough = total >= min_count
            out.append((grams[:, first[enough]], total[enough]))
    if not out:
        return np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
    return np.concatenate([g for g, _ in out], axis=1), np.concatenate([n for _, n in out])


def _routed(chunks: DataFrame, answers: DataFrame, hot: int, buckets: int) -> DataFrame:
    """(bucket, fragments): a row per chunk and bucket."""
    texts = chunks.where("places IS NOT NULL").select("chunk", F.lit(-1).cast("long").alias("place"), "places", F.lit(None).cast("long").alias("rank"))
    ranks = answers.select("chunk", "place", F.lit(None).cast("binary").alias("places"), "rank")
    met = ranks.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", F.desc("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's ranks come first, from the last place to the first, then its texts."""
        held: list[np.ndarray] = []
        table, chunk = np.full(1, BLANK), None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, counts = merged(np.concatenate(held, axis=1))
                held.clear()
                bucket = bucket_of(rows, hot, buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    own = order[lo:hi]
                    own = own[np.lexsort((rows[2, own], rows[4, own], rows[3, own]))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])]), pa.array([pack_numbers(*rows[:, own], counts[own])], pa.binary())], ["bucket", "fragments"])

        for batch in batches:
            chunks, places, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "place", "rank"))
            edges = np.flatnonzero(np.diff(chunks)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(chunks)], strict=True):
                if lo == hi:
                    continue
                if chunks[lo] != chunk:
                    yield from flush()
                    table, chunk = np.full(1, BLANK), chunks[lo]
                known = lo + np.flatnonzero(places[lo:hi] >= 0)
                if len(known):
                    if places[known[0]] + 2 > len(table):
                        table = np.concatenate([table, np.full(int(places[known[0]]) + 2 - len(table), BLANK)])
                    table[places[known] + 1] = ranks[known].astype(np.int64)
                for packed in batch.column("places").slice(lo, hi - lo).drop_null().to_pylist():
                    at = unpack_numbers(packed, 1)[0].astype(np.int64)
                    held.append(fragments(np.where(at < len(table), table[np.minimum(at, len(table) - 1)], BLANK), hot))
        yield from flush()

    return met.mapInArrow(run, "bucket bigint, fragments binary")


def _mined(routed: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """(w1, w2, w3, a): the n-grams of two and three words, as ranks (w3 null of pairs), with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = np.concatenate(held, axis=1).astype(np.int64)
                held.clear()
                grams, counts = mined(table[:6], table[6], min_count)
                third = pa.array(grams[2], mask=grams[2] == NONE)
                yield pa.RecordBatch.from_arrays([pa.array(grams[0]), pa.array(grams[1]), third, pa.array(counts)], ["w1", "w2", "w3", "a"])

        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("fragments").to_pylist(), strict=True):
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append(unpack_numbers(packed, 7))
        yield from flush()

    dealt = routed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "w1 bigint, w2 bigint, w3 bigint, a bigint")


def association(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: the products are decimals of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    over = F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0]
    return F.call_function("div", over.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))


def mine_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, hot_pivot: int = HOT_PIVOT, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Every phrase of two or three words that stays: (lang, phrase, a, l, r, n, score)."""
    bounded_batches(docs.sparkSession)
    chunks = cut(chunked(docs, text=text, lang=lang))
    entries = chunks.where("words IS NOT NULL").select("chunk", "place", F.posexplode(F.arrays_zip("words", "langs", "counts")).alias("at", "x"))
    entries = entries.select("chunk", (F.col("place") + F.col("at")).alias("place"), F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("f"))
    counted = entries.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    ranked = cut(numbered(counted.where(F.col("f") >= min_count), [F.desc("f"), F.col("lang"), F.col("word")]))
    totals = entries.groupBy("lang").agg(F.sum("f").alias("n"))
    words = entries.agg(F.sum("f")).first()[0] or 0
    hot = ranked.where(F.col("f") > hot_pivot).count()
    buckets = 1 + words // bucket_words
    answers = entries.select("chunk", "place", "lang", "word").join(ranked.select("lang", "word", "rank"), ["lang", "word"])
    grams = cut(_mined(_routed(chunks, answers, hot, buckets), buckets, min_count))
    pairs, triples = grams.where("w3 IS NULL").drop("w3"), grams.where("w3 IS NOT NULL")

    def word(i: int) -> DataFrame:
        return ranked.select(F.col("rank").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))

    longer = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    stay = pairs.join(longer, ["w1", "w2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < covered_percent * F.col("a"))).drop("longest")
    two = stay.join(word(1), "w1").join(word(2), "w2").select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), association(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    three = three.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    three = three.withColumn("s1", association(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", association(F.col("a"), F.col("f12"), F.col("f3")))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(phrases: DataFrame, top: int = TOP, *, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Each language's first by score, count and phrase, with `rank` from 1; lists are ranked in a tree, so that no task sees all of a language."""
    phrases = cut(phrases)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = -(-phrases.count() // ranked_rows)
    while parts > 1:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        phrases = phrases.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("rank")
        parts = -(-parts // FAN_IN)
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return phrases.withColumn("rank", ranks).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")))


OP11_SQL = r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
f1 AS (SELECT lang, x AS p, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM pieces) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 1)) AS i FROM pieces WHERE len(w) > 1)) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 2)) AS i FROM pieces WHERE len(w) > 2)) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
two AS (SELECT a.lang, a.w1 || ' ' || a.w2 AS phrase, a.f AS a, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a.f * a.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM f2 a JOIN f1 x ON x.lang = a.lang AND x.p = a.w1 JOIN f1 y ON y.lang = a.lang AND y.p = a.w2
  LEFT JOIN longer b ON b.lang = a.lang AND b.w1 = a.w1 AND b.w2 = a.w2 WHERE b.f IS NULL OR 100 * b.f < 50 * a.f),
cuts AS (SELECT a.lang, a.w1 || ' ' || a.w2 || ' ' || a.w3 AS phrase, a.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
  CAST(1000000::HUGEINT * a.f * a.f // (x.f::HUGEINT * yz.f) AS BIGINT) AS s1, CAST(1000000::HUGEINT * a.f * a.f // (xy.f::HUGEINT * z.f) AS BIGINT) AS s2
  FROM f3 a JOIN f1 x ON x.lang = a.lang AND x.p = a.w1 JOIN f1 z ON z.lang = a.lang AND z.p = a.w3
  JOIN f2 xy ON xy.lang = a.lang AND xy.w1 = a.w1 AND xy.w2 = a.w2 JOIN f2 yz ON yz.lang = a.lang AND yz.w1 = a.w2 AND yz.w2 = a.w3),
stay AS (SELECT lang, phrase, a, l, r, score FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts)
SELECT lang, rank, phrase, a, l, r, n, score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay JOIN totals USING (lang)) WHERE rank <= 2000
"""
