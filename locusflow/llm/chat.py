"""Chat formatting with DataFrame functions only: cumulative snapshots collapse before rendering.

Logs often hold a conversation after each of its turns. Every turn gets a digest; the rolling hash of
a conversation's first k turns is the exclusive-or of digests tagged with their place, so a running
window gives the hashes of all prefixes from digests alone, without texts. A conversation whose whole
hash is a proper prefix's hash of some other one goes by an anti join; of equal conversations the
smallest id stays. What is left is rendered turn by turn.

Prefix hashes are reduced to distinct ones before the join, so a first turn that many conversations
share costs one row. Turns are ordered by (turn, digest); 128 bits of hash and the number of turns
decide equality.

Cases: a null role or text counts as empty, an empty role renders as `user`; a row without a conv_id belongs
to nothing else, so it is a conversation of one turn, with a null conv_id; repeated turn numbers are
ordered by digest; equal rows are turns each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _digested(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(F.concat(role, F.lit("\x1f"), text)).alias("digest"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, whole): the rolling hash after each turn; `whole` marks the last turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _digested(turns).where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "digest").withColumn("n", F.row_number().over(order))
    return placed.select("conv_id", "n", F.bit_xor(_h1()).over(running).alias("h1"), F.bit_xor(_h2()).over(running).alias("h2"), F.lead("n").over(order).isNull().alias("whole"))


def _h1():
    return F.xxhash64("n", "digest")


def _h2():
    return F.xxhash64("digest", "n")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, role, text) of conversations that are no prefix of another, equal ones once.

    role and text are those of a conversation known by rows without a conv_id alone, else null.
    """
    hashes = prefix_hashes(turns)
    proper = hashes.where(~F.col("whole")).select("n", "h1", "h2").distinct()
    alone = _digested(turns).where(F.col("conv_id").isNull()).withColumn("n", F.lit(1)).select("conv_id", "n", _h1().alias("h1"), _h2().alias("h2"), F.struct("role", "text").alias("turn"))
    several = hashes.where("whole").drop("whole").unionByName(alone, allowMissingColumns=True)
    whole = several.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.first("turn", ignorenulls=True).alias("turn"))
    left = whole.join(proper, ["n", "h1", "h2"], "left_anti")
    own = F.when(F.col("conv_id").isNull(), F.col("turn"))
    return left.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies", own["role"].alias("role"), own["text"].alias("text"))


def _shown(x):
    return F.concat(F.lit(BEGIN), F.when(x["role"] == "", "user").otherwise(x["role"]), F.lit("\n"), x["text"], F.lit(END + "\n"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per kept conversation with its rendered text; what is kept is written to a checkpoint, for both branches need it."""
    kept = cut(kept)
    keys = kept.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("kept_id"), "n_turns", "n_copies")
    rows = _digested(turns).join(keys, F.col("conv_id") == F.col("kept_id"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "digest", "role", "text")))
    grouped = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), ordered.alias("turns"))
    named = grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", _shown), "").alias("text"))
    alone = kept.where(F.col("conv_id").isNull()).select("conv_id", "n_turns", "n_copies", _shown(F.struct("role", "text")).alias("text"))
    return named.unionByName(alone)


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, maximal_conversations(turns))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS digest FROM conversations),
s AS (SELECT *, '<|im_start|>' || CASE WHEN role = '' THEN 'user' ELSE role END || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(digest ORDER BY turn NULLS FIRST, digest) AS ds, string_agg(shown, '' ORDER BY turn NULLS FIRST, digest) AS text FROM s WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, 1, [digest], shown FROM s WHERE conv_id IS NULL),
p AS (SELECT DISTINCT array_to_string(ds[1:k], ',') AS g FROM (SELECT ds, unnest(generate_series(1, n_turns - 1)) AS k FROM c)),
w AS (SELECT array_to_string(ds, ',') AS g, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies, min(text) AS text FROM c GROUP BY 1)
SELECT conv_id, n_turns, n_copies, text FROM w WHERE g NOT IN (SELECT g FROM p)
"""
