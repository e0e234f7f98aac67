"""Finding rows by a part of a name: lists of rows for every run of one to three letters.

A list holds the rows whose key has the run somewhere, with the columns that an answer shows. Lists lie one after
another in files sorted by run, with small row groups, so a question reads the groups of one list and no table:
of the question's runs it takes the rarest, by a small table of counts, and of that list the rows that hold the
whole question. A question of up to three letters is a run itself, and its list the answer.

Cases: an empty question finds nothing; a question with a run that no key has reads no list; a null or empty key
is in no list; equal rows are found each. A run that very many keys have is spread over files by the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = 3
#: Bytes of a row group before compression, and rows of a page: a list is read by pages.
GROUP_BYTES, PAGE_ROWS = 1 << 20, 1_000


def runs(key: Column, letters: int = LETTERS) -> Column:
    """The distinct runs of one to `letters` letters of a key."""
    n = F.length(key)
    none = F.array().cast("array<string>")
    of = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(key, i, F.lit(size)))).otherwise(none)
    return F.array_distinct(F.concat(*(of(size) for size in range(1, letters + 1))))


def runs_of(question: str, letters: int = LETTERS) -> list[str]:
    """What a question is looked up by: its runs of `letters`, or itself where it is shorter."""
    return sorted({question[i : i + letters] for i in range(max(1, len(question) - letters + 1))})


@dataclass(frozen=True)
class NameIndex:
    """An index that `write` has written."""

    spark: SparkSession
    folder: str
    key: str

    @staticmethod
    def write(rows: DataFrame, key: str, folder: str, *, files: int | None = None) -> None:
        """Writes lists with all columns of the rows: hand over those that answers show."""
        lists = rows.where(F.length(key) > 0).select("*", F.explode(runs(F.col(key))).alias("run"))
        files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lists.repartitionByRange(files, "run", key).sortWithinPartitions("run", key)
        dealt.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/lists")
        lists.groupBy("run").agg(F.count("*").alias("n")).repartitionByRange(max(1, files // 8), "run").sortWithinPartitions("run").write.parquet(f"{folder}/counts")

    def holding(self, question: str) -> DataFrame:
        """The rows whose key holds the question."""
        lists = self.spark.read.parquet(f"{self.folder}/lists")
        wanted = runs_of(question)
        counts = {r["run"]: r["n"] for r in self.spark.read.parquet(f"{self.folder}/counts").where(F.col("run").isin(wanted)).collect()} if question else {}  # a row a letter at most
        if len(counts) < len(wanted):
            return lists.drop("run").limit(0)
        rarest = min(wanted, key=lambda run: (counts[run], run))
        found = lists.where(F.col("run") == rarest).drop("run")
        return found if len(question) <= LETTERS else found.where(F.contains(self.key, F.lit(question)))

    def equal(self, question: str) -> DataFrame:
        """The rows whose key is the question."""
        return self.holding(question).where(F.col(self.key) == question)


def holding(rows: DataFrame | NameIndex, key: str, question: str) -> DataFrame:
    """The rows whose key holds the question, of an index or of a table that is read for it."""
    return rows.holding(question) if isinstance(rows, NameIndex) else rows.where(F.contains(key, F.lit(question)) & F.lit(bool(question)))
