"""Chains and brands in names, as a join with a dimension table of any length.

Every place of a name where a chain may stand gives the texts that a chain there could have; they meet
the dimension's names by equality. So the plan is the same for ten chains and for a million, a chain's name is never a
pattern, and Spark picks the join by the dimension's size. Keywords, a short list by rank of priority, stay
patterns. Names are expected in NFKC form (`text.folded`); a null name is an empty one; equal rows are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match, folded

#: What separates words in a name, what else a chain may stand after, what may follow it, and how a branch ends.
SPACE, DOT, BRACKETS, BRANCH = r"\s", "・", "(（", "店"


def dimension(rows: DataFrame, *, name: str = "name", done: bool = False) -> DataFrame:
    """The rows with `shown`, the name in NFKC form without spaces at its ends, and `met`, the lower-case text it is joined by; both are null of rows without a name."""
    shown = F.trim(folded(F.col(name), done))
    return rows.withColumn("shown", F.when(F.length(shown) > 0, shown)).withColumn("met", F.lower("shown"))


def longest(table: DataFrame) -> int:
    """Characters of the longest name of a dimension: one number for the driver."""
    return table.agg(F.max(F.length("shown"))).first()[0] or 0


def standing(name: Column, most: int) -> Column:
    """(begin, end, met) of each text of at most `most` characters that a chain's name could be; places count from 1.

    It begins the name or follows a space or middle dot. It ends the name, or a space or bracket follows, or letters
    without a space that end in a branch's sign.
    """
    n = F.length(name)
    at = lambda i: F.substring(name, i, F.lit(1)) if isinstance(i, int) else F.substr(name, i, F.lit(1))
    opens = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | at(i - 1).rlike(f"[{SPACE}{DOT}]"))
    last_word = n - F.length(F.regexp_extract(name, r"\S*$", 0))  # characters before the last word
    branch = name.endswith(BRANCH)
    closes = lambda e: (e == n) | at(e + 1).rlike(f"[{SPACE}{BRACKETS}]") | (branch & (e >= last_word))
    whole = F.transform(opens, lambda b: F.transform(F.filter(F.sequence(b, F.least(b + most - 1, n)), closes), lambda e: F.struct(b.alias("begin"), e.alias("end"), F.lower(F.substr(name, b, e - b + 1)).alias("met"))))
    return F.when(n > 0, F.flatten(whole)).otherwise(F.array().cast("array<struct<begin:int,end:int,met:string>>"))


def _found(names: DataFrame, table: DataFrame, most: int, name: str, keep: list[str]) -> DataFrame:
    """(the columns in `keep`, name, begin, end and the dimension's) for each place that holds a name of the dimension."""
    spots = names.select(*keep, F.col(name).alias("whole"), F.explode(standing(F.col(name), most)).alias("spot"))
    return spots.select(*keep, "whole", "spot.begin", "spot.end", F.col("spot.met").alias("met")).join(table, "met")


def beside(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """Labels of the keywords in a text, by priority."""
    return first_match(text, keywords, done=True)[1]


def label_by_chains(names: DataFrame, chains: DataFrame, keywords: list[tuple[str, str]], *, key: str = "id", name: str = "name") -> DataFrame:
    """The names with (label, matched, kind): categories of the chains in them and of keywords, chains first.

    `chains`: a dimension with `seq` (its order), `category` and `start_only`. Keywords outside the chains' names
    outweigh the chains where none of them is a chain's category.
    """
    names = names.withColumn(name, F.coalesce(name, F.lit("")))
    table = chains.select("met", "shown", "seq", "category", "start_only")
    found = _found(names, table, longest(chains), name, [key]).where(~F.col("start_only") | (F.col("begin") == 1))
    held = found.groupBy(F.col(key).alias("own"), "whole").agg(F.array_sort(F.collect_set(F.struct("seq", "category", "shown"))).alias("hits"))
    met = names.join(held, F.col(key).eqNullSafe(F.col("own")) & (F.col(name) == F.col("whole")), "left").drop("own", "whole")
    none = F.array().cast("array<string>")
    categories = F.coalesce(F.array_distinct(F.transform("hits", lambda h: h["category"])), none)
    outside = F.coalesce(F.aggregate("hits", F.col(name), lambda left, h: F.replace(left, h["shown"], F.lit(" "))), F.col(name))
    met = met.withColumn("chains", categories).withColumn("outside", beside(outside, keywords))
    stay = F.when((F.size("outside") == 0) | F.arrays_overlap("chains", "outside"), F.col("chains")).otherwise(none)
    met = met.withColumn("chains", stay).withColumn("matched", F.array_distinct(F.concat("chains", beside(F.col(name), keywords))))
    kind = F.when(F.size("chains") > 0, "chain").when(F.size("matched") > 0, "keyword")
    return met.withColumns({"label": F.get("matched", F.lit(0)), "kind": kind}).drop("hits", "chains", "outside")


def label_by_brands(names: DataFrame, brands: DataFrame, keywords: list[tuple[str, str]], *, key: str = "id", name: str = "name", brand_keys: str = "keys") -> DataFrame:
    """The names with (label, rule, source): the first entity id of `a;b` that a brand has, else a brand at the beginning.

    `brands`: a dimension with `seq`, `category`, `brand_key` and `source`; one without a name (`met` null) is known by its id
    alone. A name of one letter isn't looked for. Another keyword after the first brand's name leaves the row without a label.
    """
    names = names.withColumn(name, F.coalesce(name, F.lit("")))
    ids = names.select(key, name, F.posexplode(F.split(F.col(brand_keys), ";")).alias("place", "brand_key")).withColumn("brand_key", F.trim("brand_key"))
    by_id = ids.join(brands.select("brand_key", "category", "source", "seq"), "brand_key")
    by_id = by_id.groupBy(F.col(key).alias("own"), F.col(name).alias("whole")).agg(F.min_by(F.struct(F.col("category").alias("label"), F.lit("brand_key").alias("rule"), "source"), F.struct("place", F.col("seq") * -1)).alias("by_id"))
    table = brands.where(F.length("shown") >= 2).select("met", "seq", "category", "brand_key", "source")
    found = _found(names, table, longest(brands), name, [key]).where("begin = 1")
    first = found.groupBy(F.col(key).alias("own"), "whole").agg(F.min(F.struct("seq", "end", "category", "brand_key", "source")).alias("first"))
    same = lambda x: F.col(key).eqNullSafe(x["own"]) & (F.col(name) == x["whole"])
    met = names.join(by_id, same(by_id), "left").drop("own", "whole").join(first, same(first), "left").drop("own", "whole")
    after = beside(F.concat(F.lit(" "), F.substr(name, F.col("first.end") + 1)), keywords)
    fits = (F.size(after) == 0) | F.array_contains(after, F.col("first.category"))
    by_name = F.when(F.col("first").isNotNull() & fits, F.struct(F.col("first.category").alias("label"), F.lit("brand_name").alias("rule"), F.concat(F.col("first.source"), F.lit(" via "), F.col("first.brand_key")).alias("source")))
    met = met.withColumn("found", F.coalesce("by_id", by_name)).drop("by_id", "first")
    return met.select("*", "found.*").drop("found")
