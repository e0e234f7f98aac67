"""Names without their branch endings, and fine codes of category paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of branch endings, in the order they are tried.
BRANCH_ENDINGS = (r"\s+\S*店$", r"\S{1,8}支店$", r"\S{1,8}店$")


def without_branch(name: Column) -> Column:
    """A name without its branch ending: of the endings the first that leaves two letters or more."""
    bare = F.trim(name)
    cuts = [F.trim(F.regexp_replace(bare, p, "")) for p in BRANCH_ENDINGS]
    return F.coalesce(*(F.when((c != bare) & (F.length(c) >= 2), c) for c in cuts), bare)


def fine_codes(leaves: Column, code_of: dict[str, str], separator: str = " > ") -> Column:
    """Distinct fine codes of category paths by their last part, in order; unknown ones are left out."""
    known = F.create_map(*(F.lit(x) for pair in code_of.items() for x in pair))
    return F.array_distinct(F.array_compact(F.transform(leaves, lambda p: F.try_element_at(known, F.element_at(F.split(p, separator), -1)))))
