"""Name normalisation and text extraction."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC form. Spark has none of its own: call it once per name, at ingest."""
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return s.map(lambda x: None if x is None else html.unescape(x))


def bare(s: Column) -> Column:
    """Lower-case letters and digits of a text already in NFKC form."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def norm(s: Column) -> Column:
    """NFKC, lower case, letters and digits only; null counts as empty."""
    return bare(nfkc(F.coalesce(s, F.lit(""))))


def norm_of(s: str | None) -> str:
    """`norm` of one value, where a query is built."""
    return re.sub(r"[\W_]", "", unicodedata.normalize("NFKC", s or "").lower())


def folded(s: Column, done: bool = False) -> Column:
    """The NFKC form of a name, empty for null; `done`: it is in that form already, so no Python runs."""
    s = F.coalesce(s, F.lit(""))
    return s if done else nfkc(s)


def term_key(s: Column) -> Column:
    """NFKC, lower case, without spaces, middle dots, slashes and brackets."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(s, F.lit("")))), r"[\s·・/()（）]", "")


def name_keys(s: Column, generic: list[str] | None = None, folded: bool = False) -> Column:
    """Comparison keys of a name: all of it (2+ characters), and without a branch token (3+, not generic).

    `folded`: the text is in NFKC form already, so no Python runs.
    """
    s = F.coalesce(s, F.lit("")) if folded else nfkc(F.coalesce(s, F.lit("")))
    whole = bare(s)
    short = bare(F.regexp_replace(s, r"\s+\S*店$", ""))
    keep = (F.length(short) >= 3) & ~F.coalesce((short == whole) & (F.length(whole) >= 2), F.lit(False))
    if generic:
        keep &= ~short.isin(*generic)
    return F.array_compact(F.array(F.when(F.length(whole) >= 2, whole), F.when(keep, short)))


def same_name(a: Column, b: Column) -> Column:
    """Whether a key of one name holds a key of the other; a and b are `name_keys`."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def first_match(s: Column, rules: list[tuple[str, str]], *, done: bool = False) -> tuple[Column, Column]:
    """(label of the first pattern that matches, labels of all that do) by ordered rules (label, pattern), on NFKC text."""
    s = folded(s, done)
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(s.rlike(f"(?iu){p}"), label) for label, p in rules))))
    return F.get(hits, F.lit(0)), hits


def first_key(fields: dict[str, Column]) -> Column:
    """`k=v` of the first field that isn't null, in order; empty when none is."""
    return F.coalesce(*(F.when(c.isNotNull(), F.concat(F.lit(k + "="), c)) for k, c in fields.items()), F.lit(""))


def map_string(m: Column) -> Column:
    """A map as `k=v` joined by spaces."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")


def leaf(path: Column, separator: str = " > ") -> Column:
    return F.element_at(F.split(path, separator), -1)


def price_bucket(s: Column, least: int = 50, edges: tuple[int, int] = (1000, 3000)) -> Column:
    """low, mid or high by the least price named (`¥ n`, `n yen`), ignoring tiny ones."""
    found = F.regexp_extract_all(F.regexp_replace(s, ",", ""), F.lit(r"(?i)(?:[¥￥]\s*(\d{2,7})|(\d{2,7})\s*(?:円|yen))"), F.lit(0))
    least_price = F.array_min(F.filter(F.transform(found, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int")), lambda x: x >= least))
    return F.when(least_price < edges[0], "low").when(least_price < edges[1], "mid").when(least_price.isNotNull(), "high")


def strip_tags(s: Column, most: int | None = None) -> Column:
    """Text without tags, optionally cut to a length."""
    plain = F.trim(F.regexp_replace(s, r"<[^>]+>", ""))
    return F.substring(plain, 1, most) if most else plain


def slug(*parts: Column, most: int = 40) -> Column:
    """Parts fit for a file name, joined by dashes."""
    return F.concat_ws("-", *(F.substring(F.regexp_replace(p, r"[^A-Za-z0-9]+", "_"), 1, most) for p in parts))


def quoted(s: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def sparkline(values: Column, bars: str = "▁▂▃▄▅▆▇█") -> Column:
    """A bar per value, scaled from the least to the greatest."""
    low, high = F.array_min(values), F.array_max(values)
    step = F.when(high > low, (high - low)).otherwise(F.lit(1.0))
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(bars), (F.floor((v - low) / step * (len(bars) - 1)) + 1).cast("int"), F.lit(1))), "")


def template_fields(body: Column) -> Column:
    """Map of `k=v` parts cut at bars outside [[links]]; keys are in lower case, of equal ones the last counts."""
    parts = F.filter(F.split(body, r"\|(?![^\[]*\]\])"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1))).alias("k"), F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: p["k"] != "")
    return F.aggregate(kept, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def templates(page: Column, kind: str) -> Column:
    """Bodies of {{kind|...}} occurrences, in order."""
    return F.regexp_extract_all(page, F.lit(r"(?is)\{\{\s*" + kind + r"\s*\|((?:[^{}]|\{\{[^{}]*\}\})*)\}\}"), F.lit(1))
