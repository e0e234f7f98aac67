"""Building the catalogue: kept and skipped objects, kinds, popularity tiers, names by language, merged records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_key, template_fields
from .resolve import checkpointed


@dataclass(frozen=True)
class Kinds:
    """How tags become kinds.

    `categories`: ordered (category, {tag: accepted values, or None for any}); an object is of the first whose
    every tag fits. `subs`: `k=v` -> sub-kind; `worship`: religion -> sub-kind of places of worship, others go;
    `skipped`: `k=v` that aren't kept.
    """

    categories: list[tuple[str, dict[str, list[str] | None]]]
    keys: list[str]
    subs: dict[str, str] = field(default_factory=dict)
    other: str = "other"
    worship: dict[str, str] = field(default_factory=dict)
    worship_key: str = "amenity=place_of_worship"
    skipped: list[str] = field(default_factory=list)

    def category(self, tag_map: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, wanted in reversed(self.categories):
            holds = F.lit(True)
            for k, values in wanted.items():
                value = F.try_element_at(tag_map, F.lit(k))
                holds &= F.coalesce(value.isin(*values) if values is not None else value.isNotNull(), F.lit(False))
            out = F.when(holds, name).otherwise(out)
        return out

    def key(self, tag_map: Column) -> Column:
        return first_key({k: F.try_element_at(tag_map, F.lit(k)) for k in self.keys})


def mapped(value: Column, known: dict[str, str], other: str | None = None) -> Column:
    """A value by a dictionary, else the default."""
    if not known:
        return F.lit(other)
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), value)
    return found if other is None else F.coalesce(found, F.lit(other))


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def first_language(by_language: Column, order: tuple[str, ...] = ("ko", "ja", "en")) -> Column:
    """(lang, text) of the first language that has a text; null when none has."""
    pick = [(lang, F.nullif(F.try_element_at(by_language, F.lit(lang)), F.lit(""))) for lang in order]
    out = F.lit(None)
    for lang, value in reversed(pick):
        out = F.when(value.isNotNull(), F.struct(F.lit(lang).alias("lang"), value.alias("text"))).otherwise(out)
    return out


def stripped(rows: DataFrame) -> DataFrame:
    """Empty lists and maps as nulls, so that a JSON writer leaves them out."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    return rows.select(*(F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c] in ("array", "map") else F.col(c) for c in rows.columns))


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the values of the right record of the same key where it has any; the right side wins."""
    both = [c for c in right.columns if c != key]
    other = right.select(F.col(key), *(F.col(c).alias(f"_r_{c}") for c in both))
    out = left.join(other, key, "left")
    new = {c: F.coalesce(f"_r_{c}", c) if c in left.columns else F.col(f"_r_{c}") for c in both}
    return out.withColumns(new).drop(*(f"_r_{c}" for c in both))


def attractions(objects: DataFrame, known: DataFrame, kinds: Kinds) -> DataFrame:
    """(id, name, name_ja, brand, category, sub, lat, lon, popularity, pop_tier, wikidata, sources) of objects to keep.

    objects: osm_id, tags MAP, lat, lon; known: qid, ko, scaled (null where the entity has no views of its own).
    The first known entity of `a;b` counts: with views tier 1, without tier 2, no entity tier 3.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    rows = objects.withColumns({"category": kinds.category(F.col("tags")), "_key": kinds.key(F.col("tags"))})
    rows = rows.where(F.col("category").isNotNull() & F.coalesce(tag("name") != "", F.lit(False)) & ~F.col("_key").isin(*kinds.skipped or [""]))
    worship = F.col("_key") == kinds.worship_key
    rows = rows.withColumn("sub", F.when(worship, mapped(tag("religion"), kinds.worship)).otherwise(mapped(F.col("_key"), kinds.subs, kinds.other))).where(~worship | F.col("sub").isNotNull())
    parts = rows.select("osm_id", F.posexplode(F.transform(F.split(F.coalesce(tag("wikidata"), F.lit("")), ";"), lambda q: F.trim(q))).alias("_at", "qid"))
    first = parts.join(known, "qid").groupBy("osm_id").agg(F.min_by(F.struct("qid", "ko", "scaled"), "_at").alias("_e"))
    out = rows.join(first, "osm_id", "left")
    tier = F.when(F.col("_e.scaled").isNotNull(), 1).when(F.col("_e").isNotNull(), 2).otherwise(3)
    popularity = F.when(tier == 1, F.round(0.2 + 0.8 * F.col("_e.scaled"), 3)).when(tier == 2, 0.1).otherwise(0.05)
    return out.select(
        F.concat(F.lit("osm_"), F.col("osm_id").cast("string")).alias("id"), filled(F.col("_e.ko"), tag("name:ko"), tag("name")).alias("name"), tag("name").alias("name_ja"), tag("brand").alias("brand"),
        "category", "sub", "lat", "lon", popularity.alias("popularity"), tier.alias("pop_tier"), F.col("_e.qid").alias("wikidata"), F.when(F.col("_e").isNull(), F.array(F.lit("osm"))).otherwise(F.array(F.lit("osm"), F.lit("wikidata"))).alias("sources"),
    )


def explicit_first(fine: Column, first: Column, parents: dict[str, str], parent: Column) -> Column:
    """A fine code moved to the front of those that share the parent."""
    known = F.create_map(*(F.lit(x) for pair in parents.items() for x in pair))
    return F.concat(F.array(first), F.filter(fine, lambda f: (f != first) & (F.try_element_at(known, f) == parent)))


def listings(pages: DataFrame, key: str, body: str, *, kinds: tuple[str, ...] = ("eat", "drink"), open_kind: str = "listing") -> DataFrame:
    """(key, place, kind, section, fields) of templates on pages, in order, with a name.

    A template of an open kind counts only in a section named like one of the kinds, and is of that kind.
    Headings and templates are taken in one pass; the heading in force comes from a running window per page.
    """
    tokens = r"(?is)((?:^|\n)==\s*[^=]+?\s*==|\{\{\s*(?:" + "|".join((*kinds, open_kind)) + r")\s*\|(?:[^{}]|\{\{[^{}]*\}\})*\}\})"
    parts = pages.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(tokens), F.lit(1))).alias("place", "token"))
    heading = F.when(~F.startswith("token", F.lit("{{")), F.lower(F.trim(F.regexp_extract("token", r"==\s*([^=]+?)\s*==", 1))))
    sofar = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("section", F.last(heading, ignorenulls=True).over(sofar)).where(F.startswith("token", F.lit("{{")))
    named = F.lower(F.regexp_extract("token", r"^\{\{\s*(\w+)", 1))
    inside = F.regexp_extract("token", r"(?s)^\{\{\s*\w+\s*\|(.*)\}\}$", 1)
    rows = placed.select(key, "place", F.when(named == open_kind, F.col("section")).otherwise(named).alias("kind"), "section", template_fields(inside).alias("fields"))
    return rows.where(F.col("kind").isin(*kinds) & F.coalesce(F.try_element_at("fields", F.lit("name")) != "", F.lit(False)))


def below(edges: DataFrame, root: str, most: int = 15) -> DataFrame:
    """(start, depth, inside): how many parents up a chain goes, at most so many, and whether root is among them.

    edges: start, up; a start may have several parents, and cycles end at `most`. A round takes chains one parent
    further, over starts that are parents themselves only, each ending in a reliable checkpoint; when a round changes
    nothing, or the last but one is reached, one join gives all starts theirs.
    """

    def further(rows: DataFrame, known: DataFrame) -> DataFrame:
        met = rows.join(known.select(F.col("start").alias("up"), "depth", F.col("inside").alias("_above")), "up", "left")
        here, above = F.col("up") == root, F.col("_above")
        return met.groupBy("start").agg((1 + F.max(F.coalesce("depth", F.lit(0)))).cast("int").alias("depth"), F.bool_or(F.coalesce(here | above, here, above)).alias("inside"))

    inner = checkpointed(edges.join(edges.select(F.col("up").alias("start")).distinct(), "start", "left_semi"))
    known = checkpointed(inner.select("start", F.lit(1).alias("depth"), (F.col("up") == root).alias("inside")).groupBy("start").agg(F.max("depth").alias("depth"), F.bool_or("inside").alias("inside")))
    for _ in range(2, most):
        now = checkpointed(further(inner, known))
        same = (F.col("a.depth") == F.col("b.depth")) & F.col("a.inside").eqNullSafe(F.col("b.inside"))
        settled = now.alias("a").join(known.alias("b"), "start").where(~same).isEmpty()
        known = now
        if settled:
            break
    return further(edges, known if most > 1 else known.limit(0))
