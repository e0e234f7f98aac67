"""Candidate queries: ordered rules compiled to predicates, their trace, and the radius ladder.

A catalogue row has: id, name, category, sub, cuisine, fine, broad, brand, lat, lon, popularity,
local, known, hidden, season, and the keys name_key, sub_key, brand_key, keys made once at ingest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.taxonomy import Kinds, Taxonomy, matches

SAME_PLACE_KM = 0.1
FAMOUS, IN_SEASON = 0.6, 1.3
RADII_KM = (1.0, 2.0, 5.0, 15.0)
ENOUGH = 8
ATTRACTIONS = ("sight", "walk", "shop", "rest")


@dataclass
class Constraints:
    next_category: str | None = None
    theme: str | None = None
    month: int = 1
    include_sub: list[str] = field(default_factory=list)
    exclude_sub: list[str] = field(default_factory=list)
    include_brand: list[str] = field(default_factory=list)
    local: bool = False
    max_distance_km: float = 1.0


@dataclass
class Context:
    lat: float | None = None
    lon: float | None = None
    visited: list[str] = field(default_factory=list)


#: theme -> (predicate, score in 0..1); month is a number from 1.
THEMES: dict[str, tuple[Callable[[int], Column], Callable[[int], Column]]] = {
    "famous": (lambda m: F.col("popularity") >= FAMOUS, lambda m: F.col("popularity")),
    **{k: ((lambda k: lambda m: F.col(k) > 0)(k), (lambda k: lambda m: F.least(F.lit(1.0), F.lit(0.5) + F.col(k) / 4))(k)) for k in ("local", "known", "hidden")},
    "season": (lambda m: F.get("season", F.lit(m - 1)) >= IN_SEASON, lambda m: F.least(F.lit(1.0), F.lit(0.3) + (F.get("season", F.lit(m - 1)) - 1) / 2)),
}

#: A rule: (name, builds a predicate or None when it doesn't apply). Add to a copy to extend a query.
Rule = tuple[str, Callable[[Constraints, Context, Taxonomy, tuple[str, ...]], Column | None]]


def _category(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column:
    return F.col("category") == c.next_category if c.next_category else F.col("category").isin(*attractions)


def _theme(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    return THEMES[c.theme][0](c.month) if c.theme in THEMES else None


def _include(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    return matches(t.resolve(c.include_sub)) if c.include_sub else None


def _exclude(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    return ~matches(t.resolve(c.exclude_sub)) if c.exclude_sub else None


def _brand(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    if not c.include_brand:
        return None
    out = F.lit(False)
    for b in c.include_brand:
        out |= F.contains(F.col("brand_key"), F.lit(text.norm_of(b)))
    return out


def _visited(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    return ~F.coalesce(F.col("_seen"), F.lit(False)) if x.visited else None


def _local(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    return F.col("popularity") < FAMOUS if c.local and c.next_category in attractions else None


def _distance(c: Constraints, x: Context, t: Taxonomy, attractions: tuple[str, ...]) -> Column | None:
    return F.col("dist_km") <= c.max_distance_km if x.lat is not None else None


RULES: list[Rule] = [
    ("category", _category), ("theme", _theme), ("include", _include), ("exclude", _exclude),
    ("brand", _brand), ("visited", _visited), ("local", _local), ("distance", _distance),
]


def place(items: DataFrame, x: Context) -> DataFrame:
    """Items with dist_km from the current location (null without one)."""
    if x.lat is None:
        return items.withColumn("dist_km", F.lit(None).cast("double"))
    return items.withColumn("dist_km", geo.haversine_km(F.lit(x.lat), F.lit(x.lon), F.col("lat"), F.col("lon")))


def mark_seen(items: DataFrame, visited: list[str], km: float = SAME_PLACE_KM) -> DataFrame:
    """`_seen`: visited itself, or of a visited place's name within km of it (double entries).

    The visited places of one user are a handful; they are looked up by id, and their surroundings
    found by cells that hold all within km, so the catalogue is filtered and not paired.
    """
    mine = items.where(F.col("id").isin(*visited)).select(F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), F.col("keys").alias("v_keys"))
    mine = mine.withColumn("_c", F.explode(geo.near_cells(F.col("v_lat"), F.col("v_lon"), km)))
    placed = items.withColumn("_c", geo.near_cell(F.col("lat"), F.col("lon"), km))
    near = geo.haversine_km(F.col("v_lat"), F.col("v_lon"), F.col("lat"), F.col("lon")) <= km
    twins = placed.join(mine, "_c").where(near & text.same_name(F.col("v_keys"), F.col("keys"))).select("id").distinct()
    seen = twins.withColumn("_twin", F.lit(True))
    return items.join(seen, "id", "left").withColumn("_seen", F.col("id").isin(*visited) | F.coalesce("_twin", F.lit(False))).drop("_twin")


def compiled(c: Constraints, x: Context, taxonomy: Taxonomy, rules: list[Rule] | None = None, attractions: tuple[str, ...] = ATTRACTIONS) -> list[tuple[str, Column]]:
    """The rules that apply, as (name, predicate); null counts as false."""
    built = [(name, make(c, x, taxonomy, attractions)) for name, make in rules or RULES]
    return [(name, F.coalesce(p, F.lit(False))) for name, p in built if p is not None]


def candidates(items: DataFrame, c: Constraints, x: Context, taxonomy: Taxonomy, rules: list[Rule] | None = None, attractions: tuple[str, ...] = ATTRACTIONS) -> DataFrame:
    """Items that pass every rule, with dist_km."""
    pool = _pool(items, c, x)
    for _, p in compiled(c, x, taxonomy, rules, attractions):
        pool = pool.where(p)
    return pool


def _pool(items: DataFrame, c: Constraints, x: Context) -> DataFrame:
    pool = items
    if x.lat is not None:
        pool = pool.where(geo.box(F.col("lat"), F.col("lon"), x.lat, x.lon, c.max_distance_km))
    if x.visited:
        pool = mark_seen(pool, x.visited)
    return place(pool, x)


def trace(items: DataFrame, c: Constraints, x: Context, taxonomy: Taxonomy, rules: list[Rule] | None = None, attractions: tuple[str, ...] = ATTRACTIONS) -> DataFrame:
    """(step, rule, n_left): rows left after each rule, all from one pass; step 0 is the whole catalogue.

    With a location the rules count what lies in its box, as the query itself looks no further.
    """
    inside = geo.box(F.col("lat"), F.col("lon"), x.lat, x.lon, c.max_distance_km) if x.lat is not None else F.lit(True)
    steps, so_far, counts = ["all"], inside, [F.count("*").alias("c0")]
    for n, (name, p) in enumerate(compiled(c, x, taxonomy, rules, attractions), 1):
        so_far = so_far & p
        steps.append(name)
        counts.append(F.count_if(so_far).alias(f"c{n}"))
    totals = place(mark_seen(items, x.visited) if x.visited else items, x).agg(*counts)
    rows = F.array(*(F.struct(F.lit(n).alias("step"), F.lit(s).alias("rule"), F.col(f"c{n}").alias("n_left")) for n, s in enumerate(steps)))
    return totals.select(F.inline(rows))


def ladder(base_km: float, radii: tuple[float, ...] = RADII_KM) -> list[float]:
    """The base radius, then the wider ones."""
    return [base_km, *(r for r in radii if r > base_km)]


def widened(pool: DataFrame, radii: list[float], enough: int = ENOUGH) -> DataFrame:
    """Rows within the least radius that holds `enough`, else the widest: one pass counts for all radii."""
    counts = pool.agg(*(F.count_if(F.col("dist_km") <= r).alias(f"c{i}") for i, r in enumerate(radii)))
    chosen = F.coalesce(*(F.when(F.col(f"c{i}") >= enough, F.lit(float(r))) for i, r in enumerate(radii)), F.lit(float(radii[-1])))
    return pool.join(F.broadcast(counts.select(chosen.alias("radius_km")))).where(F.col("dist_km") <= F.col("radius_km"))


def in_service_area(items: DataFrame, lat: float, lon: float, km: float = 30.0) -> DataFrame:
    """One row (inside): whether any item lies in the box about the point."""
    return items.where(geo.box(F.col("lat"), F.col("lon"), lat, lon, km)).limit(1).agg((F.count("*") > 0).alias("inside"))


__all__ = ["Constraints", "Context", "Kinds", "RULES", "candidates", "compiled", "in_service_area", "ladder", "mark_seen", "place", "trace", "widened"]
