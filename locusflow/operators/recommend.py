"""One recommendation from end to end: what was asked, the radius, the list, its cards, and what is logged."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.taxonomy import Taxonomy
from . import candidates as c
from . import ranking
from .candidates import Constraints, Context

FOOD = ("meal", "cafe", "bar")
THEME_KM = 5.0
FAMOUS_AT = c.FAMOUS


@dataclass
class Answer:
    """`shown`: a row a place, in order; `turn`: one row with the sentence, the radii and the counts."""

    shown: DataFrame
    turn: DataFrame


@dataclass
class Words:
    """What a result is called: by category, by theme (with {month}), by kind code."""

    categories: dict[str, str] = field(default_factory=dict)
    themes: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)


def asked(intent: Constraints) -> Constraints:
    """The constraints as they are searched: no unknown theme, and none for food."""
    theme = intent.theme if intent.theme in c.THEMES and intent.next_category not in FOOD else None
    return replace(intent, theme=theme)


def radii(intent: Constraints, wider: tuple[float, ...] = c.RADII_KM) -> list[float]:
    """The asked radius and the wider ones; with a theme none below five kilometres."""
    least = THEME_KM if intent.theme else intent.max_distance_km
    return [r for r in (intent.max_distance_km, *wider) if r >= least]


def tags(month: int) -> Column:
    """Display tags of a place, in a fixed order."""
    theme = lambda k: c.THEMES[k][0](month)
    return F.array_compact(
        F.array(
            F.when((F.col("popularity") >= FAMOUS_AT) & F.col("category").isin(*c.ATTRACTIONS), "famous"),
            F.when(theme("local"), "local"), F.when(theme("known"), "known"), F.when(theme("hidden"), "hidden"), F.when(theme("season"), f"month {month}"),
        )
    )


def kind(words: Words) -> Column:
    """The name of the first fine code, else the sub-kind; null where the code has no name."""
    names = F.create_map(*(F.lit(x) for pair in words.kinds.items() for x in pair)) if words.kinds else None
    first = F.get("fine", F.lit(0))
    named = F.try_element_at(names, first) if names is not None else F.lit(None).cast("string")
    return F.when(first.isNotNull(), named).otherwise(F.col("sub"))


def cards(rows: DataFrame, month: int, words: Words, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a client shows of places that have a dist_km."""
    return rows.select(*keep, "id", "name", F.nullif("name_ja", "name").alias("name_ja"), "category", kind(words).alias("kind"), F.round(F.col("dist_km") * 1000, 0).cast("bigint").alias("distance_m"), "lat", "lon", tags(month).alias("tags"))


def sentence(intent: Constraints, words: Words, n: Column, radius: Column) -> Column:
    """What was found, named by the kinds asked for, else the theme, else the category."""
    what = ", ".join(intent.include_sub) or words.themes.get(intent.theme or "", "").format(month=intent.month) or words.categories.get(intent.next_category or "", "")
    found = F.concat(F.lit(f"{what}: "), n.cast("string"), F.lit(" found"))
    return F.when(n > 0, found).otherwise(F.concat(F.lit("nothing fits within "), F.format_string("%.0f", radius), F.lit(" km")))


def top_of_rungs(pool: DataFrame, rungs: list[float], score, n: int = ranking.SHOWN, chance: Column | None = None) -> DataFrame:
    """The list of the least radius that has n rows, else of the widest; `score(rows)` scores rows with a radius_km.

    One pass: each row enters the lists of the radii it lies within, every list is cut to a few rows in the tasks, and only
    then is it known, by the lists' lengths, which of them is shown.
    """
    within = pool.withColumn("radius_km", F.explode(F.filter(F.array(*map(F.lit, map(float, rungs))), lambda r: F.col("dist_km") <= r)))
    lists = ranking.top_list(score(within), by=["radius_km"], n=n, chance=chance)
    rows = F.struct("radius_km", "rank", F.struct(*lists.columns).alias("row"))
    all_ = lists.agg(F.array_sort(F.collect_list(rows)).alias("all"))  # n rows a radius
    of = lambda r: F.filter("all", lambda x: x["radius_km"] == r)
    chosen = F.coalesce(*(F.when(F.size(of(F.lit(float(r)))) >= n, F.lit(float(r))) for r in rungs), F.lit(float(rungs[-1])))
    shown = all_.select(F.explode(of(chosen)).alias("x"))
    return shown.select(*(F.col(f"x.row.`{c}`").alias(c) for c in lists.columns))


def recommend(items: DataFrame, intent: Constraints, at: Context, taxonomy: Taxonomy, *, prefs: DataFrame | None = None, n_reactions: int = 0, words: Words | None = None, chance: Column | None = None) -> Answer:
    """Eight places for one user.

    prefs: sub, a, b of that user, a row a kind. The list and the turn each take one pass over the pool of the widest radius; the
    least radius with eight candidates is taken.
    """
    words, want = words or Words(), asked(intent)
    rungs = radii(want)
    pool = c.candidates(items, replace(want, max_distance_km=rungs[-1]), at, taxonomy)
    if prefs is not None:
        known = pool.join(prefs.select("sub", "a", "b"), "sub", "left")
    else:
        known = pool.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(None).cast("double")})
    content = F.round(F.coalesce(F.col("a") / (F.col("a") + F.col("b")), F.lit(0.5)), 6)
    w = F.lit(n_reactions / (n_reactions + ranking.SETTLING))
    pop = c.THEMES[want.theme][1](want.month) if want.theme else F.coalesce("popularity", F.lit(0.0))
    shown = top_of_rungs(known, rungs, lambda rows: ranking.scored(rows, radius=F.col("radius_km"), w=w, content=content, popularity=pop), chance=chance)
    logged = ("rank", "slot", "score", "pop", F.col("content").alias("taste"), "radius_km")
    held = pool.agg(*(F.count_if(F.col("dist_km") <= r).alias(f"c{i}") for i, r in enumerate(rungs)))
    chosen = F.coalesce(*(F.when(F.col(f"c{i}") >= ranking.SHOWN, F.struct(F.col(f"c{i}").alias("n"), F.lit(float(r)).alias("r"))) for i, r in enumerate(rungs)), F.struct(F.col(f"c{len(rungs) - 1}").alias("n"), F.lit(float(rungs[-1])).alias("r")))
    counts, radius = held.select(chosen["n"].alias("n_candidates"), chosen["r"].alias("radius_km")), F.col("radius_km")
    n = F.least("n_candidates", F.lit(ranking.SHOWN))
    wider = F.when((radius > want.max_distance_km) & (F.col("n_candidates") > 0), F.concat(F.lit("few are near: searched up to "), F.format_string("%.0f", radius), F.lit(" km")))
    unknown = taxonomy.resolve(want.include_sub).unresolved + taxonomy.resolve(want.exclude_sub).unresolved
    notes = F.array_compact(F.array(*(F.lit(f"'{t}' is no known kind: looked for in names") for t in unknown), wider))
    turn = counts.select(sentence(want, words, n, radius).alias("answer"), radius.alias("radius_km"), F.lit(want.max_distance_km).alias("radius_asked"), "n_candidates", n.cast("int").alias("n_shown"), notes.alias("notes"))
    return Answer(cards(shown, want.month, words, logged), turn)


def ranking_view(taste: Column, n_reactions: Column, current: Column, visited: Column) -> Column:
    """Of a user's profile what ranking reads: preferences, how many reactions they rest on, and the situation."""
    return F.struct(taste.alias("preferences"), n_reactions.alias("n_reactions"), F.struct(current.alias("current"), visited.alias("visited")).alias("context"))


def turn_context(current: Column, visited: Column, month: int, *, source: Column, places: int = 2) -> Column:
    """What a log keeps of the situation: a position from a device only coarsely, with its geohash."""
    from_device = source == "gps"
    return F.struct(
        geo.coarse(current["lat"], from_device, places).alias("lat"), geo.coarse(current["lon"], from_device, places).alias("lon"),
        geo.geohash(current["lat"], current["lon"], 6).alias("area_geo"), visited.alias("visited"), F.lit(month).alias("month"),
    )


def accepted_theme(theme: Column, message: Column, words: str) -> Column:
    """A theme only where the message itself speaks of one."""
    return F.when(message.rlike(f"(?iu){words}"), theme)


def without_stop_words(kinds: Column, stop: list[str]) -> Column:
    """A list without words that name no kind; repeats stay."""
    return F.filter(kinds, lambda k: ~k.isin(*stop)) if stop else kinds


def located(current: Column, sent: Column, inside: Column) -> Column:
    """The position that was sent, unless it is outside the service area; then the one known before."""
    return F.when(sent.isNotNull() & inside, sent).otherwise(current)


def shown_rank(shown: Column, place: Column) -> Column:
    """The place's number in the shown list from 1; null where it isn't in it."""
    return F.nullif(F.array_position(shown, place), F.lit(0))
