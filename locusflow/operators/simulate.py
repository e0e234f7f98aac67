"""Simulated users with hidden tastes walk through a plan of turns under several ranking policies.

Each (policy, seed) is an independent walk; all policies of a seed share its user and its start. All walks
take a turn at once: each meets, by cells, the places of the turn's category within the widest radius of where it
stands, and its state goes on to the next turn with a reliable checkpoint. So what a task holds at a time are the
places of one category that lie so near one walker, whatever the size of the catalogue and the way walked.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .ordered import numbered
from .ranking import DISTANCE_WEIGHT, EVENTS, SETTLING, SHOWN
from .resolve import checkpointed, within_cells

POLICIES = ("learned", "fixed", "distance", "random")
OUT = "policy string, seed long, turn int, category string, chosen boolean, rank int, shown int, subs int, short boolean"


@dataclass(frozen=True)
class Settings:
    plan: tuple[str, ...] = ("meal", "sight", "cafe", "walk", "meal", "shop", "bar")
    accept: float = 0.45  # a list whose best place is liked less is refused
    noise: float = 0.1
    radii: tuple[float, ...] = (1.0, 2.0)
    shown: int = SHOWN
    favourites: tuple[float, ...] = (1.0, 0.8, 0.6)
    dull: float = 0.3  # other kinds are liked up to this much


@dataclass
class _Catalogue:
    id: np.ndarray
    category: np.ndarray
    sub: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    popularity: np.ndarray

    def km(self, lat: float, lon: float) -> np.ndarray:
        up, over = np.radians(self.lat - lat) / 2, np.radians(self.lon - lon) / 2
        h = np.sin(up) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(self.lat)) * np.sin(over) ** 2
        return 12742.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


class _Learner:
    """Beta counts by kind, as `ranking.preferences` has them."""

    def __init__(self) -> None:
        self.counts: dict[str, list[float]] = {}
        self.reactions = 0

    def content(self, subs: np.ndarray) -> np.ndarray:
        return np.array([a / (a + b) for a, b in (self.counts.get(s, (1.0, 1.0)) for s in subs)])

    def react(self, sub: str, event: str, position: int = 0) -> None:
        side, weight = EVENTS[event]
        self.counts.setdefault(sub, [1.0, 1.0])["ab".index(side)] += weight / (1 + position if event == "skip" else 1)
        self.reactions += 1


def _tastes(kinds: list[tuple[str, str]], rng: np.random.Generator, s: Settings) -> dict[tuple[str, str], float]:
    """kinds: all (category, sub) of the catalogue."""
    taste = {}
    for category in sorted({c for c, _ in kinds}):
        subs = sorted({k for c, k in kinds if c == category})
        for sub, liked in zip(subs, rng.uniform(0, s.dull, len(subs)), strict=True):
            taste[category, sub] = float(liked)
        for sub, liked in zip(rng.permutation(subs)[: len(s.favourites)], s.favourites, strict=False):
            taste[category, str(sub)] = liked
    return taste


def begin(kinds: list[tuple[str, str]], n: int, seed: int, s: Settings) -> tuple[np.random.Generator, dict[tuple[str, str], float], int]:
    """(random numbers, the user's tastes, the place of the start among n places in order of id)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    taste = _tastes(kinds, rng, s)
    return rng, taste, int(rng.integers(n))


@dataclass
class _Walker:
    """Where a walk stands between turns."""

    policy: str
    seed: int
    rng: np.random.Generator
    taste: dict[tuple[str, str], float]
    lat: float
    lon: float
    learner: _Learner = field(default_factory=_Learner)
    visited: set = field(default_factory=set)

    def turn(self, catalogue: _Catalogue, turn: int, category: str, s: Settings) -> tuple:
        """One turn; catalogue: places in order of id, all of them or those of the category within the widest radius."""
        km = catalogue.km(self.lat, self.lon)
        fits = (catalogue.category == category) & ~np.isin(catalogue.id, list(self.visited))
        radius = next((r for r in s.radii if (fits & (km <= r)).sum() >= s.shown), s.radii[-1])
        pool = np.flatnonzero(fits & (km <= radius))
        short = len(pool) < s.shown
        noise = self.rng.normal(0, s.noise, s.shown)
        if not len(pool):
            return (self.policy, self.seed, turn, category, False, None, 0, 0, True)
        if self.policy == "distance":
            order = np.lexsort((catalogue.id[pool], km[pool]))
        elif self.policy == "random":
            order = self.rng.permutation(len(pool))
        else:
            w = self.learner.reactions / (self.learner.reactions + SETTLING) if self.policy == "learned" else 0.0
            score = (1 - w) * catalogue.popularity[pool] + w * self.learner.content(catalogue.sub[pool]) - DISTANCE_WEIGHT * km[pool] / radius
            order = np.lexsort((catalogue.id[pool], km[pool], -np.round(score, 3)))
        shown = pool[order[: s.shown]]
        liked = np.array([self.taste[category, x] for x in catalogue.sub[shown]]) + noise[: len(shown)]
        best = int(np.argmax(liked))
        chosen = bool(liked[best] >= s.accept)
        if self.policy == "learned":
            for place, sub in enumerate(catalogue.sub[shown] if chosen else catalogue.sub[shown[:1]]):
                self.learner.react(sub, "select" if chosen and place == best else "skip", place)
        if chosen:
            self.lat, self.lon = float(catalogue.lat[shown[best]]), float(catalogue.lon[shown[best]])
            self.visited.add(catalogue.id[shown[best]])
        return (self.policy, self.seed, turn, category, chosen, best + 1 if chosen else None, len(shown), len(set(catalogue.sub[shown])), short)


def walk(catalogue: _Catalogue, start: tuple[float, float], kinds: list[tuple[str, str]], n: int, policy: str, seed: int, s: Settings) -> list[tuple]:
    """The turns of one user; catalogue: places in order of id, all of them or those that the walk can reach."""
    rng, taste, _ = begin(kinds, n, seed, s)
    walker = _Walker(policy, seed, rng, taste, *start)
    return [walker.turn(catalogue, turn, category, s) for turn, category in enumerate(s.plan)]


def simulate(items: DataFrame, seeds: int, *, policies: tuple[str, ...] = POLICIES, settings: Settings | None = None) -> DataFrame:
    """A row per simulated turn of every (policy, seed); summarise with `evaluation.simulation_summary`."""
    s = settings or Settings()
    columns = ["id", "category", "sub", "lat", "lon", "popularity"]
    placed = numbered(items.select("id", "lat", "lon"), ["id"], "_place")
    n = placed.count()
    kinds = sorted((r["category"], r["sub"]) for r in items.select("category", "sub").distinct().collect())  # a dimension
    if not n:
        return items.sparkSession.createDataFrame([], OUT)

    def starts(parts):
        for part in parts:
            yield pd.DataFrame({"seed": part["id"], "_place": [begin(kinds, n, int(seed), s)[2] for seed in part["id"]]})

    users = items.sparkSession.range(seeds).mapInPandas(starts, "seed long, _place long")
    users = users.join(placed, "_place").select("seed", F.explode(F.array(*map(F.lit, policies))).alias("policy"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), F.lit(None).cast("binary").alias("_walker"))
    placed_items = items.select(*columns, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    within = geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= s.radii[-1] + 1e-6  # the walker measures exactly

    def taken(turn: int, category: str):
        def run(one: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            at, near = one.iloc[0], near.sort_values("id")
            if at["_walker"] is None:
                rng, taste, _ = begin(kinds, n, int(at["seed"]), s)
                walker = _Walker(at["policy"], int(at["seed"]), rng, taste, float(at["l_lat"]), float(at["l_lon"]))
            else:
                walker = pickle.loads(at["_walker"])
            row = walker.turn(_Catalogue(*(near[c].to_numpy() for c in columns)), turn, category, s)
            names = ["policy", "seed", "turn", "category", "chosen", "rank", "shown", "subs", "short", "l_lat", "l_lon", "_walker"]
            return pd.DataFrame([(*row, walker.lat, walker.lon, pickle.dumps(walker))], columns=names).astype({"rank": "Int32"})

        return run

    out = None
    users = checkpointed(users)
    for turn, category in enumerate(s.plan):
        near = within_cells(users.select(F.col("policy").alias("_policy"), F.col("seed").alias("_seed"), "l_lat", "l_lon"), placed_items.where(F.col("category") == category), s.radii[-1] + 0.01).where(within)
        by = users.groupBy("policy", "seed").cogroup(near.select("_policy", "_seed", *columns).groupBy("_policy", "_seed"))
        users = checkpointed(by.applyInPandas(taken(turn, category), OUT + ", l_lat double, l_lon double, _walker binary"))
        out = users if out is None else out.unionByName(users)
    return out.drop("l_lat", "l_lon", "_walker")
