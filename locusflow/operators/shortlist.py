"""Who can be on a user's list: of all places in reach, the few that the exact ranking has to see.

Users and places meet in groups by cell, so many users a task at most; numpy reckons scores a little roughly and
keeps whatever the rounding, or a distance at the very edge, could still bring onto the list. Only these
rows are shuffled and ranked, so the pairs of users and places in reach are never written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geo
from .ranking import DISTANCE_WEIGHT, SHOWN

#: Users of a task at a time.
USERS = 1024
#: Kilometres, and points of score, by which the rough figures may be off; scores are rounded to three places.
OFF_KM, OFF, ROUNDED = 1e-6, 3e-6, 0.001


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.array([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def _picked(users: pd.DataFrame, places: pd.DataFrame, km: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of users, places of places) of the rows that can be among n - 1 by score, or the best to explore."""
    places = places.reset_index(drop=True)
    codes, kinds = pd.factorize(places["sub"], use_na_sentinel=False)
    chance, pop = places["_chance"].to_numpy(), places["popularity"].to_numpy(dtype=float)
    luck = np.empty(len(places), dtype=np.int64)
    luck[places.assign(_turned=-chance).sort_values(["_turned", "id"]).index.to_numpy()] = np.arange(len(places))
    by_luck = np.argsort(luck)
    up = np.argsort(places["r_lat"].to_numpy(), kind="stable")
    lat, codes, pop, luck = places["r_lat"].to_numpy()[up], codes[up], pop[up], luck[up]
    at, here = _unit(lat, places["r_lon"].to_numpy()[up]), _unit(users["l_lat"].to_numpy(), users["l_lon"].to_numpy())
    reach = np.degrees((km + 2 * OFF_KM) / geo.EARTH_KM) * (1 + 1e-9)
    low = np.searchsorted(lat, users["l_lat"].to_numpy() - reach, "left")
    high = np.searchsorted(lat, users["l_lat"].to_numpy() + reach, "right")
    out_u, out_p = [], []
    for u, (subs, tastes, w) in enumerate(zip(users["_subs"], users["_tastes"], users["w"], strict=True)):
        part = slice(low[u], high[u])
        away = at[:, part] - here[:, u : u + 1]
        far = 2 * geo.EARTH_KM * np.arcsin(np.minimum(np.sqrt((away * away).sum(0)) / 2, 1.0))
        near = np.flatnonzero(far <= km + OFF_KM)
        if not len(near):
            continue
        far, near = far[near], near + low[u]
        known = dict(zip(subs, tastes, strict=True)) if subs is not None else {}
        taste = np.array([known.get(k, 0.5) for k in kinds])
        score = (1 - w) * pop[near] + w * taste[codes[near]] - DISTANCE_WEIGHT * far / km
        sure = far <= km - OFF_KM
        held = score[sure & ~np.isnan(score)]
        least = np.partition(held, len(held) - (n - 1))[len(held) - (n - 1)] if len(held) >= n - 1 else -np.inf
        keep = ~(score < least - ROUNDED - OFF)
        rest = sure & ~keep
        best = np.full(len(kinds), len(pop))
        np.minimum.at(best, codes[near[rest]], luck[near[rest]])
        mine = np.concatenate([up[near[keep | ~sure]], by_luck[best[best < len(pop)]]])
        out_p.append(mine)
        out_u.append(np.full(len(mine), u))
    empty = [np.empty(0, dtype=np.int64)]
    return np.concatenate(out_u or empty), np.concatenate(out_p or empty)


def contenders(users: DataFrame, places: DataFrame, *, user: str, km: float, chance, n: int = SHOWN) -> DataFrame:
    """users with the places within km of each that `ranking.top_list` can put on its list of n, and a few more.

    users: user, l_lat, l_lon, w, _subs, _tastes (the content of a sub, 0.5 where it isn't named); places: id, sub,
    popularity, r_lat, r_lon; chance: an integer column of theirs, the exploring order within a kind. Distances
    aren't tested to the last digit: rows a millimetre beyond km may be among them.
    """
    cell = users.withColumn("_c", geo.near_cell(F.col("l_lat"), F.col("l_lon"), km))
    parts = cell.groupBy("_c").agg(F.ceil(F.count("*") / USERS).cast("int").alias("_parts"))
    left = cell.join(parts, "_c").withColumn("_part", F.pmod(F.xxhash64(user), F.col("_parts")).cast("int")).drop("_parts")
    spread = places.withColumn("_chance", chance).withColumn("_c", F.explode(geo.near_cells(F.col("r_lat"), F.col("r_lon"), km)))
    right = spread.join(parts, "_c").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    own, theirs = [c for c in users.columns if c not in ("_subs", "_tastes")], places.columns

    def pick(some: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        u, p = _picked(some, near, km, n)
        return pd.concat([some[own].iloc[u].reset_index(drop=True), near[theirs].iloc[p].reset_index(drop=True)], axis=1)

    schema = StructType([*(users.schema[c] for c in own), *(places.schema[c] for c in theirs)])
    right = right.select(F.col("_c").alias("_d"), F.col("_part").alias("_q"), "_chance", *theirs)
    return left.groupBy("_c", "_part").cogroup(right.groupBy("_d", "_q")).applyInPandas(pick, schema)
