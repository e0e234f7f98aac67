"""Finding places by name: start points, stations by an inverted index of their names, then places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .name_index import NameIndex, holding
from .resolve import greedy_independent, within_cells

SAME_STATION_KM = 2.0
FOUND = ["source", "name", "sub", "kind", "lat", "lon"]


def station_key(s: Column, *, done: bool = False) -> Column:
    """A name without case, punctuation and a closing word for station."""
    return F.regexp_replace(text.bare(text.folded(s, done)), "(역|駅|station)$", "")


def station_key_of(s: str | None) -> str:
    """The same of one query."""
    out = text.norm_of(s)
    return next((out[: -len(w)] for w in ("역", "駅", "station") if out.endswith(w)), out)


def station_index(stations: DataFrame, *, done: bool = False) -> DataFrame:
    """(key, id, name, sub, lat, lon, seq): a row for each distinct key of a station's names.

    stations: id, names MAP, operator, lat, lon, seq. The name shown is the Korean one where there is one.
    """
    ko, plain = F.try_element_at("names", F.lit("name:ko")), F.try_element_at("names", F.lit("name"))
    rows = stations.select("id", F.coalesce(ko, plain).alias("name"), F.when(ko.isNotNull(), plain).otherwise(F.coalesce("operator", F.lit(""))).alias("sub"), "lat", "lon", "seq", F.explode(F.map_values("names")).alias("word"))
    return rows.withColumn("key", station_key(F.col("word"), done=done)).drop("word").where("key <> ''").distinct()


def _ranked_stations(index: DataFrame | NameIndex, k: str) -> DataFrame:
    """(id, name, sub, lat, lon, order): stations whose key holds k, the exact key first, then those it begins, then short ones."""
    rank = F.struct((F.col("key") != k).alias("a"), (~F.startswith("key", F.lit(k))).alias("b"), F.length("key").alias("c"), F.col("key").alias("d"), F.col("seq").alias("e"), F.col("id").alias("f"))
    hits = holding(index, "key", k).withColumn("order", rank)
    return hits.groupBy("id").agg(F.min("order").alias("order"), *(F.min_by(c, "order").alias(c) for c in ("name", "sub", "lat", "lon")))


def matching_stations(index: DataFrame | NameIndex, k: str) -> DataFrame:
    """All stations whose key holds k, in rounds over those in conflict: of one shown name within two kilometres the first in order stays."""
    hits = _ranked_stations(index, k)
    left = hits.select(F.col("id").alias("a"), F.col("name").alias("l_name"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    right = hits.select(F.col("id").alias("b"), F.col("name").alias("r_name"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) < SAME_STATION_KM
    pairs = within_cells(left, right, SAME_STATION_KM).where((F.col("a") < F.col("b")) & (F.col("l_name") == F.col("r_name")) & near).select("a", "b")
    kept = greedy_independent(hits.select("id", F.col("order").alias("rank")), pairs).where("kept").select("id")
    return hits.join(kept, "id", "left_semi")


def first_stations(index: DataFrame | NameIndex, k: str, limit: int) -> DataFrame:
    """The first `limit` rows of `matching_stations`, decided in order over as many hits as that takes.

    The first hits, a few times the limit, are one sorted list in which a station stays unless one of its shown name
    stands before it within two kilometres; only where too few stay, more hits are read.
    """
    hits, take = _ranked_stations(index, k), 16 * limit
    while True:
        first = hits.orderBy("order").limit(take).agg(F.array_sort(F.collect_list(F.struct("order", "id", "name", "sub", "lat", "lon"))).alias("all"))
        close = lambda x, h: (x["name"] == h["name"]) & (geo.haversine_km(x["lat"], x["lon"], h["lat"], h["lon"]) < SAME_STATION_KM)
        stay = F.aggregate("all", F.slice("all", 1, 0), lambda kept, h: F.when(F.exists(kept, lambda x: close(x, h)), kept).otherwise(F.concat(kept, F.array(h))))
        got = first.select(F.size("all").alias("n"), F.slice(stay, 1, limit).alias("stay")).first()  # `limit` rows
        if len(got["stay"]) >= limit or got["n"] < take:
            return hits.sparkSession.createDataFrame(got["stay"], first.schema["all"].dataType.elementType)
        take *= 8


def find(q: str, *, starts: DataFrame, index: DataFrame | NameIndex, places: DataFrame | NameIndex, limit: int = 12) -> DataFrame:
    """(place, source, name, sub, kind, lat, lon): start points, then stations, then places by popularity, up to a limit.

    The index and the places may be name indexes (of `key` and `name_key`), which is what a large catalogue needs.
    starts: name, city, code, lat, lon, seq; places: id, name, name_key (all names' keys), name_ja, sub, popularity, lat, lon.
    """
    k = station_key_of(q)
    if not k:
        return starts.limit(0).select(F.lit(0).alias("place"), F.lit("").alias("source"), "name", F.col("city").alias("sub"), F.lit("").alias("kind"), "lat", "lon")
    begins = F.contains(station_key(F.col("name"), done=True), F.lit(k)) | F.contains(station_key(F.col("city"), done=True), F.lit(k)) | (F.lower("code") == k)
    order = lambda *parts: F.struct(*(p.alias(f"o{n}") for n, p in enumerate(parts)))
    zero, none = F.lit(0), F.lit("")
    s = starts.where(begins).select(F.lit("start").alias("source"), "name", F.col("city").alias("sub"), F.lit("airport").alias("kind"), "lat", "lon", order(F.lit(0), F.lit(False), F.lit(False), zero, none, F.col("seq").cast("double"), none).alias("o"))
    o = F.col("order")
    t = first_stations(index, k, limit).select(F.lit("station").alias("source"), "name", "sub", F.lit("station").alias("kind"), "lat", "lon", order(F.lit(1), o["a"], o["b"], o["c"], o["d"], o["e"].cast("double"), o["f"].cast("string")).alias("o"))
    p = holding(places, "name_key", k).select(F.lit("place").alias("source"), "name", F.coalesce("name_ja", none).alias("sub"), F.col("sub").alias("kind"), "lat", "lon", order(F.lit(2), F.lit(False), F.lit(False), zero, none, -F.coalesce("popularity", F.lit(0.0)), F.col("id").cast("string")).alias("o"))
    best = s.unionByName(t).unionByName(p).orderBy("o").limit(limit)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct("o", *FOUND))).alias("all"))  # a dozen rows
    return ranked.select(F.posexplode("all").alias("place", "r")).select((F.col("place") + 1).alias("place"), *(F.col(f"r.{c}").alias(c) for c in FOUND))


def geocode(q: str, *, index: DataFrame | NameIndex, places: DataFrame | NameIndex, near: tuple[float, float] | None = None) -> DataFrame:
    """At most one row (name, lat, lon): a station of exactly this key, else a place holding it; the nearest, else the most popular."""
    k = station_key_of(q)
    equal = index.equal(k) if isinstance(index, NameIndex) else index.where(F.col("key") == k)
    stations = equal.select(F.lit(0).alias("rank"), "name", "lat", "lon", F.lit(1.0).alias("popularity"), F.col("id").cast("string").alias("id"))
    held = holding(places, "name_key", k).select(F.lit(1).alias("rank"), "name", "lat", "lon", F.coalesce("popularity", F.lit(0.0)).alias("popularity"), F.col("id").cast("string").alias("id"))
    best = geo.haversine_km(F.lit(near[0]), F.lit(near[1]), F.col("lat"), F.col("lon")) if near else -F.col("popularity")
    return stations.unionByName(held).orderBy("rank", best, "id").limit(1).select("name", "lat", "lon")


def by_name(places: DataFrame | NameIndex, q: str, *, near: tuple[float, float] | None = None, limit: int = 20) -> DataFrame:
    """Places whose names hold a word: nearest first, or the most popular first without a location."""
    hits = holding(places, "name_key", text.norm_of(q))
    first = geo.haversine_km(F.lit(near[0]), F.lit(near[1]), F.col("lat"), F.col("lon")) if near else -F.coalesce("popularity", F.lit(0.0))
    return hits.withColumn("first", first).orderBy("first", "id").limit(limit).drop("first")


def listed(rows: DataFrame, word: str, columns: tuple[str, ...] = ("name", "kind")) -> DataFrame:
    """Rows of a list of which a column holds the word."""
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.contains(c, F.lit(word)), F.lit(False))
    return rows.where(out)
