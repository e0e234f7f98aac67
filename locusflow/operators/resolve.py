"""Entity resolution: nearest matching rows over cells, and greedy removal of near doubles."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text

#: Pairs that may meet in one go when the nearest is looked for, and how many others a row should meet at first.
LEAST_PAIRS, AIM = 20_000_000, 24


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names; a new one only on local threads, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def within_cells(left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides in cells that hold every pair within km, anywhere on the globe: an equi-join on the cell.

    left: l_lat, l_lon; right: r_lat, r_lon; `on`: columns of both that must be equal, too.
    """
    spread = left.withColumn("_c", F.explode(geo.near_cells(F.col("l_lat"), F.col("l_lon"), km)))
    return spread.join(right.withColumn("_c", geo.near_cell(F.col("r_lat"), F.col("r_lon"), km)), ["_c", *on]).drop("_c")


def near_pairs(left: DataFrame, right: DataFrame, *, size: float, towards_zero: bool = False) -> DataFrame:
    """Rows of both sides in the same or adjoining cells of so many degrees, an equi-join on the cell.

    left: l_lat, l_lon; right: r_lat, r_lon. `ord` is the place of the cell in the 3 x 3 scan. Cells of
    equal degrees are narrow far from the equator: `within_cells` is for distances.
    """
    grid = geo.cell_towards_zero if towards_zero else geo.cell
    spread = left.withColumn("_c", F.explode(geo.neighbours(grid(F.col("l_lat"), size), grid(F.col("l_lon"), size))))
    spread = spread.withColumns({"_i": F.col("_c.i"), "_j": F.col("_c.j"), "ord": F.col("_c.ord")}).drop("_c")
    placed = right.withColumns({"_i": grid(F.col("r_lat"), size), "_j": grid(F.col("r_lon"), size)})
    return spread.join(placed, ["_i", "_j"]).drop("_i", "_j")


def _rungs(left: DataFrame, right: DataFrame, metres: float, on: tuple[str, ...]) -> list[float]:
    """Radii to search one after the other, each four times the one before, the last being `metres`: the least lets a row meet some AIM others.

    What would meet at the widest is counted by cell, without making a pair.
    """
    km = metres / 1000
    spread = left.select("l_id", *on, F.explode(geo.near_cells(F.col("l_lat"), F.col("l_lon"), km)).alias("_c")).groupBy("_c", *on).agg(F.count("*").alias("_n"))
    placed = right.select(*on, geo.near_cell(F.col("r_lat"), F.col("r_lon"), km).alias("_c")).groupBy("_c", *on).agg(F.count("*").alias("_m"))
    met = spread.join(placed, ["_c", *on], "left").agg(F.sum(F.col("_n") * F.coalesce("_m", F.lit(0)).cast("double")).alias("pairs"), (F.sum("_n") / 4).alias("rows")).first()
    out = [metres]
    if met["pairs"] and met["pairs"] > LEAST_PAIRS:
        while met["pairs"] / met["rows"] * (out[0] / metres) ** 2 > 4 * AIM and len(out) < 12:
            out.insert(0, out[0] / 4)
    return out


def nearest_match(left: DataFrame, right: DataFrame, *, metres: float = 100.0, same: Column | None = None, compat: bool = False, names: bool = False) -> DataFrame:
    """For each l_id the nearest r row within `metres` for which `same` holds, with dist_m.

    `compat` takes 0.001 degree cells cut towards zero, which miss some pairs of 91-100 m. Ties: cell order
    there, then r_id. `names`: only rows with a key in r_keys that holds one in l_keys or is held by it; they meet by
    that key. Where many rows lie in reach a small radius is searched first, and only rows that found nothing
    search the next: who finds something within a radius has met all that is as near.
    """
    order = Window.partitionBy("l_id").orderBy("dist_m", "ord", "r_id")

    def nearest(pairs: DataFrame, most: float) -> DataFrame:
        pairs = pairs.withColumn("dist_m", geo.flat_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("dist_m") <= most)
        if same is not None:
            pairs = pairs.where(same)
        return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "ord")

    if compat:
        return nearest(near_pairs(left, right, size=0.001, towards_zero=True), metres)
    on = ("_key",) if names else ()
    if names:
        known = [side.select(F.explode(f"{s}_keys").alias("key")) for s, side in (("l", left), ("r", right))]
        there, back = held_keys(known[0], known[1]), held_keys(known[1], known[0])
        left = with_parts(left, "l_keys", checkpointed(there.unionByName(back.select(F.col("part").alias("key"), F.col("key").alias("part"))).distinct()))
        right = right.withColumn("_key", F.explode(F.array_distinct("r_keys")))
    rungs, out = _rungs(left, right, metres, on), None
    for radius in rungs:
        found = nearest(within_cells(left, right, radius / 1000, on).withColumn("ord", F.lit(0)), radius).drop(*on)
        if radius != rungs[-1]:
            found = checkpointed(found)
            left = left.join(found.select(F.col("l_id").alias("_found")), F.col("l_id").eqNullSafe(F.col("_found")), "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def near_any(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Left rows with a right row in the same or an adjoining cell."""
    cells = right.select(geo.cell(F.col("r_lat"), size).alias("_i"), geo.cell(F.col("r_lon"), size).alias("_j")).distinct()
    spread = left.withColumn("_c", F.explode(geo.neighbours(geo.cell(F.col("l_lat"), size), geo.cell(F.col("l_lon"), size))))
    hit = spread.select("l_id", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j")).join(cells, ["_i", "_j"], "left_semi").select("l_id").distinct()
    return left.join(hit, "l_id", "left_semi")


def mostly_near(left: DataFrame, right: DataFrame, size: float, by: str, share: float = 0.8) -> DataFrame:
    """(by, n, near): groups of left rows of which at least a share has a right row in the same or an adjoining cell."""
    hit = near_any(left, right, size).select("l_id", F.lit(1).alias("_hit"))
    out = left.join(hit, "l_id", "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_hit").alias("near"))
    return out.where(F.col("near") >= share * F.col("n"))


def any_name_same(a: Column, b: Column) -> Column:
    """Whether any of several names is any of the other's; a and b are arrays of `name_keys`."""
    return F.exists(a, lambda x: F.exists(b, lambda y: text.same_name(x, y)))


def all_known_keys(rows: DataFrame, dim: DataFrame, *, key: str, value: str, separator: str = ";") -> DataFrame:
    """(id, key, value) for each element of a `a;b;c` key that the dimension holds."""
    parts = rows.select("id", F.explode(F.array_distinct(F.transform(F.split(key, separator), lambda x: F.trim(x)))).alias(key))
    return parts.join(dim.select(key, value), key).select("id", key, value)


def in_ranges(rows: DataFrame, ranges: DataFrame, value: str, width: int) -> DataFrame:
    """Rows with the columns of the range (lo, hi, ...) that holds a value, nulls where none does; ranges don't overlap.

    Ranges are spread over buckets of a width, so an equi-join finds the few that a value can lie in; a range
    of many buckets costs a row each, so the width should be near the commonest length.
    """
    more = [c for c in ranges.columns if c not in ("lo", "hi")]
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hit = (F.col("_v") == F.col("_b")) & F.col(value).between(F.col("lo"), F.col("hi"))
    return rows.withColumn("_v", F.floor(F.col(value) / width)).join(spread, hit, "left").select(*rows.columns, *more)


def greedy_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept): what a pass in order of rank keeps when a node falls to any kept neighbour before it.

    nodes: id, rank (unique, small is first); edges: a, b (conflicts, either way). Rounds: a node without
    an undecided or kept earlier neighbour is kept, and its later neighbours fall. Few rounds are
    needed on real graphs; only nodes with conflicts take part.
    """
    ranks_a = nodes.select(F.col("id").alias("a"), F.col("rank").alias("ra"))
    ranks_b = nodes.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
    ranked = edges.where("a <> b").join(ranks_a, "a").join(ranks_b, "b")
    first = F.col("ra") < F.col("rb")
    down = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")).distinct()
    left = checkpointed(down)
    decided = None
    while not left.isEmpty():
        late = left.select(F.col("late").alias("early")).distinct()
        roots = left.select("early").distinct().join(late, "early", "left_anti")
        fallen = left.join(roots, "early", "left_semi").select(F.col("late").alias("id")).distinct()
        now = checkpointed(roots.select(F.col("early").alias("id"), F.lit(True).alias("kept")).unionByName(fallen.withColumn("kept", F.lit(False))))
        gone = now.where("not kept").select("id")
        settled = now.where("kept").select("id")
        left = checkpointed(
            left.join(settled.withColumnRenamed("id", "early"), "early", "left_anti")
            .join(gone.withColumnRenamed("id", "early"), "early", "left_anti")
            .join(gone.withColumnRenamed("id", "late"), "late", "left_anti")
        )
        decided = now if decided is None else decided.unionByName(now)
    if decided is None:
        return nodes.select("id", F.lit(True).alias("kept"))
    fell = decided.where("not kept").select("id").distinct()
    return nodes.select("id").join(fell.withColumn("_fell", F.lit(True)), "id", "left").select("id", F.col("_fell").isNull().alias("kept"))


def held_keys(keys: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(key, part): which known keys each key holds, itself among them where it is one; keys, others (parts; else keys): one column key.

    A key's pieces of all lengths meet the distinct parts by equality, so the work grows with the letters of distinct keys.
    """
    whole = keys.select("key").where("key is not null").distinct()
    parts = whole.select(F.col("key").alias("part")) if others is None else others.select(F.col("key").alias("part")).where("key is not null").distinct()
    lengths = lambda i: F.sequence(F.lit(0), F.length("key") - i + 1)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.transform(lengths(i), lambda n: F.substring(F.col("key"), i, n))))
    return whole.select("key", F.explode(F.array_distinct(pieces)).alias("part")).join(parts, "part").select("key", "part")


def with_parts(rows: DataFrame, keys: str, pairs: DataFrame) -> DataFrame:
    """rows once for each part, as `_key`, of any of their keys; pairs: key, part."""
    parts = pairs.groupBy("key").agg(F.collect_list("part").alias("_parts"))
    names = rows.select(keys).distinct().select(keys, F.explode(keys).alias("key")).join(parts, "key")
    held = names.groupBy(keys).agg(F.array_distinct(F.flatten(F.collect_list("_parts"))).alias("_held"))
    return rows.join(held, keys).withColumn("_key", F.explode("_held")).drop("_held")


def near_doubles(items: DataFrame, *, km: float = 0.1, same: Column | None = None, within: str | None = "category") -> DataFrame:
    """(a, b) pairs of items of one kind, within km, of one name; columns id, lat, lon, keys.

    Without a `same` of one's own, items meet by cell and by a key that one's name holds and the other has, so others of
    a cell aren't compared. A pair that meets in several ways counts where the holder's way is the first.
    """
    keep = ["id", "lat", "lon", "keys"] + ([within] if within else [])
    left = items.select(*(F.col(c).alias(f"l_{c}") for c in keep))
    right = items.select(*(F.col(c).alias(f"r_{c}") for c in keep))
    near = geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= km
    if within:
        near &= F.col(f"l_{within}").eqNullSafe(F.col(f"r_{within}"))
    if same is not None:
        pairs = within_cells(left, right, km).where(F.col("l_id") < F.col("r_id"))
        return pairs.where(near & same).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    holder = with_parts(left, "l_keys", held_keys(items.select(F.explode("keys").alias("key"))))
    held = right.withColumn("_key", F.explode(F.array_distinct("r_keys")))
    met = within_cells(holder, held, km, ("_key",)).where((F.col("l_id") != F.col("r_id")) & near)
    parts = lambda a, b: F.filter(b, lambda y: F.exists(a, lambda x: F.contains(x, y)))
    first = F.col("_key") == F.get(parts(F.col("l_keys"), F.col("r_keys")), F.lit(0))
    back = F.size(parts(F.col("r_keys"), F.col("l_keys"))) > 0
    once = met.where(first & ((F.col("l_id") < F.col("r_id")) | ~back))
    return once.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))


def dedupe_nearby(items: DataFrame, *, richness: Column, km: float = 0.1, same: Column | None = None) -> DataFrame:
    """Items without near doubles: the richer one stays (then the smaller id), and takes over the sources.

    `richness`: a number, more is richer after popularity.
    """
    pairs = checkpointed(near_doubles(items, km=km, same=same))
    met = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    nodes = checkpointed(items.withColumn("_rich", richness).join(met, "id", "left_semi").select("id", "popularity", "_rich", "sources", F.struct(-F.col("popularity"), -F.col("_rich"), F.col("id")).alias("rank")))
    kept = greedy_independent(nodes.select("id", "rank"), pairs)
    fell = kept.where("not kept").select("id")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    takers = kept.where("kept").select(F.col("id").alias("b"))
    owner = both.join(fell.withColumnRenamed("id", "a"), "a", "left_semi").join(takers, "b", "left_semi")
    owner = owner.join(nodes.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b").groupBy("a").agg(F.min_by("b", "rb").alias("id"))
    given = owner.join(nodes.select(F.col("id").alias("a"), "sources"), "a").groupBy("id").agg(F.flatten(F.collect_list("sources")).alias("_given"))
    out = items.join(fell, "id", "left_anti").join(given, "id", "left")
    return out.withColumn("sources", F.when(F.col("_given").isNull(), F.col("sources")).otherwise(F.array_sort(F.array_distinct(F.concat("sources", "_given"))))).drop("_given")


def first_known_key(rows: DataFrame, dim: DataFrame, *, key: str, value: str, separator: str = ";") -> DataFrame:
    """rows with `value` of the dimension for the first element of a `a;b;c` key that it holds; others null."""
    parts = rows.select("id", F.posexplode(F.transform(F.split(key, separator), lambda x: F.trim(x))).alias("_pos", "_key"))
    hit = parts.join(dim.select(F.col(key).alias("_key"), F.col(value)), "_key").groupBy("id").agg(F.min_by("_key", "_pos").alias("matched_key"), F.min_by(value, "_pos").alias(value))
    return rows.join(hit, "id", "left")
