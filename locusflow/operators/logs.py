"""Behaviour logs: outcomes of exposures, quotas, windows, retention and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE = "array<struct<rank:int,place_id:string,slot:string,score:double,pop:double,taste:double,dist_m:int>>"
OUTCOMES = {"select": "selected", "save": "saved", "skip": "skipped", "card_open": "opened"}


def outcomes(turns: DataFrame, reactions: DataFrame, *, schema: str = CANDIDATE, kinds: dict[str, str] | None = None) -> DataFrame:
    """A row per shown candidate with whether each kind of reaction followed; turns: a row a turn.

    Reactions are reduced to a row per (turn, place) before the join, so a place with very many costs
    one row a task. Equal candidates of one turn collapse; without reactions every flag is false.
    """
    kinds = kinds or OUTCOMES
    shown = turns.withColumn("c", F.explode(F.array_distinct(F.from_json("candidates", schema)))).drop("candidates").select("*", "c.*").drop("c")
    flags = reactions.where(F.col("turn_id").isNotNull()).groupBy("turn_id", "place_id").agg(*(F.bool_or(F.col("type") == k).alias(v) for k, v in kinds.items()))
    joined = shown.join(flags, ["turn_id", "place_id"], "left")
    return joined.withColumns({v: F.coalesce(v, F.lit(False)) for v in kinds.values()})


def daily_usage(events: DataFrame, *, user: str, ts: str, limit: int, budget: int | None = None, zone: str | None = None) -> DataFrame:
    """(user, day, n, day_total, over_limit, over_budget): uses a day; refused ones count too."""
    at = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts)) if zone else F.col(ts)
    counts = events.groupBy(user, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    total = counts.groupBy("day").agg(F.sum("n").alias("day_total"))
    out = counts.join(total, "day")
    return out.withColumns({"over_limit": F.col("n") > limit, "over_budget": F.col("day_total") > budget if budget else F.lit(False)})


def rate_limited(events: DataFrame, *, key: str, ts: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """Events with their place in a fixed window of the key, and whether it is allowed."""
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
    order = Window.partitionBy(key, "_w").orderBy(ts, tie)
    return events.withColumn("_w", bucket).withColumn("place", F.row_number().over(order)).withColumn("allowed", F.col("place") <= limit).drop("_w")


def last_of(rows: DataFrame, *, by: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group, `place` counted from the oldest of them.

    order: newest first, total.
    """
    newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n)
    return newest.withColumn("place", F.count("*").over(Window.partitionBy(by)) - F.col("_n") + 1).drop("_n")


def transitions(rows: DataFrame, *, by: str, order: list[str], value: str) -> DataFrame:
    """(before, after, n): how often one value follows another within a group."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNotNull()).groupBy(F.col("_before").alias("before"), F.col(value).alias("after")).agg(F.count("*").alias("n"))


def sessions(rows: DataFrame, *, by: str, order: list[str], ends: Column) -> DataFrame:
    """`session` numbers from 0: an end event closes its session, the next event opens one."""
    past = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("session", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(past), F.lit(0)))


def session_table(rows: DataFrame, *, by: str, ts: str, tie: str, ends: Column, idle_seconds: int, now: Column | None = None) -> DataFrame:
    """(by, session, begin, end, n, closed_by): sessions that an end event closes, or so long without an event; the last one stays open until `now` says that."""
    order = Window.partitionBy(by).orderBy(ts, tie)
    long = lambda a, b: F.unix_micros(b) - F.unix_micros(a) > idle_seconds * 1_000_000
    at = F.col(ts).cast("timestamp")
    marked = rows.withColumns({"_at": at, "_ends": F.coalesce(ends, F.lit(False))}).withColumns({"_before": F.lag("_at").over(order), "_ended": F.lag("_ends").over(order)})
    opens = F.col("_before").isNull() | F.col("_ended") | long(F.col("_before"), F.col("_at"))
    numbered = marked.withColumn("session", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    whole = numbered.groupBy(by, "session").agg(F.min("_at").alias("begin"), F.max("_at").alias("end"), F.count("*").alias("n"), F.bool_or("_ends").alias("_ends"))
    later = F.lead("session").over(Window.partitionBy(by).orderBy("session")).isNotNull()
    idle = later | (long(F.col("end"), now) if now is not None else F.lit(False))
    return whole.withColumn("closed_by", F.when(F.col("_ends"), "end").when(idle, "idle")).select(by, "session", "begin", "end", "n", "closed_by")


def visits(rows: DataFrame, *, by: str, order: list[str], place: str) -> DataFrame:
    """The rows with `added`, the place where its owner hadn't been before (null where nothing is added), and `n_before`, how many places those were.

    A row's list of visited places is what the rows before it added; as changes it takes a value a row, not a list a row.
    """
    first = F.row_number().over(Window.partitionBy(by, place).orderBy(*order)) == 1
    marked = rows.withColumn("added", F.when(F.col(place).isNotNull() & first, F.col(place)))
    past = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("n_before", F.coalesce(F.count("added").over(past), F.lit(0).cast("bigint")))


def visited(rows: DataFrame, *, by: str, order: list[str], place: str) -> DataFrame:
    """The rows with `visited`, the places of their owner's rows before them, each once and sorted; a null in the order comes last."""
    past = Window.partitionBy(by).orderBy(*(F.asc_nulls_last(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("visited", F.array_sort(F.collect_set(place).over(past)))


def expired(users: DataFrame, *, now: Column, days: int = 30) -> DataFrame:
    """Guests that weren't seen for so many days."""
    return users.where(F.col("google_sub").isNull() & (F.col("last_seen_at") < now - F.expr(f"interval {days} days")))


def forget(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after deletion of users (id, actor): their rows go, logs stay without text and exact place."""
    ids, actors = gone.select(F.col("id").alias("user_id")), gone.select("actor")
    out = dict(tables)
    out["users"] = tables["users"].join(ids.withColumnRenamed("user_id", "id"), "id", "left_anti")
    for name in ("profiles", "messages", "spots", "visits", "saved", "user_feedback", "usage_daily"):
        if name in tables:
            out[name] = tables[name].join(ids, "user_id", "left_anti")
    marked = actors.distinct().withColumn("_gone", F.lit(True))
    if "turn_logs" in tables:
        blurred = F.when(F.col("context.area_geo").isNotNull(), F.col("context").withField("area_geo", F.left(F.col("context.area_geo"), F.lit(4)))).otherwise(F.col("context"))
        rows = tables["turn_logs"].join(marked, "actor", "left")
        out["turn_logs"] = rows.withColumns({"query": F.when(F.col("_gone").isNull(), F.col("query")), "context": F.when(F.col("_gone"), blurred).otherwise(F.col("context"))}).drop("_gone")
    if "trips" in tables:
        rows = tables["trips"].join(marked, "actor", "left")
        if "trip_state" in tables:
            out["trip_state"] = tables["trip_state"].join(rows.where("_gone").select(F.col("id").alias("trip_id")), "trip_id", "left_anti")
        out["trips"] = rows.withColumn("start_label", F.when(F.col("_gone").isNull(), F.col("start_label"))).drop("_gone")
    return out


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(*, violated): rows that break a check; a null check passes, as in SQL."""
    broken = F.array_compact(F.array(*(F.when(~c, name) for name, c in checks.items())))
    return rows.withColumn("violated", broken).where(F.size("violated") > 0)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key by seq; changes win over the table on ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "_new")).alias("_r"))
    return newest.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*table.columns)


def counted_up(counts: DataFrame, events: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Counters after more events: an event adds one to its key's counter, or opens it."""
    more = events.groupBy(*keys).agg(F.count("*").alias(n))
    return counts.select(*keys, n).unionByName(more).groupBy(*keys).agg(F.sum(n).alias(n))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def page_after(rows: DataFrame, first: str, second: str, at: tuple, n: int, before: Column | None = None) -> DataFrame:
    """The next n rows after a position in (first, second) order, none younger than `before`."""
    a, b = F.lit(at[0]), F.lit(at[1])
    later = rows.where((F.col(first) > a) | ((F.col(first) == a) & (F.col(second) > b)))
    if before is not None:
        later = later.where(F.col(first) < before)
    return later.orderBy(first, second).limit(n)


def looked_up(rows: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Rows to insert with a value that the database looks up by key; rows whose key is unknown aren't inserted."""
    return rows.join(dim.select(key, value), key)


def unreferenced(rows: DataFrame, gone: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows with a reference set to null where what it points at was deleted."""
    marked = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marked, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*rows.columns)


def saved_places(saved: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Saved entries with their places; entries whose place left the catalogue drop out."""
    return saved.join(items.select(F.col("id").alias("place_id"), *columns), "place_id")


def accepted_props(props: Column, most: int = 1000) -> Column:
    """Properties of an event as JSON, null where that is too long."""
    text = F.to_json(props)
    return F.when(F.length(text) <= most, text)


def json_line(rows: DataFrame) -> Column:
    """The columns as one JSON object: times in ISO form with their zone, parts of a second where there are any, decimals as numbers, nulls kept."""

    def plain(f) -> Column:
        x, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            at = x.cast("timestamp_ntz") if kind == "timestamp_ntz" else F.convert_timezone(F.current_timezone(), F.lit("UTC"), x.cast("timestamp_ntz"))
            whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(at, "SSSSSS")
            zone = F.lit("+00:00" if kind == "timestamp" else "")
            return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), zone).alias(f.name)
        if kind == "decimal":
            return x.cast("double").alias(f.name)
        return x.alias(f.name)

    return F.to_json(F.struct(*(plain(f) for f in rows.schema.fields)), {"ignoreNullFields": "false"})


def stored_profile(session: Column, *, device: Column, places: int = 2, without: tuple[str, ...] = ("candidates",)) -> Column:
    """A session as it is kept: without passing fields, a device's position only coarsely."""
    kept = session.dropFields(*without) if without else session
    return F.when(device, kept.withField("lat", F.round(kept["lat"], places)).withField("lon", F.round(kept["lon"], places))).otherwise(kept)


def month_before(day: Column) -> Column:
    return F.date_format(F.add_months(day, -1), "yyyy-MM")


def stamped(rows: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Rows with the versions of what made them, as one struct."""
    return rows.withColumn("versions", F.struct(*(F.lit(v).alias(k) for k, v in versions.items())))


def without_actors(rows: DataFrame, actors: DataFrame, actor: str = "actor") -> DataFrame:
    """Rows of a log but those of some actors; rows without an actor stay."""
    return rows.join(actors.select(F.col("actor").alias("_a")).distinct(), F.col(actor) == F.col("_a"), "left_anti")


def picked(shown: Column, number: Column) -> Column:
    """The entry of a shown list by its number from 1; null beyond it."""
    return F.when(number > 0, F.try_element_at(shown, number))
