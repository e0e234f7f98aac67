"""Behaviour-log, profile and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import logs, profile
from .registry import query, table
from .tables import EVENTS_SQL, events

_TURNS = """shown AS (SELECT 't' || l_orderkey AS turn_id, CAST(l_linenumber AS INT) AS rank, 'p' || l_partkey AS place_id, round(l_discount * 10, 1) AS score FROM lineitem),
reacted AS (SELECT 't' || (event_id % 1500) AS turn_id, 'p' || (event_id % 200) AS place_id, CASE event_type WHEN 'purchase' THEN 'select' WHEN 'signup' THEN 'save' WHEN 'error' THEN 'skip' ELSE 'card_open' END AS type FROM events
 UNION ALL SELECT 't' || l_orderkey, 'p' || l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'select' ELSE 'card_open' END FROM lineitem WHERE l_linenumber < 4 AND l_orderkey % 3 = 0)"""


@query(f"""WITH {_TURNS} SELECT s.turn_id, s.rank, s.place_id, s.score, coalesce(bool_or(type = 'select'), false) AS selected, coalesce(bool_or(type = 'save'), false) AS saved,
 coalesce(bool_or(type = 'skip'), false) AS skipped, coalesce(bool_or(type = 'card_open'), false) AS opened FROM (SELECT DISTINCT * FROM shown) s LEFT JOIN reacted r USING (turn_id, place_id) GROUP BY ALL""")
def candidate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown candidates as JSON arrays of a turn, and what users did with them."""
    li = table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_linenumber").cast("int").alias("rank"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("place_id"), F.round(F.col("l_discount") * 10, 1).alias("score"))
    turns = li.groupBy(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("turn_id")).agg(F.to_json(F.collect_list(one)).alias("candidates"))
    kind = F.col("event_type")
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), (F.col("event_id") % 1500).cast("string")).alias("turn_id"), F.concat(F.lit("p"), (F.col("event_id") % 200).cast("string")).alias("place_id"),
        F.when(kind == "purchase", "select").when(kind == "signup", "save").when(kind == "error", "skip").otherwise("card_open").alias("type"),
    )
    more = li.where("l_linenumber < 4 and l_orderkey % 3 = 0").select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("turn_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("place_id"), F.when(F.col("l_linenumber") % 2 == 0, "select").otherwise("card_open").alias("type"))
    return logs.outcomes(turns, ev.unionByName(more), schema="array<struct<rank:int,place_id:string,score:double>>")


@query("""WITH c AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS day_total, n > 3 AS over_limit, sum(n) OVER (PARTITION BY day) > 330 AS over_budget FROM c""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.daily_usage(table(spark, sf_dir, "events"), user="user_id", ts="ts", limit=3, budget=330).withColumn("day", F.col("day").cast("string"))


@query("""SELECT user_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL""")
def daily_usage_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.daily_usage(table(spark, sf_dir, "events"), user="user_id", ts="ts", limit=3, zone="Asia/Tokyo").select("user_id", F.col("day").cast("string").alias("day"), "n")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS place, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rate_limited(table(spark, sf_dir, "events"), key="event_type", ts="ts", seconds=3600, limit=2, tie="event_id").select("event_id", F.col("place").cast("long").alias("place"), "allowed")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS of FROM conversations)
SELECT conv_id, turn, role, least(of, 6) - back + 1 AS place FROM k WHERE back <= 6""")
def last_six_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return logs.last_of(rows, by="conv_id", order=[F.desc("turn")], n=6).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations")
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("turn_no"))


@query("""WITH l AS (SELECT event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, after, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL""")
def category_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.transitions(table(spark, sf_dir, "events"), by="user_id", order=["ts", "event_id"], value="event_type")


@query("""SELECT event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM events""")
def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.sessions(table(spark, sf_dir, "events"), by="user_id", order=["ts", "event_id"], ends=F.col("event_type") == "purchase")
    return rows.select("event_id", F.col("session").cast("long").alias("session"))


@query("""SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN event_type = 'purchase' THEN CAST(event_id % 97 AS VARCHAR) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), ','), '') AS visited FROM events""")
def visited_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole list of places that each event's user has visited before it."""
    rows = table(spark, sf_dir, "events").withColumn("place", F.when(F.col("event_type") == "purchase", (F.col("event_id") % 97).cast("string")))
    rows = logs.visited(rows, by="user_id", order=["ts", "event_id"], place="place")
    return rows.select("event_id", F.array_join("visited", ",").alias("visited"))


@query("""WITH e AS (SELECT user_id AS actor, ts, event_id, event_type = 'purchase' AS ends, lag(ts) OVER w AS b, lag(event_type = 'purchase') OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum((b IS NULL OR e OR epoch_us(ts) - epoch_us(b) > 86400000000)::INT) OVER (PARTITION BY actor ORDER BY ts, event_id) - 1 AS session FROM e),
g AS (SELECT actor, session, count(*) AS n, bool_or(ends) AS ended FROM n GROUP BY ALL)
SELECT actor, CAST(session AS BIGINT) AS session, n, CASE WHEN ended THEN 'end' WHEN session < max(session) OVER (PARTITION BY actor) THEN 'idle' END AS closed_by FROM g""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that an end event closes, or a day without an event; a stream closes them by timers (`streaming.expiry`)."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("actor"), "ts", "event_id", "event_type")
    found = logs.session_table(rows, by="actor", ts="ts", tie="event_id", ends=F.col("event_type") == "purchase", idle_seconds=86_400)
    return found.select("actor", F.col("session").cast("long").alias("session"), "n", "closed_by")


@query("""SELECT o_custkey, o_orderkey, CAST(floor((epoch(o_orderdate) - epoch(min(o_orderdate) OVER (PARTITION BY o_custkey))) / 86400) + 1 AS BIGINT) AS trip_day FROM orders""")
def trip_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    days = F.floor((F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 86400) + 1
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", days.cast("long").alias("trip_day"))


@query("""WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'g' || c_custkey END AS google_sub, max(o_orderdate) AS last_seen_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT id, last_seen_at FROM u WHERE google_sub IS NULL AND last_seen_at < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY""")
def expired_guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    return logs.expired(users, now=F.lit("2001-01-01").cast("timestamp_ntz")).select("id", "last_seen_at")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_seen_at"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("g"), F.col("c_custkey").cast("string"))).alias("google_sub"), (F.col("c_custkey") * 7).alias("actor"))
    return rows.join(seen, "id", "left")


@query("""WITH g AS (SELECT c_custkey AS id, c_custkey * 7 AS actor FROM customer WHERE c_custkey % 10 = 1),
t AS (SELECT event_id AS id, user_id * 7 AS actor, event_type AS query, 'xn76ur' AS area FROM events)
SELECT 'users' AS what, count(*) AS n, CAST(NULL AS VARCHAR) AS area FROM customer WHERE c_custkey NOT IN (SELECT id FROM g)
UNION ALL SELECT 'orders', count(*), NULL FROM orders WHERE o_custkey NOT IN (SELECT id FROM g)
UNION ALL SELECT 'queries left', count(*), max(area) FROM t WHERE actor NOT IN (SELECT actor FROM g)
UNION ALL SELECT 'queries gone', count(*), max(left(area, 4)) FROM t WHERE actor IN (SELECT actor FROM g)""")
def forgotten_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion: rows of users go, their logs stay without text and with a coarser place."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7).alias("actor"))
    turns = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 7).alias("actor"), F.col("event_type").alias("query"), F.struct(F.lit("xn76ur").alias("area_geo")).alias("context"))
    spots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    out = logs.forget({"users": users, "turn_logs": turns, "spots": spots}, users.where("id % 10 = 1"))
    count = lambda name, rows, area: rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"), area.alias("area"))
    none = F.lit(None).cast("string")
    parts = [count("users", out["users"], none), count("orders", out["spots"], none), count("queries left", out["turn_logs"].where("query is not null"), F.max("context.area_geo")), count("queries gone", out["turn_logs"].where("query is null"), F.max("context.area_geo"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT o_orderkey, list_filter([CASE WHEN NOT (o_totalprice BETWEEN 1000 AND 400000) THEN 'price' END, CASE WHEN NOT (o_orderstatus IN ('F', 'O')) THEN 'status' END], lambda x: x IS NOT NULL) AS violated FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('F', 'O'))")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return logs.violations(rows, {"price": F.col("o_totalprice").between(1000, 400000), "status": F.col("o_orderstatus").isin("F", "O")}).select("o_orderkey", "violated")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL HAVING count(*) > 1")
def several_open_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("WITH a AS (SELECT user_id AS id, event_id AS seq, value, 0 AS new FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, value + 1, 1 FROM events WHERE event_id % 3 = 0) SELECT id, max(seq) AS seq, arg_max(value, seq * 2 + new) AS value FROM a GROUP BY id")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    old = ev.where("event_id % 2 = 0").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value")
    new = ev.where("event_id % 3 = 0").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("value") + 1).alias("value"))
    return logs.upsert(old, new, ["id"], "seq")


@query("SELECT c_custkey AS id, c_mktsegment AS kind FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'order' FROM orders WHERE o_custkey % 2 = 1")
def inserted_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return logs.insert_absent(have, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("order").alias("kind")), ["id"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-03-01', 500) AND o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    before = F.lit("2000-01-01").cast("timestamp_ntz")
    return logs.page_after(rows, "o_orderdate", "o_orderkey", (datetime(1997, 3, 1), 500), 50, before)


@query("SELECT count(*) AS pending FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-03-01', 500) AND o_orderdate < TIMESTAMP '2001-07-01' - INTERVAL 120 SECOND")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = (F.col("o_orderdate") > F.lit("1997-03-01").cast("timestamp_ntz")) | ((F.col("o_orderdate") == F.lit("1997-03-01").cast("timestamp_ntz")) & (F.col("o_orderkey") > 500))
    cut = F.lit("2001-07-01").cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(120))
    return table(spark, sf_dir, "orders").where(after & (F.col("o_orderdate") < cut)).agg(F.count("*").alias("pending"))


_DOM = f"{EVENTS_SQL}, c AS (SELECT actor, CASE WHEN k % 10 < 7 THEN 'a' ELSE 'b' || (k % 3) END AS v, count(*) AS n FROM ev WHERE type = 'select' GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY actor) AS whole, row_number() OVER (PARTITION BY actor ORDER BY n DESC, v) AS place FROM c)"


@query(f"WITH {_DOM} SELECT actor, CASE WHEN whole >= 3 AND n / whole >= 0.6 THEN v END AS v, n, CAST(whole AS BIGINT) AS of FROM k WHERE place = 1")
def dominant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("k") % 10 < 7, "a").otherwise(F.concat(F.lit("b"), (F.col("k") % 3).cast("string")))
    return profile.dominant(events(spark, sf_dir).where("type = 'select'").withColumn("v", v), "actor", "v")


@query(f"WITH {EVENTS_SQL} SELECT actor, CASE WHEN count(*) >= 10 THEN round(median(value), 4) END AS value FROM ev WHERE type = 'save' GROUP BY actor")
def usual_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.usual_distance(events(spark, sf_dir).where("type = 'save'"), "actor", "value", least=10).select("actor", F.round("value", 4).alias("value"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT *, coalesce(sum((type = 'select')::INT) OVER (PARTITION BY actor ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM ev),
closed AS (SELECT DISTINCT actor, segment FROM s WHERE type = 'select'), l AS (SELECT *, row_number() OVER (PARTITION BY actor, segment ORDER BY ts DESC, event_id DESC) AS back FROM s WHERE type <> 'select')
SELECT actor, CAST(segment AS BIGINT) AS segment, event_id, k FROM l JOIN closed USING (actor, segment) WHERE back = 1""")
def confirmed_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last intent before each choice is the one that counts."""
    rows = profile.confirmed(events(spark, sf_dir), order=["ts", "event_id"], chosen=F.col("type") == "select")
    return rows.select("actor", F.col("segment").cast("long").alias("segment"), "event_id", "k")


@query()
def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after the whole log; tested against the stream and a plain loop."""
    from ..streaming.jobs import profiles_of

    return profiles_of(profile_events(events(spark, sf_dir)))


def profile_events(ev: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "select", "choose").when(F.col("type") == "view", "intend").otherwise("say")
    none = F.lit(None).cast("string")
    return ev.select(
        "actor", "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "say", "local").alias("trait"), F.when(kind == "say", "true").alias("value"),
        F.when((kind == "intend") & (F.col("k") % 2 == 0), "bar").alias("next_category"), F.when((kind == "intend") & (F.col("k") % 3 == 0), F.round(F.col("value") / 10, 1).cast("string")).alias("max_distance_km"),
        F.when((kind == "intend") & (F.col("k") % 5 == 0), "true").otherwise(none).alias("local"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("item"), F.when(F.col("k") % 2 == 0, "meal").otherwise("sight").alias("category"), "sub",
    ).withColumn("actor", F.col("actor").cast("string"))


@query("""SELECT c_custkey AS id, c_name AS name, n_name AS place, r_name AS region, count(o_orderkey) AS trips FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def profile_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins over dimensions; counts are made before the join."""
    trips = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("trips"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.join(trips, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("place"), F.col("r_name").alias("region"), F.coalesce("trips", F.lit(0)).alias("trips"))


@query("SELECT event_type, date_trunc('hour', ts) AS begin, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.jobs import window_counts

    return window_counts(table(spark, sf_dir, "events"), key="event_type", ts="ts", width="1 hour").select("event_type", F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


_AT = "o_orderdate + to_microseconds(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000000 ELSE 0 END)"


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_AT} AS t, CASE WHEN o_orderkey % 4 > 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100000 AS DOUBLE) / 100 END AS price, o_orderpriority AS level FROM orders)
SELECT id, '{{"id":' || id || ',"at":"' || strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(t) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '","price":' || coalesce(CAST(price AS VARCHAR), 'null') || ',"level":"' || level || '"}}' AS line FROM r""")
def json_lines_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON lines: times in ISO form, decimals as numbers, nulls kept."""
    micros = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 1_000_000).otherwise(0)
    at = (F.col("o_orderdate") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))).cast("timestamp_ntz")
    price = F.when(F.col("o_orderkey") % 4 > 0, (F.round(F.col("o_totalprice") * 100).cast("bigint") % 100_000 / 100).cast("decimal(10,2)"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at.alias("at"), price.alias("price"), F.col("o_orderpriority").alias("level"))
    return rows.select("id", logs.json_line(rows).alias("line"))
