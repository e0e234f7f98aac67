"""Streams whose state ends by timers give what the batch queries give, late rows included."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from locusflow.operators import logs
from locusflow.streaming import expiry, jobs

SCHEMA = "key string, ts timestamp, seq bigint, kind string"
BASE = 1_704_067_200
FAR = 10**7


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Rows of five keys over some hours in six files, up to eight minutes out of order, and one far later that moves the watermark."""
    draw = random.Random(20)
    rows, at = [], 0
    for seq in range(400):
        at += draw.choice([0, 1, 7, 40, 200, 900])
        rows.append((at + draw.randrange(480), {"key": f"k{draw.randrange(5)}", "seq": seq, "kind": draw.choice(["view", "view", "view", "end", "join"] if seq % 3 else ["view"]), "at": at}))
    folder = tmp_path_factory.mktemp("in")
    lines = [json.dumps({"key": r["key"], "seq": r["seq"], "kind": r["kind"], "ts": BASE + r["at"] + r["seq"] % 2 / 2}) for _, r in sorted(rows, key=lambda x: x[0])]
    for n in range(6):
        (folder / f"{n}.json").write_text("\n".join(lines[n * 67 : n * 67 + 67]))
    for n in (6, 7):
        (folder / f"{n}.json").write_text(json.dumps({"key": "last", "seq": n, "kind": "view", "ts": BASE + FAR * n}))
    for n in range(8):  # a stream takes files in the order of their times
        os.utime(folder / f"{n}.json", (BASE + n, BASE + n))
    return str(folder)


def batch(spark, path):
    rows = spark.read.schema("key string, ts double, seq bigint, kind string").json(path)
    return rows.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))).where("key <> 'last'")


def streamed(spark, path, tmp_path, make):
    rows = jobs.log_stream(spark, path, "key string, ts double, seq bigint, kind string")
    rows = rows.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))
    got = []
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs.run_to_end(lambda: make(rows).writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect() if r.key != "last")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    finally:
        if old:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return got


def test_sessions_close(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda rows: expiry.closed_sessions(rows, ends="end", idle_seconds=600, late="10 minutes"))
    table = logs.session_table(batch(spark, events), by="key", ts="ts", tie="seq", ends=F.col("kind") == "end", idle_seconds=600, now=F.timestamp_seconds(F.lit(BASE + FAR)))
    want = [(r["key"], r.b, r.e, r.n, r.closed_by) for r in table.select("key", F.unix_micros("begin").alias("b"), F.unix_micros("end").alias("e"), "n", "closed_by").collect()]
    assert sorted(got) == sorted(want) and {x[4] for x in got} == {"end", "idle"} and len(got) > 50


def test_guests_expire(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda rows: expiry.expired_guests(rows.where("kind <> 'join' OR key IN ('k1', 'k2')"), joined="join", seconds=7_200, late="10 minutes"))
    rows = batch(spark, events).where("kind <> 'join' OR key IN ('k1', 'k2')").orderBy("key", "ts", "seq").collect()
    want = []
    for key in sorted({r["key"] for r in rows}):
        own, joined = [r for r in rows if r["key"] == key], False
        for r, after in zip(own, [*own[1:], None], strict=True):
            joined |= r.kind == "join"
            if not joined and (after is None or (after.ts - r.ts).total_seconds() > 7_200):
                want.append((key, int(r.ts.timestamp() * 1_000_000)))
    assert sorted(got) == sorted(want) and {k for k, _ in got} >= {"k0", "k3", "k4"}
    users = spark.createDataFrame([(k, None, us) for k, us in got], "id string, google_sub string, us bigint").withColumn("last_seen_at", F.timestamp_micros("us"))
    assert logs.expired(users, now=F.timestamp_seconds(F.lit(BASE + FAR)), days=0).count() == len(got)


def test_windows_reset(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda rows: expiry.rate_limited(rows, seconds=600, limit=2, late="10 minutes"))
    table = logs.rate_limited(batch(spark, events), key="key", ts="ts", seconds=600, limit=2, tie="seq")
    want = [(r["key"], r.us, r.seq, r.place, r.allowed) for r in table.select("key", F.unix_micros("ts").alias("us"), "seq", "place", "allowed").collect()]
    assert sorted(got) == sorted(want) and {x[4] for x in got} == {True, False}
