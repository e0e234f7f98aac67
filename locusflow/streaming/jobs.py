"""Incremental jobs: dated export with a safety lag, windowed counters, quotas, and profiles as state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.profile import Profile, step
from ..sources.writers import verified_by_day
from . import lease


def log_stream(spark: SparkSession, path: str, schema: str, *, files: int = 1, fmt: str = "json") -> DataFrame:
    """New log files as a stream, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def export_by_day(rows: DataFrame, path: str, checkpoint: str, *, ts: str = "created_at") -> StreamingQuery:
    """Rows into date=.../batch=N folders as gzip JSON lines, each row under its own day, counted again after writing.

    A batch writes the same folders when it runs again, replacing what a broken attempt left, so every row
    is there once. Only one query can own a checkpoint; where the checkpoint is broken the query doesn't start.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def write(batch: DataFrame, number: int) -> None:
        verified_by_day(batch, path, ts, number, schema)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(rows: DataFrame, after: str | None, now: str, *, ts: str = "created_at", lag_seconds: int = 120) -> DataFrame:
    """Rows past the cursor and older than the safety lag: younger ones wait for the next run, none is dropped."""
    cut = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(lag_seconds))
    out = rows.where(F.col(ts) < cut)
    return out.where(F.col(ts) > F.lit(after).cast("timestamp")) if after else out


def export_table(table: DataFrame, path: str, state: str, now: str, *, ts: str = "created_at", key: str = "id", lag_seconds: int = 120, lease_seconds: int = lease.SECONDS) -> int:
    """One run of a cursor export of a table: rows past the last run's cursor and older than the lag, under the next batch number.

    The cursor (ts, key) and the number are a Parquet row in `state`, written to a new folder after the batch is
    there: a run that broke in between writes the same batch again. A broken newest folder falls back to the
    one before it. A run holds the lease on `state`: a second one meanwhile is refused (`LeaseHeldError`), and one that paused
    for longer than `lease_seconds` while another ran doesn't move the cursor. Gives the number of rows.
    """
    with lease.held(table.sparkSession, f"{state.rstrip('/')}/leases", seconds=lease_seconds) as own:
        return _export(table, path, state, now, ts, key, lag_seconds, own)


def _export(table: DataFrame, path: str, state: str, now: str, ts: str, key: str, lag_seconds: int, own: lease.Lease) -> int:
    spark = table.sparkSession
    last = _cursor(spark, state)
    rows = table.where(F.col(ts) < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(lag_seconds)))
    if last is not None:
        at = F.lit(last["ts"]).cast("timestamp")
        rows = rows.where((F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > last["key"])))
    number = 0 if last is None else last["number"] + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    own.renew()
    wrote = verified_by_day(rows, path, ts, number, schema)
    if wrote:
        newest = rows.agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"))).alias("at")).select("at.ts", "at.key", F.lit(number).alias("number"))
        own.renew()
        newest.coalesce(1).write.mode("overwrite").parquet(f"{state}/cursor-{number:012d}")
    return wrote


def _cursor(spark: SparkSession, state: str):
    """The row of the newest whole cursor folder; null on the first run; fails where folders are there and none is whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((n for s in fs.listStatus(folder) if (n := s.getPath().getName()) != "leases"), reverse=True) if fs.exists(folder) else []
    for name in (n for n in names if n.startswith("cursor-")):
        try:
            return spark.read.parquet(f"{state}/{name}").first().asDict()
        except Exception:  # a folder without a whole file: the run that made it broke
            continue
    if names:
        raise OSError(f"no cursor in {state} can be read")
    return None


def window_counts(rows: DataFrame, *, key: str, ts: str, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, begin, n) per fixed window; in a stream the watermark bounds its state."""
    at = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return at.groupBy(key, F.window(ts, width).alias("_w")).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("begin"), "n")


class ProfileProcessor(StatefulProcessor):
    """One profile per actor; events in (ts, seq) order within a batch; out: the profile after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", "doc string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        profile = Profile.load(json.loads(self.state.get()[0])) if self.state.exists() else Profile()
        events = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for event in events.to_dict("records"):
            step(profile, {k: v for k, v in event.items() if not (v is None or v != v)})
        doc = json.dumps(profile.dump(), ensure_ascii=False, sort_keys=True)
        self.state.update((doc,))
        yield pd.DataFrame({"actor": [key[0]], "turn": [profile.turn], "doc": [doc]})

    def close(self) -> None:
        pass


def profiles(events: DataFrame) -> DataFrame:
    """(actor, turn, doc) updates. events: actor, ts, seq, kind, trait, value, next_category, ..., item, category, sub."""
    return events.groupBy("actor").transformWithStateInPandas(statefulProcessor=ProfileProcessor(), outputStructType="actor string, turn int, doc string", outputMode="Update", timeMode="None")


def profiles_of(events: DataFrame) -> DataFrame:
    """The same for a bounded log: one row per actor; an actor's own events are read in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        profile = Profile()
        for event in part.sort_values(["ts", "seq"]).to_dict("records"):
            step(profile, {k: v for k, v in event.items() if not (v is None or v != v)})
        doc = json.dumps(profile.dump(), ensure_ascii=False, sort_keys=True)
        return pd.DataFrame({"actor": [part["actor"].iloc[0]], "turn": [profile.turn], "doc": [doc]})

    return events.groupBy("actor").applyInPandas(run, "actor string, turn int, doc string")


def run_to_end(make: Callable[[], StreamingQuery]) -> None:
    """Starts a query and waits until it has read all that is there."""
    query = make()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
