"""Streams over events and journals: sessions, generations, latest states, late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, per_trigger: int = 8) -> DataFrame:
    """A file stream of events, their time as a zoned timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after `gap` without events; works on streams (append mode) and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n", "total")


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def latest(journal: DataFrame, component: str, at: str) -> DataFrame:
    """The last event of each component; ties by the whole row."""
    return journal.groupBy(component).agg(F.max(F.struct(at, *(c for c in journal.columns if c not in (component, at)))).alias("last")).select(component, "last.*")


def current_generation(requests: DataFrame, session: str, generation: str) -> DataFrame:
    """Results of each session's newest generation only; older ones are stale. A grouped maximum joined back."""
    newest = requests.groupBy(session).agg(F.max(generation).alias("_newest"))
    return requests.join(newest, session).where(F.col(generation) == F.col("_newest")).drop("_newest")


def guard_generations(requests: DataFrame, idle: str = "3600000") -> DataFrame:
    """(session, generation, accepted): as they arrive, results older than the newest seen are refused; idle sessions are forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else -1
        for f in frames:
            ok = []  # in the order of arrival
            for g in f["generation"]:
                ok.append(bool(g >= newest))
                newest = max(newest, int(g))
            yield pd.DataFrame({"session": key[0], "generation": f["generation"], "accepted": ok})
        state.update((newest,))
        state.setTimeoutDuration(int(idle))

    return requests.groupBy("session").applyInPandasWithState(step, "session long, generation long, accepted boolean", "newest long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def followed_by(first: DataFrame, second: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """(key, first_id, second_id): events of two streams, or tables, with (id, key, ts), the second up to `within` after the first.

    Both streams have watermarks and the times bound each other, so Spark forgets a row once no partner can come any more.
    """
    a, b = (x.withWatermark("ts", late) if x.isStreaming else x for x in (first, second))
    a = a.select(F.col(key).alias("a_key"), F.col("id").alias("first_id"), F.col("ts").alias("a_ts"))
    b = b.select(F.col(key).alias("b_key"), F.col("id").alias("second_id"), F.col("ts").alias("b_ts"))
    pairs = a.join(b, F.expr(f"a_key = b_key and b_ts >= a_ts and b_ts <= a_ts + interval {within}"))
    return pairs.select(F.col("a_key").alias(key), "first_id", "second_id")


def dropped(query) -> int:
    """How many rows a running or ended stream query has left out for being behind its watermark, as far as it reports back."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
