"""Structured Streaming: history features with keyed state, ratings by micro-batch, resumable file ingest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyard.operators import ratings as R
from tallyard.sources.shipping import ship
from tallyard.sources.storage import workspace

OUT = "user_id long, event_id long, n_before long, rolling5 double, rolling30 double, value_delta double"
KEPT = 30


#: Groups that users are dealt to by a hash; a checkpoint holds for one number of them.
BUCKETS = 256


def advance(users: dict[str, np.ndarray], ready: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """What is known of users after the events of ready, and each event's features from its user's events before it.

    users: user_id, n, newest_us and last, a row of KEPT values a user, NaN where there are none. A value that is missing
    counts as an event, and not in a mean. All users take their steps at once.
    """
    order = np.lexsort((ready["value"], ready["event_id"], ready["us"], ready["user_id"]))
    ready = {c: v[order] for c, v in ready.items()}
    who, first, count = np.unique(ready["user_id"], return_index=True, return_counts=True)
    n, last, known = np.zeros(len(who), np.int64), np.full((len(who), KEPT), np.nan), np.isin(who, users["user_id"])
    at = np.searchsorted(users["user_id"], who[known])
    n[known], last[known] = users["n"][at], users["last"][at]
    # Each user's last values, then the new ones.
    of = np.repeat(np.arange(len(who)), count)
    here = np.arange(len(of)) + KEPT * (of + 1)
    every = np.full(len(of) + KEPT * len(who), np.nan)
    every[here] = ready["value"]
    every[(first + KEPT * np.arange(len(who)))[:, None] + np.arange(KEPT)] = last
    total, values, means = np.zeros(len(of)), np.zeros(len(of)), {}
    for k in range(1, KEPT + 1):
        x = every[here - k]
        total, values = total + np.where(np.isnan(x), 0.0, x), values + ~np.isnan(x)
        if k in (5, KEPT):
            means[k] = np.divide(total, values, out=np.full(len(of), np.nan), where=values > 0)
    delta = ready["value"] - every[here - 1]
    out = {"user_id": ready["user_id"], "event_id": ready["event_id"], "n_before": n[of] + np.arange(len(of)) - first[of], "rolling5": means[5], "rolling30": means[KEPT], "value_delta": np.where(np.isnan(delta), 0.0, delta)}
    end = first + count
    now = {"user_id": who, "n": n + count, "newest_us": ready["us"][end - 1], "last": every[(end + KEPT * np.arange(len(who)))[:, None] + np.arange(KEPT)]}
    rest = ~np.isin(users["user_id"], who)
    now = {c: np.concatenate([users[c][rest], now[c]]) for c in now}
    order = np.argsort(now["user_id"])
    return {c: v[order] for c, v in now.items()}, out


EVENT = {"user_id": np.int64, "us": np.int64, "event_id": np.int64, "value": np.float64}
USER = {"user_id": np.int64, "n": np.int64, "newest_us": np.int64, "last": np.float64}


class History(StatefulProcessor):
    """Snapshot, then advance, for a bucket of users in event time. State, each column as its bytes: users with a count and
    their last KEPT values, and events that wait until the watermark has passed them, as earlier ones may still come. A
    call of the state costs the same for one user as for many, so a bucket asks for all of its own at once."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getValueState("users", ", ".join(f"{c} binary" for c in USER))
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} binary" for c in EVENT))
        self.due = handle.getValueState("due", "ms long")

    def wake(self, ms: int) -> None:
        """The bucket's one timer."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for frame in rows:
            # What has been passed was settled without it.
            frame = frame[frame["us"] > passed] if passed else frame
            if len(frame):
                self.waiting.appendValue(tuple(frame[c].to_numpy(t).tobytes() for c, t in EVENT.items()))
                first = min(x for x in (first, int(frame["us"].min())) if x is not None)
        if first is not None:
            self.wake(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        chunks = list(self.waiting.get()) if self.waiting.exists() else []
        events = {c: np.frombuffer(b"".join(x[k] for x in chunks), t) for k, (c, t) in enumerate(EVENT.items())}
        users = {c: np.frombuffer(x, t) for x, (c, t) in zip(self.users.get() if self.users.exists() else [b""] * len(USER), USER.items(), strict=True)}
        users["last"] = users["last"].reshape(-1, KEPT)
        ready, later = ({c: v[at] for c, v in events.items()} for at in (events["us"] < passed, events["us"] >= passed))
        out = None
        if len(ready["us"]):
            settled = ready["user_id"]
            users, out = advance(users, ready)
            if len(later["us"]):
                self.waiting.put([tuple(v.tobytes() for v in later.values())])
            else:
                self.waiting.clear()
        else:
            settled = events["user_id"][:0]
        if len(later["us"]):
            self.wake(int(later["us"].min()) // 1000 + 1)
        forgotten = False
        if self.idle_ms is not None:
            idle = ~np.isin(users["user_id"], later["user_id"])
            gone = idle & ~np.isin(users["user_id"], settled) & (users["newest_us"] + self.idle_ms * 1000 <= passed)
            forgotten = bool(gone.any())
            until = np.maximum(users["newest_us"] // 1000 + self.idle_ms, passed // 1000 + 1)[idle & ~gone]
            users = {c: v[~gone] for c, v in users.items()}
            if len(until):
                self.wake(int(until.min()))
        if not len(users["user_id"]):
            self.users.clear()
        elif out is not None or forgotten:
            self.users.update(tuple(v.tobytes() for v in users.values()))
        if out is not None:
            yield pd.DataFrame(out if not key[1] else out | {"user_id": pd.array([None] * len(out["user_id"]), "Int64")})

    def close(self) -> None:
        pass


#: The state store that keyed state of several kinds needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The user of the event that ends a stream.
NOBODY = -1


def stream_history(events: DataFrame, lateness: str = "1 hour", idle_days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Features of each user's events from those before them, in the order of (ts, event_id).

    An event comes out when the watermark has passed it, so one that is late, but not by more than lateness, still takes
    its place; one that is later is dropped. At the end of a finite stream the last ones wait until a later event (of any
    user, see `closing`) moves the watermark. With idle_days, a user without events for so long is forgotten and starts
    anew; without it every user's count and last values stay. A task holds one bucket's users, about 270 bytes each, and
    its events that wait, which lateness and the source's options bound; more buckets make both smaller.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.withWatermark("ts", lateness)
    user = F.col("user_id")
    dealt = marked.select("ts", F.coalesce(user, F.lit(0)).cast("long").alias("user_id"), F.unix_micros("ts").alias("us"), "event_id", "value", F.pmod(F.xxhash64(user), F.lit(buckets)).alias("bucket"), user.isNull().alias("nobody"))
    return dealt.groupBy("bucket", "nobody").transformWithStateInPandas(History(None if idle_days is None else idle_days * 86_400_000), OUT, "Append", "EventTime")


def closing(events: DataFrame, after: str = "2 hours") -> DataFrame:
    """One event of nobody, so much after all of events, and with their columns: it lets what waits come out."""
    end = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")).withColumn("user_id", F.lit(NOBODY))
    return end.select(*[F.col(f.name).cast(f.dataType) if f.name in end.columns else F.lit(0).cast(f.dataType).alias(f.name) for f in events.schema])


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there to a Parquet table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


#: Batches after which changes are merged.
MERGE = 8


def rating_state(spark: SparkSession, folder: str, upto: int) -> DataFrame | None:
    """participant, rating as batches up to and with `upto` left them: the last merged state and the changes since."""
    merged = (upto + 1) // MERGE * MERGE - 1
    paths = [f"{folder}/merged-{merged}"] * (merged >= 0) + [f"{folder}/change-{n}" for n in range(merged + 1, upto + 1)]
    if not paths:
        return None
    every = spark.read.schema("participant long, rating double, batch long").parquet(*paths)
    return every.groupBy("participant").agg(F.max_by("rating", "batch").alias("rating"))


def stream_ratings(entries: DataFrame, folder: str, checkpoint: str, **options) -> None:
    """Every micro-batch is one rating period.

    A batch asks for the states of its own participants, and leaves a change file with theirs alone; each MERGE batches
    changes are merged into a state of all. Files bear the batch's number and are made from earlier ones only, so a batch
    that is run again leaves the same.
    """
    spark = entries.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        state = rating_state(spark, folder, number - 1)
        if state is not None:
            state = state.join(batch.select("participant").distinct(), "participant", "left_semi")
        history = R.pairwise_elo(batch, F.lit(number), state=state, **options)
        change = history.select(F.col("participant").cast("long").alias("participant"), F.col("rating_after").alias("rating"), F.lit(number).cast("long").alias("batch"))
        change.write.mode("overwrite").parquet(f"{folder}/change-{number}")
        if (number + 1) % MERGE == 0:
            before = [f"{folder}/merged-{number - MERGE}"] * (number >= MERGE) + [f"{folder}/change-{n}" for n in range(number - MERGE + 1, number + 1)]
            every = spark.read.schema(change.schema).parquet(*before).groupBy("participant").agg(F.max_by("rating", "batch").alias("rating"), F.max("batch").alias("batch"))
            every.write.mode("overwrite").parquet(f"{folder}/merged-{number}")

    entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_ingest(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str) -> DataFrame:
    """New CSV files of a folder, appended to a Parquet table; the checkpoint remembers which were read."""
    run_to_end(spark.readStream.schema(schema).option("header", True).csv(source), path, checkpoint)
    return spark.read.parquet(path)


def arrivals(df: DataFrame, key: str, tag: str) -> tuple[str, Iterator[None]]:
    """A folder, and an iterator that lets the files of one value of key after the other into it, in ascending order.

    All files are written in one pass over df; a value's files then arrive together, by a rename.
    """
    spark, staged, folder = df.sparkSession, workspace(df.sparkSession, f"{tag}-staged"), workspace(df.sparkSession, tag)
    df.withColumn("_arrival", F.col(key)).write.partitionBy("_arrival").parquet(staged)
    values = sorted(r[0] for r in df.select(key).distinct().collect())  # one row an arrival
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))

    def arrive() -> Iterator[None]:
        for v in values:
            fs.rename(path(f"{staged}/_arrival={v}"), path(f"{folder}/{v}"))
            yield

    return folder, arrive()
