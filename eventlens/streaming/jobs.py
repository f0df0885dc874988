"""Structured Streaming twins of ingest, state, expiry, staleness and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventlens.schemas import RAW_DOCUMENT


def stream_raw_documents(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW_DOCUMENT).option("maxFilesPerTrigger", per_trigger).parquet(path)


def start_ingest_stream(docs: DataFrame, checkpoint: str, persist: Callable[[DataFrame, int], None], available_now: bool = True):
    """foreachBatch over raw documents; the checkpoint is the cursor, and persist must be idempotent per batch id."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(persist)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedupe_stream(df: DataFrame, clock: str, delay: str, keys: tuple = ("source_id", "provider_record_id", "payload_hash")) -> DataFrame:
    """The first row of each payload key within the watermark."""
    return df.withWatermark(clock, delay).dropDuplicatesWithinWatermark(list(keys))


def new_rows(batch: DataFrame, existing: DataFrame, keys: tuple = ("source_id", "provider_record_id", "payload_hash")) -> DataFrame:
    """Inside foreachBatch: rows that the table lacks."""
    return batch.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


class LatestState(StatefulProcessor):
    """Keeps the greatest (clock, payload) of a key; every row comes out, with whether it is promoted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rank", "clock timestamp, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        data = pd.concat(list(rows)).sort_values(["clock", "payload"])
        best = self.state.get()
        out = []
        for r in data.itertuples():
            rank = (pd.Timestamp(r.clock), r.payload)
            promoted = best is None or rank >= (pd.Timestamp(best[0]), best[1])
            if promoted:
                best = (r.clock.to_pydatetime(), r.payload)
            out.append((key[0], r.clock, r.payload, promoted))
        self.state.update(best)
        yield pd.DataFrame(out, columns=["key", "clock", "payload", "promoted"])

    def close(self) -> None:
        pass


def latest_state_stream(df: DataFrame) -> DataFrame:
    """key, clock, payload in; promoted tells late, older versions, which stay evidence."""
    return df.groupBy("key").transformWithStateInPandas(LatestState(), "key string, clock timestamp, payload string, promoted boolean", "Append", "none")


class HighWater(StatefulProcessor):
    """Rejects snapshots of a source whose clock is behind the mark, or equal with other content."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mark", "clock timestamp, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark, out = self.state.get(), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            clock = pd.Timestamp(r.clock)
            accepted = mark is None or clock > pd.Timestamp(mark[0]) or (clock == pd.Timestamp(mark[0]) and r.payload == mark[1])
            if accepted:
                mark = (r.clock.to_pydatetime(), r.payload)
            out.append((key[0], r.seq, r.clock, r.payload, accepted))
        if mark is not None:
            self.state.update(mark)
        yield pd.DataFrame(out, columns=["key", "seq", "clock", "payload", "accepted"])

    def close(self) -> None:
        pass


def highwater_stream(df: DataFrame) -> DataFrame:
    return df.groupBy("key").transformWithStateInPandas(HighWater(), "key string, seq long, clock timestamp, payload string, accepted boolean", "Append", "none")


class Expiry(StatefulProcessor):
    """Emits `active` when a validity comes in and `expired` when event time passes its end, without further input."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("end", "valid_to timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = pd.concat(list(rows)).sort_values("clock").iloc[-1]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.state.update((last.valid_to.to_pydatetime(),))
        at = int(last.valid_to.timestamp() * 1000)
        if at > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(at)
            status = "active"
        else:
            status = "expired"
        yield pd.DataFrame({"key": [key[0]], "status": [status], "valid_to": [last.valid_to]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        end = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "status": ["expired"], "valid_to": [pd.Timestamp(end[0]) if end else pd.NaT]})

    def close(self) -> None:
        pass


def expiry_stream(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """key, clock, valid_to in; event-time timers give the expiry. The batch twin is expire_advisories()."""
    return df.withWatermark("clock", delay).groupBy("key").transformWithStateInPandas(Expiry(), "key string, status string, valid_to timestamp", "Append", "eventtime")


class Staleness(StatefulProcessor):
    """Emits `fresh` on a success and `stale` when none follows within the allowed time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        data = pd.concat(list(rows))
        last = data.clock.max()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        due = int((last.timestamp() + 3 * int(data.poll_seconds.iloc[-1]) + 120) * 1000)
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        yield pd.DataFrame({"source_id": [key[0]], "status": ["fresh"], "at": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield pd.DataFrame({"source_id": [key[0]], "status": ["stale"], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def staleness_stream(runs: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """source_id, clock, poll_seconds of successful runs in. The batch twin is source_health()."""
    return runs.withWatermark("clock", delay).groupBy("source_id").transformWithStateInPandas(Staleness(), "source_id string, status string, at timestamp", "Append", "eventtime")


def count_stream(df: DataFrame, clock: str, width: str, slide: str | None = None, delay: str = "1 hour", keys: tuple = ()) -> DataFrame:
    """Tumbling or sliding counts; works on batch frames too, which is its twin."""
    w = F.window(clock, width, slide) if slide else F.window(clock, width)
    out = df.withWatermark(clock, delay).groupBy(w, *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_stream(df: DataFrame, clock: str, gap: str, keys: tuple, delay: str = "1 hour") -> DataFrame:
    out = df.withWatermark(clock, delay).groupBy(F.session_window(clock, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def relate_stream(a: DataFrame, b: DataFrame, seconds: int = 600, km: float = 25.0, delay: str = "1 hour", by: tuple = ()) -> DataFrame:
    """Pairs of two streams close in space and time: a watermarked interval join on cells and time buckets, then the distance.

    A row of the second stream stands in one cell and bucket, one of the first visits those that its limits touch: cells
    are eight limits wide and buckets two, so that state is read for the rows around it alone and held for few copies. With
    `by`, only rows alike in those columns are paired.
    """
    from eventlens.functions.geo import geodesic_km
    from eventlens.operators.geo_joins import Grid

    grid, span = Grid(8 * km), 2 * seconds * 1_000_000
    at = lambda c, shift: F.floor((F.unix_micros(c) + shift * 1_000_000) / span).cast("long")
    left = a.select(F.col("id").alias("a"), F.col("clock").alias("ta"), F.col("lon").alias("xa"), F.col("lat").alias("ya"), *(F.col(c).alias(f"{c}_a") for c in by)).withWatermark("ta", delay)
    left = left.withColumn("cy", F.explode(grid.rows_within(F.col("ya"), km))).withColumn("cx", F.explode(grid.columns_within(F.col("xa"), F.col("ya"), F.col("cy"), km)))
    left = left.withColumn("ca", F.explode(F.sequence(at("ta", -seconds), at("ta", seconds))))
    right = b.select(F.col("id").alias("b"), F.col("clock").alias("tb"), F.col("lon").alias("xb"), F.col("lat").alias("yb"), *(F.col(c).alias(f"{c}_b") for c in by)).withWatermark("tb", delay).withColumn("dy", grid.row(F.col("yb")))
    right = right.withColumn("dx", grid.column(F.col("xb"), F.col("dy"))).withColumn("cb", at("tb", 0))
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    on = (F.col("cx") == F.col("dx")) & (F.col("cy") == F.col("dy")) & (F.col("ca") == F.col("cb")) & (F.col("ta") >= F.col("tb") - gap) & (F.col("ta") <= F.col("tb") + gap)
    for c in by:
        on = on & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    j = left.join(right, on).withColumn("km", geodesic_km(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")))
    return j.where((F.col("km") <= km) & (F.col("a") < F.col("b"))).select("a", "b", "ta", "tb", "km")


def retention_job(tables: dict[str, DataFrame], now) -> dict[str, DataFrame]:
    """The scheduled maintenance batch."""
    from eventlens.operators.identity import apply_retention

    return apply_retention(tables, now)
