"""Rate windows, cooldowns and counts, as batch operators and as Structured Streaming with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE_LIMIT = 10
COOLDOWN_HOURS = 6


def minute_counts(events: DataFrame, key: str, ts: str = "ts", minutes: int = 1) -> DataFrame:
    """Events of each key in each tumbling window (batch or stream)."""
    return events.groupBy(F.col(key), F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(key, F.col("w.start").alias("window_start"), "requests")


def over_limit(counts: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """Windows whose requests exceed the limit, with the number rejected."""
    return counts.where(F.col("requests") > limit).withColumn("rejected", F.col("requests") - limit)


def admitted(events: DataFrame, key: str, ts: str = "ts", id_col: str = "event_id", limit: int = RATE_LIMIT) -> DataFrame:
    """Every event with its place in its minute and whether the limit lets it in."""
    w = Window.partitionBy(key, F.date_trunc("minute", ts)).orderBy(ts, id_col)
    return events.withColumn("place", F.row_number().over(w)).withColumn("admitted", F.col("place") <= limit)


def sliding_counts(events: DataFrame, key: str, ts: str, size: str, step: str) -> DataFrame:
    return events.groupBy(F.col(key), F.window(ts, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of events without a gap of that length; a session ends at its last event."""
    return events.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("session_end")).select(key, F.col("w.start").alias("session_start"), "session_end", "n")


def cooldown(events: DataFrame, keys: list[str], ts: str = "ts", id_col: str = "event_id", hours: float = COOLDOWN_HOURS) -> DataFrame:
    """Events that are written: the first of a key, then each one at least `hours` after the last written one.

    Whether an event is written depends on the last written one, so this is a fold in order of time. Rows arrive sorted by
    key and time in partitions that hold whole keys, and the fold keeps one timestamp, however many events a key has.
    """
    names = events.columns
    limit = pd.Timedelta(hours=hours)
    ordered = events.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, ts, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            keep = []
            for row in zip(*(pdf[k] for k in keys), pdf[ts], strict=True):
                if row[:-1] != key:
                    key, last = row[:-1], None
                hit = last is None or row[-1] - last >= limit
                if hit:
                    last = row[-1]
                keep.append(hit)
            yield pdf[keep]

    return ordered.mapInPandas(run, events.schema).select(*names)


def occurrences(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """How often each key occurred, first and last."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"), F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"))


def merge_occurrences(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(fresh).groupBy(*keys).agg(F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def evict(table: DataFrame, ts: str, watermark: Column) -> DataFrame:
    return table.where(F.col(ts) >= watermark)


# ---------------------------------------------------------------- Structured Streaming


def stream_minute_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", minutes: int = 1) -> DataFrame:
    """minute_counts() on a stream: a window is final once the watermark passes its end; later rows are left out."""
    return minute_counts(events.withWatermark(ts, late), key, ts, minutes)


def stream_cooldown(events: DataFrame, key: str, ts: str = "ts", hours: float = COOLDOWN_HOURS, late: str = "10 minutes") -> DataFrame:
    """cooldown() on a stream, one timestamp of state a key: (key, written_at). Within a batch, rows go in order of time."""
    limit = pd.Timedelta(hours=hours)
    kind = dict(events.dtypes)[key]

    def step(key_, pdfs, state):
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = sorted(t for pdf in pdfs for t in pdf[ts])
        out = []
        for t in rows:
            if last is None or t - last >= limit:
                last = t
                out.append(t)
        state.update((int(last.value // 1000),))
        yield pd.DataFrame({key: [key_[0]] * len(out), "written_at": pd.Series(out, dtype="datetime64[ns]")})

    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, written_at timestamp", "last long", "append", "NoTimeout")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, in micro-batches, to Parquet; the next call goes on from the checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
