"""The ingest queue: due rows, claims, transitions, watchdog and retries, as table-to-table operators.

One writer holds the queue, so a claim needs no lock: a batch takes due rows, runs an injected step, and writes the next
version of the queue. foreach_batch() makes the same step a streaming sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.operators import relational as R

MOST_ATTEMPTS = 50
STUCK_MINUTES = 10
STALE_DAYS = 14
SOURCE_INTERVAL_HOURS = 6


def is_due(now: Column, next_attempt: str = "next_attempt_at") -> Column:
    return F.col(next_attempt).isNull() | (F.col(next_attempt) <= now)


def due(queue: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Pending rows that are due, oldest first."""
    rows = queue.where((F.col("status") == "pending") & is_due(now)).orderBy("detected_at", "id")
    return rows.limit(limit) if limit else rows


def claim(queue: DataFrame, now: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(queue with the claimed rows in processing, claimed rows)."""
    table, taken = R.compare_and_set(queue, due(queue, now, limit).select("id"), "id", "status", "pending", "processing")
    started = taken.select("id").withColumn("__t", F.lit(True))
    return table.join(started, "id", "left").withColumn("started_at", F.when(F.col("__t"), now).otherwise(F.col("started_at"))).drop("__t").select(queue.columns), taken


def settle(queue: DataFrame, outcomes: DataFrame, now: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """outcomes (id, outcome: done, skipped, failed or deferred; error) applied to processing rows.

    A failure counts an attempt and waits by the schedule, until `most` attempts make it final; a deferral waits a minute
    and counts none.
    """
    j = queue.join(outcomes.select("id", "outcome", F.col("error").alias("__e")), "id", "left")
    live = F.col("outcome").isNotNull() & (F.col("status") == "processing")
    tries = F.coalesce("attempts", F.lit(0)) + 1
    failing, final = live & (F.col("outcome") == "failed"), tries >= most
    status = F.when(live & F.col("outcome").isin("done", "skipped"), F.col("outcome")).when(failing, F.when(final, "failed").otherwise("pending")).when(live, "pending").otherwise(F.col("status"))
    wait = F.when(failing & ~final, D.next_attempt_at(now, tries)).when(live & (F.col("outcome") == "deferred"), now + F.expr("INTERVAL 1 MINUTE")).when(live, F.lit(None).cast("timestamp")).otherwise(F.col("next_attempt_at"))
    out = j.withColumns({"status": status, "next_attempt_at": wait, "attempts": F.when(failing, tries).otherwise(F.col("attempts")), "last_error": F.when(failing, F.col("__e")).otherwise(F.col("last_error"))})
    return out.select(queue.columns)


def watchdog(queue: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(queue with stuck rows pending again, alerts with the time they got stuck)."""
    stuck = (F.col("status") == "processing") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    alerts = queue.where(stuck).select(F.lit("stuck_ingestion").alias("reason"), F.col("id").alias("alert_key"), F.col("started_at").alias("stuck_since"), now.alias("triggered_at"))
    return queue.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status"))), alerts


def stale_documents(documents: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Current documents that weren't checked for so long (or ever), as alert rows."""
    old = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < now - F.make_dt_interval(F.lit(days)))
    return documents.where((F.col("status") == "current") & old).select(F.lit("stale_document").alias("reason"), F.col("url").alias("alert_key"), now.alias("triggered_at"))


def error_alerts(outcomes: DataFrame, now: Column) -> DataFrame:
    return outcomes.where(F.col("error").isNotNull()).select(F.lit("ingestion_failure").alias("reason"), F.col("id").alias("alert_key"), now.alias("triggered_at")).distinct()


def suppress(alerts: DataFrame, written: DataFrame, hours: float = 6) -> DataFrame:
    """New alerts, one for each reason and key, that no written one of the last `hours` covers."""
    last = written.groupBy("reason", "alert_key").agg(F.max("triggered_at").alias("__last"))
    first = R.latest(alerts, ["reason", "alert_key"], F.col("triggered_at"))
    return first.join(last, ["reason", "alert_key"], "left").where(F.col("__last").isNull() | (F.col("triggered_at").cast("double") - F.col("__last").cast("double") >= hours * 3600)).drop("__last")


def retries(df: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Rows without a vector that are due, longest waiting first."""
    rows = df.where(F.col("embedding").isNull() & is_due(now)).orderBy(F.col("next_attempt_at").asc_nulls_first(), "id")
    return rows.limit(most) if most else rows


def after_embedding(rows: DataFrame, now: Column) -> DataFrame:
    """Bookkeeping after an embedding pass: rows with a vector are done, others wait longer each time."""
    ok, tries = F.col("embedding").isNotNull(), F.coalesce("attempts", F.lit(0)) + 1
    return rows.withColumns({"next_attempt_at": F.when(~ok, D.next_attempt_at(now, tries, D.EMBEDDING_BACKOFF)), "last_error": F.when(~ok, F.coalesce("last_error", F.lit("no vector"))), "attempts": F.when(ok, F.col("attempts")).otherwise(tries)})


def may_check(last_checked: Column, enabled: Column, leased_until: Column, now: Column, hours: int = SOURCE_INTERVAL_HOURS) -> Column:
    return enabled & (leased_until.isNull() | (leased_until < now)) & (last_checked.isNull() | (last_checked <= now - F.make_dt_interval(F.lit(0), F.lit(hours))))


def claim_state(done: Column, leased_until: Column, now: Column) -> Column:
    return F.when(done, "already-complete").when(leased_until > now, "leased").otherwise("claimed")


def new_edition(latest_id: Column, reconciled_id: Column) -> Column:
    return latest_id.isNotNull() & ~latest_id.eqNullSafe(reconciled_id)


def triggers_reconcile(changed: DataFrame, pending: DataFrame, node: str = "node_id") -> bool:
    """Some changed node has a pending change."""
    return bool(changed.select(node).join(pending.where(F.col("codification_status") == "pending").select(node), node, "left_semi").take(1))


def seed_state(state: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    return R.insert_if_absent(state, sources, key)


def run_phases(*phases: tuple[str, Callable[[], object]]) -> dict[str, str | None]:
    """Run every phase, whatever the others do: name -> error or None."""
    out: dict[str, str | None] = {}
    for name, phase in phases:
        try:
            phase()
            out[name] = None
        except Exception as e:  # one phase's failure must not stop the next
            out[name] = f"{type(e).__name__}: {e}"
    return out


def foreach_batch(step: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str) -> None:
    """One step for each micro-batch of what is there now; one query a checkpoint is one writer."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
