"""Versions of records: slowly changing history, resolution of what was in force, and repair."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T


def history(changes: DataFrame, key: str, hash_col: str, date_col: str, tie: str | None = None) -> DataFrame:
    """Full history from changes in any order: a version begins where the hash differs from the one before, and ends at the next.

    Adds superseded_date and is_current. A return to an earlier content is a version of its own.
    """
    order = [F.col(date_col), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(key).orderBy(*order)
    marked = changes.withColumns({"__before": F.lag(hash_col).over(w), "__nth": F.row_number().over(w)})
    changed = marked.where((F.col("__nth") == 1) | ~F.col("__before").eqNullSafe(F.col(hash_col))).drop("__before", "__nth")
    return changed.withColumn("superseded_date", F.lead(date_col).over(w)).withColumn("is_current", F.col("superseded_date").isNull())


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key's changes in order of arrival: a hash seen before is skipped, and so is an older date; else the current version is closed."""
    out, seen, current = [], set(), None
    for row in pdf.sort_values(["arrival"], kind="stable").to_dict("records"):
        if pd.isna(row["hash"]) or row["hash"] in seen:
            continue
        if current is not None and (pd.isna(row["effective_date"]) or (not pd.isna(current["effective_date"]) and row["effective_date"] < current["effective_date"])):
            continue
        seen.add(row["hash"])
        if current is not None:
            current["superseded_date"], current["is_current"] = row["effective_date"], False
        current = {"key": row["key"], "hash": row["hash"], "effective_date": row["effective_date"], "superseded_date": None, "is_current": True, "arrival": row["arrival"]}
        out.append(current)
    return pd.DataFrame(out, columns=["key", "hash", "effective_date", "superseded_date", "is_current", "arrival"])


def history_by_arrival(changes: DataFrame) -> DataFrame:
    """changes (key, hash, effective_date, arrival) folded in order of arrival, one key at a time.

    A key's changes meet in one task: they are the versions of one record. For keys of unbounded history use history().
    """
    schema = ", ".join(f"{c} {dict(changes.dtypes)[t]}" for c, t in (("key", "key"), ("hash", "hash"), ("effective_date", "effective_date"), ("superseded_date", "effective_date"))) + f", is_current boolean, arrival {dict(changes.dtypes)['arrival']}"
    return changes.groupBy("key").applyInPandas(_fold, schema)


def upsert_action(incoming_hash: Column, incoming_date: Column, current_hash: Column, current_date: Column) -> Column:
    """insert (no current version), unchanged (same hash), stale (older or undated) or supersede."""
    return F.when(current_hash.isNull(), "insert").when(incoming_hash == current_hash, "unchanged").when(~supersedes(incoming_date, current_date), "stale").otherwise("supersede")


def supersedes(incoming: Column, incumbent: Column) -> Column:
    """The incoming date is not older; unknown dates don't supersede."""
    return F.coalesce(incoming >= incumbent, F.lit(False))


def upsert_versions(table: DataFrame, incoming: DataFrame, key: str, hash_col: str, date_col: str) -> DataFrame:
    """One batch (a row for each key) merged into a table of versions: close the current one and add the new one, or leave both."""
    cur = table.where("is_current").select(key, F.col(hash_col).alias("__h"), F.col(date_col).alias("__d"))
    known = table.select(key, hash_col).distinct().withColumn("__known", F.lit(True))
    acted = incoming.join(cur, key, "left").join(known, [key, hash_col], "left").withColumn("__a", F.when(F.col("__known"), "unchanged").otherwise(upsert_action(F.col(hash_col), F.col(date_col), F.col("__h"), F.col("__d"))))
    new = acted.where(F.col("__a").isin("insert", "supersede")).select(*incoming.columns, F.lit(None).cast(dict(table.dtypes)["superseded_date"]).alias("superseded_date"), F.lit(True).alias("is_current"))
    closing = acted.where(F.col("__a") == "supersede").select(key, F.col(date_col).alias("__end"))
    kept = table.join(closing, key, "left")
    ends = F.col("is_current") & F.col("__end").isNotNull()
    kept = kept.withColumn("superseded_date", F.when(ends, F.col("__end")).otherwise(F.col("superseded_date"))).withColumn("is_current", F.col("is_current") & ~ends).select(table.columns)
    return kept.unionByName(new.select(table.columns))


def hard_version_filter(candidates: DataFrame, group: Sequence[str], node: str, is_current: str = "is_current", versioned: Column | None = None) -> DataFrame:
    """Without superseded rows that have a current peer of the same node among the candidates; has_history tags nodes that lost a row.

    Rows that `versioned` rules out are left alone, and so are superseded rows without a current peer.
    """
    versioned = F.lit(True) if versioned is None else versioned
    w = Window.partitionBy(*group, node)
    subject = versioned & F.col(node).isNotNull()
    peer = F.max(F.when(subject & F.col(is_current), 1).otherwise(0)).over(w) == 1
    drops = subject & ~F.coalesce(F.col(is_current), F.lit(False)) & peer
    flagged = candidates.withColumn("__drop", drops)
    return flagged.withColumn("has_history", F.max(F.when(F.col("__drop"), 1).otherwise(0)).over(w) == 1).where(~F.col("__drop")).drop("__drop")


def removed_nodes(candidates: DataFrame, node: str, is_current: str = "is_current") -> DataFrame:
    """Nodes that have both current and superseded rows."""
    return candidates.groupBy(node).agg(F.bool_or(is_current).alias("c"), F.bool_or(~F.col(is_current)).alias("o")).where("c AND o").select(node)


def superseded_date_from_peer(df: DataFrame, node: str, is_current: str = "is_current", date_col: str = "effective_date") -> DataFrame:
    """Superseded rows take the current peer's date as their end."""
    peer = F.max(F.when(F.col(is_current), F.col(date_col))).over(Window.partitionBy(node))
    return df.withColumn("superseded_date", F.when(~F.col(is_current), peer))


def stale_current(df: DataFrame, node: str, is_current: str = "is_current", date_col: str = "effective_date") -> DataFrame:
    """Current rows that have a later sibling."""
    later = F.max(date_col).over(Window.partitionBy(node))
    return df.withColumn("__m", later).where(F.col(is_current) & (F.col(date_col) < F.col("__m"))).drop("__m")


def topic_history(crosswalk: DataFrame, texts: DataFrame, topic: str) -> DataFrame:
    """All versions of a topic with their texts, oldest first."""
    return crosswalk.where(F.col("topic") == topic).join(texts, "provision_id").orderBy("effective_date", "provision_id")


def repair_history(df: DataFrame, node: str, hash_col: str, id_col: str, date_col: str = "effective_date") -> tuple[DataFrame, DataFrame]:
    """(repaired rows, mapping of dropped ids to kept ones).

    Of rows with the same node and hash the earliest stays (then current, then the smallest id); the latest version of
    each node is current, and each one ends where the next begins.
    """
    w = Window.partitionBy(node, hash_col).orderBy(F.col(date_col).asc_nulls_last(), F.col("is_current").desc(), id_col)
    marked = df.withColumn("__keeper", F.first(id_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    mapping = marked.where(F.col(id_col) != F.col("__keeper")).select(F.col(id_col).alias("old"), F.col("__keeper").alias("new"))
    kept = marked.where(F.col(id_col) == F.col("__keeper")).drop("__keeper")
    o = Window.partitionBy(node).orderBy(F.col(date_col).asc_nulls_first(), id_col)
    return kept.withColumn("superseded_date", F.lead(date_col).over(o)).withColumn("is_current", F.lead(id_col).over(o).isNull()), mapping


def repair_counts(df: DataFrame, node: str, hash_col: str) -> DataFrame:
    """One row: duplicate groups, their rows and excess, nodes with no current version, nodes with several."""
    groups = df.groupBy(node, hash_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))
    nodes = df.groupBy(node).agg(F.count_if("is_current").alias("c")).agg(F.count_if(F.col("c") == 0).alias("without_current"), F.count_if(F.col("c") > 1).alias("many_current"))
    return groups.join(F.broadcast(nodes))


def assert_counts(df: DataFrame, **expected: int) -> DataFrame:
    """df, if its single row of counts is as expected; else an error before anything is written."""
    row = df.first().asDict()
    wrong = {k: (row.get(k), v) for k, v in expected.items() if row.get(k) != v}
    if wrong:
        raise ValueError("counts differ (found, expected): " + ", ".join(f"{k} {a}, {b}" for k, (a, b) in sorted(wrong.items())))
    return df


def resolve_identity(rows: DataFrame, current: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Historical rows (raw_id, heading, content) matched to current nodes (node_id, heading, content).

    Adds node_id and strategy: the raw id if it is current; else the first current node with the same citation key, if
    the texts are similar enough; else the raw id on its own.
    """
    cur = current.select("node_id", T.citation_key(F.col("heading"), F.col("content")).alias("__key"), F.col("content").alias("__content"))
    firsts = cur.where("__key IS NOT NULL").groupBy("__key").agg(F.min_by(F.struct("node_id", "__content"), "node_id").alias("__s")).select("__key", F.col("__s.node_id").alias("__node"), F.col("__s.__content").alias("__text"))
    own = current.select(F.col("node_id").alias("raw_id")).distinct().withColumn("__own", F.lit(True))
    joined = rows.withColumn("__key", T.citation_key(F.col("heading"), F.col("content"))).join(own, "raw_id", "left").join(firsts, "__key", "left")
    similar = F.coalesce(T.content_similarity(F.col("content"), F.col("__text")) >= threshold, F.lit(False))
    strategy = F.when(F.col("__own"), "raw-current-node").when(F.col("__node").isNotNull() & similar, "citation-current-node").otherwise("historical-node")
    return joined.withColumn("strategy", strategy).withColumn("node_id", F.when(F.col("strategy") == "citation-current-node", F.col("__node")).otherwise(F.col("raw_id"))).withColumnRenamed("__key", "citation_key").select(*rows.columns, "citation_key", "node_id", "strategy")


def orphan_action(has_shell: Column, has_children: Column, complete: Column) -> Column:
    """insert-fresh (no shell), finalize-only (all children there) or rewalk."""
    return F.when(~has_shell, "insert-fresh").when(has_children & complete, "finalize-only").otherwise("rewalk")


def select_jobs(jobs: DataFrame, wanted: Sequence[int], latest_id: str) -> DataFrame:
    """Edition jobs (id, name, online_date) of wanted supplements but the latest, by date and number, each with the next one's date."""
    from quillstone.functions import dates as D

    named = jobs.select(F.col("id").cast("string").alias("job_id"), "name", T.supplement_number(F.col("name")).alias("supplement"), D.normalized_date(F.col("online_date")).alias("online_date"))
    kept = named.where(F.col("supplement").isin(*wanted) & F.col("online_date").isNotNull() & (F.col("job_id") != latest_id)) if wanted else named.where(F.lit(False))
    return kept.withColumn("next_date", F.lead("online_date").over(Window.orderBy("online_date", "supplement", "job_id")))
