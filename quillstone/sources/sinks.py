"""Sinks. Parquet has no row updates, so upserts and deletes rewrite a table: written beside it, then swapped in as a new version."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import constraints as C
from quillstone.operators import relational as R

log = logging.getLogger("quillstone")


class Table:
    """A Parquet table in versions: `<path>/v=<n>` folders, the largest complete one is current. A rewrite never touches what readers read."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int | None:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return None
        found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path(self.path)) if s.getPath().getName().startswith("v=") and fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        return max(found, default=None)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}")

    def rewrite(self, df: DataFrame, keep: int = 2) -> int:
        """Write the next version; older ones than the last `keep` go."""
        before = self.version()
        v = 0 if before is None else before + 1
        df.select(*self.read().columns).write.parquet(f"{self.path}/v={v}")
        fs, path = self._fs()
        for old in range(max(0, v - keep - 8), v - keep + 1):
            fs.delete(path(f"{self.path}/v={old}"), True)
        return v

    def append(self, rows: DataFrame) -> int:
        return self.rewrite(self.read().unionByName(rows))

    def insert_if_absent(self, rows: DataFrame, key: str | Sequence[str]) -> int:
        return self.rewrite(R.insert_if_absent(self.read(), rows, key))

    def upsert(self, rows: DataFrame, key: str | Sequence[str], *order: Column) -> int:
        return self.rewrite(R.upsert(self.read(), rows, key, *order))

    def compare_and_set(self, wanted: DataFrame, key: str, column: str, expected: str, to: str) -> DataFrame:
        """Rows that moved to the new state. One writer at a time: the new version is all or nothing."""
        table, moved = R.compare_and_set(self.read(), wanted, key, column, expected, to)
        self.rewrite(table)
        return moved

    def retain(self, ts: str, now: Column, hours: int) -> int:
        return self.rewrite(R.retain(self.read(), ts, now, hours))

    def add_embeddings(self, vectors: DataFrame, key: str = "id", column: str = "embedding") -> int:
        """Set vectors by key; null vectors change nothing."""
        out = R.update_from(self.read(), vectors.where(F.col(column).isNotNull()), key, [column])
        return self.rewrite(out.drop("changed"))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def checked_write(df: DataFrame, path: str, **violations: DataFrame) -> None:
    """Write only if no rule is broken."""
    C.require_none(**violations)
    df.write.mode("overwrite").parquet(path)


def write_results(df: DataFrame, folder: str, run: str | None = None) -> str:
    """Results of a run as JSON lines, in a folder of the run's own: rewriting one run leaves the others alone."""
    path = f"{folder.rstrip('/')}/run={run or uuid.uuid4().hex}"
    df.write.mode("overwrite").json(path)
    return path


def bump_counts(table: DataFrame, events: DataFrame, keys: Sequence[str], count: str = "request_count") -> DataFrame:
    """The table's counts with the events' added."""
    fresh = events.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return table.select(*keys, count).unionByName(fresh).groupBy(*keys).agg(F.sum(count).alias(count))


def event(level: str, where: str, message: str, **meta) -> None:
    """One structured line."""
    log.log(getattr(logging, level.upper(), logging.INFO), json.dumps({"level": level, "fn": where, "msg": message, **meta}, default=str, sort_keys=True))


# Statuses of error codes.
STATUS = {"BAD_REQUEST": 400, "UNAUTHORIZED": 401, "FORBIDDEN": 403, "NOT_FOUND": 404, "METHOD_NOT_ALLOWED": 405, "CONFLICT": 409, "RATE_LIMITED": 429, "INTERNAL": 500, "UPSTREAM": 502, "TIMEOUT": 504}


def ok(data) -> tuple[int, dict]:
    return 200, {"ok": True, "data": data}


def failed(code: str, message: str, status: int | None = None) -> tuple[int, dict]:
    return status or STATUS.get(code, 500), {"ok": False, "error": {"code": code, "message": message}}


def config(df: DataFrame) -> dict[str, str]:
    """A key-value table as a dict; it is configuration, so it is small."""
    return {r["key"]: r["value"] for r in df.select("key", "value").collect()}
