"""Tables written to the shared scratch folder, and joins that broadcast only what was measured."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Estimated bytes of a table that may be broadcast; its size is measured first, and beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder of our own, but only for a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it again: lineage is cut, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillstone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lean_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Keep Arrow batches to Python small for the session, unless its owner has set sizes: executors hold them outside the heap."""
    for name, usual, ours in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", str(64 << 20), str(size))):
        full = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(full).rstrip("bB") == usual:
            spark.conf.set(full, ours)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df, a materialised table, for a broadcast if its measured size is within the limit, else leave it to a merge join."""
    fixed = {f.name for f in df.schema if isinstance(f.dataType, NumericType | BooleanType)}
    kinds = dict(df.dtypes)
    sizes = [F.length(c) if kinds[c] in ("binary", "string") else F.length(F.col(c).cast("string")) for c in df.columns if c not in fixed]
    text = sum((F.coalesce(F.sum(x), F.lit(0)) for x in sizes), F.lit(0))
    rows, letters = df.agg(F.count(F.lit(1)), text).first()
    return F.broadcast(df) if rows * (24 + 8 * len(df.columns)) + letters <= limit else df.hint("merge")
