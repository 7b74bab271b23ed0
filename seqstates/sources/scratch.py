"""Written intermediate tables.

A table that several branches of a job read is written once to the folder the
cluster shares (`spark.checkpoint.dir`) and read back.  A lost executor then
costs a re-read, never a second pass over the raw rows, and values that depend
on the physical layout (see `series.range_index`) stay fixed.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 8 << 20  # as written
SALTS = 64

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that driver and executors share.

    `spark.checkpoint.dir`, else the checkpoint directory of the context, else a folder
    of this application in the warehouse, which is on the session's file system.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the intermediate tables."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_at_exit)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and return the table read back.

    Version 2 pages delta-encode the running ids and counts these tables hold.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.writer.version", "v2").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned, once all that is derived from them is written."""
    for table in tables:
        _written.remove((table.sparkSession, table._scratch_path))
        _delete(table.sparkSession, table._scratch_path)


def sized_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    *,
    salt: str | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join of many rows with a lookup table that has unique keys; `how` is inner or left.

    The lookup is written, which also measures it.  Up to `max_broadcast_rows` and
    `MAX_BROADCAST_BYTES` it is broadcast.  A larger one is joined by key; with `salt`, an integer column of the
    rows, it is repeated so that a key that holds a large part of them is joined by
    many tasks.
    """
    lookup = materialize(lookup, "lookup")
    if _written_bytes() <= MAX_BROADCAST_BYTES and lookup.count() <= max_broadcast_rows:
        return rows.join(F.broadcast(lookup), keys, how)
    if salt is None:
        return rows.join(lookup, keys, how)
    repeated = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.expr(f"CAST(pmod({salt}, {SALTS}) AS INT)"))
    return salted.join(repeated, [*keys, "salt"], how).drop("salt")


def drop_materialized(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables written by `materialize` in this process; return how many.

    `since` is a former `written_count`: only what was written after it goes.
    """
    dropped = 0
    while len(_written) > since:
        dropped += _delete(spark, _written.pop()[1])
    return dropped


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def _written_bytes() -> int:
    """Size of the table written last."""
    spark, name = _written[-1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def written_count() -> int:
    return len(_written)


def _drop_at_exit() -> None:
    """Best effort: the session may be gone already."""
    try:
        if _written and _written[-1][0].sparkContext._jsc is not None:
            drop_materialized(_written[-1][0])
    except Exception:  # noqa: BLE001  the interpreter is ending
        pass
