"""The operation log: inserts and deletes, folded to the live rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, DELETE = "I", "D"
FRAGMENT_ROWS = 4096


def fold(ops: DataFrame, keys: tuple[str, ...] = ("id",), after: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Live rows of ``ops(seq, op, keys, payload...)``: the first insert after the last delete wins.

    A repeated insert and the delete of a missing key change nothing.  ``after``
    leaves out what a snapshot holds; ``known`` (by the first key) leaves out other
    collections.  Two partial aggregates and no window, so a key with many
    operations is no hot task.
    """
    if after is not None:
        ops = ops.where(F.col("seq") > after)
    if known is not None:
        ops = ops.join(known, keys[0], "left_semi")
    payload = [c for c in ops.columns if c not in ("seq", "op", *keys)]
    last = ops.where(F.col("op") == DELETE).groupBy(*keys).agg(F.max("seq").alias("_last"))
    inserts = ops.where(F.col("op") == INSERT).join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col("seq") > F.col("_last")))
    row = F.struct("seq", *payload)
    return inserts.groupBy(*keys).agg(F.min_by(row, F.col("seq")).alias("_r")).select(*keys, "_r.*")


def fold_on_snapshot(snapshot: DataFrame, ops: DataFrame, snapshot_seq: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Live rows of a snapshot (rows as ``fold`` gives them) and the operations after it."""
    as_ops = snapshot.withColumn("op", F.lit(INSERT)).select(*ops.columns)
    return fold(as_ops.unionByName(ops.where(F.col("seq") > snapshot_seq)), keys)


def since(ops: DataFrame, seq: int) -> DataFrame:
    return ops.where(F.col("seq") > seq)


def truncated(ops: DataFrame, after: int) -> bool:
    """True if operations after ``after`` are gone: the log begins later than the next one."""
    first = ops.agg(F.min("seq")).first()[0]
    return first is not None and first > after + 1


def max_seq(ops: DataFrame) -> DataFrame:
    return ops.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("max_seq"))


def bucket(seq: Column) -> Column:
    """First seq of the log's folder that holds ``seq``."""
    return (F.floor(seq / FRAGMENT_ROWS) * FRAGMENT_ROWS).cast("long")


def append(ops: DataFrame, path: str) -> None:
    """Write operations into folders by seq, so a read since a seq skips older ones."""
    ops.withColumn("bucket", bucket(F.col("seq"))).write.mode("append").partitionBy("bucket").parquet(path)


def read_since(spark, path: str, seq: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("bucket") >= seq - seq % FRAGMENT_ROWS) & (F.col("seq") > seq)).drop("bucket")
