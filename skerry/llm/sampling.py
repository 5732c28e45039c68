"""Bounded samples for fits on the driver: a bounded number of rows, each a bounded window of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of which hashes are told apart: exact in a double.
_RANGE = 1 << 53


def low_rows(rows: DataFrame, sample: int, *by: str) -> DataFrame:
    """``rows(doc_id, ...)`` with a low hash of doc_id: about twice ``sample`` (of each ``by``), all of a smaller table.

    The bound comes from counts, so no task or driver sees ``sample`` rows of every
    partition, as ordering them all would have it; who takes the lowest ``sample`` of
    these takes those of the table, but for one chance in 10**30.
    """
    key = [*by] or [F.lit(1).alias("_all")]
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE)).cast("double") * F.col("_n") <= F.lit(2.0 * sample * _RANGE)
    if by:
        return rows.join(F.broadcast(n), list(by)).where(low).drop("_n")
    return rows.crossJoin(F.broadcast(n.select("_n"))).where(low).drop("_n")  # one row


def window(text: str, key: str, size: int) -> Column:
    """At most ``size`` characters of a text, from a place that ``key`` decides; shorter texts are whole."""
    return F.substring(F.col(text), (F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.length(text) - size + 1)) + 1).cast("int"), F.lit(size))


def held_out(col: str) -> Column:
    """True where crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
