"""Signs of life and repeated messages over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples kept, samples from which the suspicion level is used, levels of suspect and dead, seconds before that.
SAMPLES, LEAST, SUSPECT, DEAD, SUSPECT_S, DEAD_S = 100, 10, 3.0, 8.0, 5.0, 15.0
#: Seconds from which a gap is a pause (sleep, first sign) and no sample.
PAUSE_S = 300.0


def phi_accrual(beats: DataFrame, now, pause: float = PAUSE_S) -> DataFrame:
    """(node, n, mean, elapsed, phi, state) of ``beats(node, t)``, t in seconds, at time ``now``.

    phi = elapsed / mean gap / ln 10 over the last 100 gaps above 0 and below
    ``pause``; with fewer than 10 of them the state depends on the elapsed seconds
    alone and phi is null.
    """
    order = Window.partitionBy("node").orderBy("t")
    gap = F.col("t") - F.lag("t").over(order)
    gaps = beats.select("node", "t", F.when((gap > 0) & (gap < pause), gap).alias("gap"))
    latest = Window.partitionBy("node").orderBy(F.col("gap").isNull(), F.desc("t"))
    sample = F.when(F.col("_n") <= SAMPLES, F.col("gap"))
    each = gaps.withColumn("_n", F.row_number().over(latest)).groupBy("node").agg(F.count(sample).alias("n"), F.avg(sample).alias("mean"), (F.lit(now) - F.max("t")).alias("elapsed"))
    phi = F.when(F.col("n") >= LEAST, F.col("elapsed") / F.col("mean") / F.log(F.lit(10.0)))
    state = (
        F.when(phi.isNull(), F.when(F.col("elapsed") >= DEAD_S, "dead").when(F.col("elapsed") >= SUSPECT_S, "suspect").otherwise("alive"))
        .when(phi >= DEAD, "dead").when(phi >= SUSPECT, "suspect").otherwise("alive")
    )
    return each.select("node", "n", "mean", "elapsed", phi.alias("phi"), state.alias("state"))


def dedupe_ttl(events: DataFrame, keys: list[str], t: str = "t", ttl: float = 30.0) -> DataFrame:
    """Events of a key that come more than ``ttl`` seconds after the last one let through (what is held back renews nothing).

    Of events at one time the first in order of the other columns counts; events
    without a time are left out.  The rows of a key are read in order of time and
    streamed, so that a key may have any number of them.
    """
    rest = [f.name for f in events.schema.fields if f.name not in (*keys, t) and not f.dataType.simpleString().startswith(("map", "variant"))]
    at, on = events.columns.index(t), [events.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0.0
        for batch in batches:
            times = batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False)
            n = len(times)
            new = np.zeros(n, dtype=bool)  # another key than in the row before
            if n:
                new[0] = tuple(batch.column(i)[0].as_py() for i in on) != key
            for i in on:
                c = batch.column(i)
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            keep = []
            for lo, hi in zip([0, *starts], [*starts, n], strict=True):
                if lo == hi:
                    continue
                x = times[lo:hi]
                i = 0 if new[lo] else int(np.searchsorted(x, last + ttl, side="right"))
                while i < len(x):
                    keep.append(lo + i)
                    last = x[i]
                    i = int(np.searchsorted(x, last + ttl, side="right"))
            if n:
                key = tuple(batch.column(i)[n - 1].as_py() for i in on)
            yield batch.take(pa.array(keep, pa.int64()))

    ordered = events.where(F.col(t).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, t, *rest)
    return ordered.mapInArrow(run, events.schema)


def retry_delays(attempts: int = 3, base_ms: int = 100) -> list[int]:
    return [base_ms * i for i in range(1, attempts + 1)]
