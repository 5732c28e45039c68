"""The operation log as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources.tables import shared_dir

OUT = "id long, seq long, value double, live boolean"
#: Last delete's seq, and the inserts after it (a delete that comes late may still take the first of them).
STATE = "last long, seqs array<long>, values array<double>"


def _step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, seqs, values = state.get if state.exists else (0, [], [])
    inserts = dict(zip(seqs, values, strict=True))
    for pdf in frames:
        for seq, op, value in zip(pdf["seq"].tolist(), pdf["op"].tolist(), pdf["value"].tolist(), strict=True):
            if op == "D":
                last = max(last, seq)
            elif op == "I":
                inserts.setdefault(seq, value)
    kept = sorted(s for s in inserts if s > last)
    state.update((last, kept, [inserts[s] for s in kept]))
    first = kept[0] if kept else None
    yield pd.DataFrame({"id": [key[0]], "seq": [first], "value": [inserts.get(first)], "live": [bool(kept)]})


def fold_stream(ops: DataFrame) -> DataFrame:
    """Updates (id, seq, value, live) of a stream ``ops(seq, op, id, value)``; the order of arrival does not matter."""
    return ops.groupBy("id").applyInPandasWithState(_step, OUT, STATE, "update", "NoTimeout")


def run_available(ops: DataFrame) -> DataFrame:
    """Run a stream over all that is there; the live rows (id, seq, value) at its end."""
    spark = ops.sparkSession
    root = f"{shared_dir(spark)}/skerry-stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/out")

    query = fold_stream(ops).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(f"{OUT}, batch long").parquet(f"{root}/out")
    newest = out.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch")))).where("_n = 1")
    return newest.where("live").select("id", "seq", "value")


def dedupe_stream(events: DataFrame, keys: list[str], t: str = "ts", ttl: str = "30 seconds") -> DataFrame:
    """Events of a stream whose key was not seen within ``ttl``; state goes with the watermark."""
    return events.withWatermark(t, ttl).dropDuplicatesWithinWatermark(keys)
