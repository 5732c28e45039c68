"""Shards by balanced label propagation, in DataFrame functions only.

Linked documents are those with equal texts.  Every linked document starts in a
random shard; in each round the documents of a group move towards the shard that
holds most of their neighbours, as far as the shards' quotas allow, largest gains
first.  Documents without links fill the shards up to exact quotas.

A group's documents are interchangeable, so the state is the number of documents
of each group in each shard: pairs of neighbours are never listed, and a group
with a third of all rows is a few counts.  Ranks are taken in hashed buckets with
offsets, so no group or shard is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.workspace import Workspace

#: Rounds at most, and buckets of requests that a quota is cut by.
ROUNDS, CELLS = 6, 64
#: Rows that a bucket of a rank holds, about, and buckets at least: so many that they spread evenly over any number of tasks.
BUCKET_ROWS, BUCKETS = 20_000, 512


def ranked(df: DataFrame, keys: list[str], spread: Column, order: list[str], buckets: int, name: str) -> DataFrame:
    """``df`` with each row's number from 0 within ``keys``: numbers in hashed buckets plus the buckets' offsets."""
    own = df.withColumn("_b", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = own.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    numbered = own.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Linked documents in each shard."""
    r = state.agg(*(F.coalesce(F.sum(F.col("held")[s]), F.lit(0)).alias(f"s{s}") for s in range(shards))).first()
    return [int(x) for x in r]


def _propagate(ws: Workspace, state: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Rounds of moves on (group, held), ``held`` the group's documents by shard."""
    shards = len(quota)
    for turn in range(rounds):
        free = [max(0, q - x) for q, x in zip(quota, _loads(state, shards), strict=True)]
        # Towards the shard with most neighbours among those with room; never away from one with more.
        room = F.array(*(F.lit(x) for x in free))
        with_room = F.zip_with("held", room, lambda n, f: F.when(f > 0, n).otherwise(-1))
        most = F.array_max(with_room)
        here = state.withColumn("to", F.array_position(with_room, most).cast("int") - 1).where(most > 0)
        asks = here.select(
            "group", "held", "to",
            F.explode(F.transform("held", lambda n, s: F.struct(s.alias("from"), n.alias("n"), (most - n).alias("gain")))).alias("m"),
        ).where("m.n > 0 and (m.gain > 0 or m.gain = 0 and m.from > to)").select("group", "to", "m.from", "m.n", "m.gain")
        # Cells in the order of acceptance: gain by powers of two, then a hash.
        cell = (F.lit(CELLS * 64) - CELLS * F.floor(F.log2(F.col("gain") + 1.0)) - F.pmod(F.xxhash64("group"), F.lit(CELLS))).cast("int")
        asks = ws.write(asks.withColumn("cell", cell))
        sums = asks.groupBy("to", "cell").agg(F.sum("n").alias("asked"))  # at most shards * 64 * CELLS rows
        before = Window.partitionBy("to").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        left = F.greatest(F.lit(0), F.element_at(room, F.col("to") + 1).cast("long") - F.coalesce(F.sum("asked").over(before), F.lit(0)))
        grants = sums.select("to", "cell", "asked", left.alias("left"))
        # A cell that fits in part is granted in proportion, rounded at random; a slight excess is placed at the end.
        chance = F.pmod(F.xxhash64("group", "from", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        share = F.when(F.col("left") >= F.col("asked"), F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.col("n") * F.col("left") / F.col("asked") + chance)))
        moves = asks.join(F.broadcast(grants), ["to", "cell"]).select("group", "to", "from", share.cast("long").alias("n")).where("n > 0")
        change = moves.groupBy("group").agg(F.first("to").alias("to"), *(F.sum(F.when(F.col("from") == s, F.col("n")).otherwise(0)).alias(f"out{s}") for s in range(shards)))
        gone = [F.coalesce(F.col(f"out{s}"), F.lit(0)) for s in range(shards)]
        moved = sum(gone[1:], gone[0])
        held = [F.col("held")[s] - gone[s] + F.when(F.col("to") == s, moved).otherwise(F.lit(0)) for s in range(shards)]
        new = ws.write(state.join(change, "group", "left").select("group", F.array(*held).alias("held"), (moved > 0).alias("moved")))
        ws.drop(asks, state)
        state = new.select("group", "held")
        state._skerry_path = new._skerry_path
        if new.where("moved").isEmpty():
            break
    return state


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shards hold equal numbers of rows, at most one apart.  Size is
    the text's UTF-8 bytes plus 1; a null text has size 1 and crc 0 and links with
    nothing.  Rows with equal texts link, also where doc_id repeats or is null.
    Slots number each shard's rows from 0.  ``grown_shard`` is null under this law.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    text = F.col("text").cast("string")
    base = ws.write(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.unhex(F.substring(F.sha2("text", 256), 1, 32))).alias("group"),
        )
    )
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(16, -(-total // (BUCKET_ROWS * shards)))
    many = max(BUCKETS, buckets)
    start = F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards))
    counts = base.where("group is not null").groupBy("group").agg(
        F.count("*").alias("n"), *(F.count(F.when(start == s, 1)).alias(f"held{s}") for s in range(shards))
    ).where("n > 1")
    state = ws.write(counts.select("group", F.array(*(f"held{s}" for s in range(shards))).alias("held")))
    state = _propagate(ws, state, quota, rounds)

    # Every linked document takes its group's shards in turn; what exceeds a quota is placed with the rest.
    both = ws.write(base.join(state.withColumn("linked", F.lit(True)), "group", "left"))
    ws.drop(base, state)
    linked = ranked(both.where("linked"), ["group"], F.col("doc_id"), ["doc_id"], buckets, "number")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    shard = F.size(F.filter(ends, lambda e: e <= F.col("number")))
    linked = linked.select("doc_id", "size", "text_crc32", "group", shard.alias("shard"))
    linked = ws.write(ranked(linked, ["shard"], F.struct("doc_id", "group"), ["group", "doc_id"], many, "slot"))
    limit = F.element_at(F.array(*(F.lit(q) for q in quota)), F.col("shard") + 1)
    placed = linked.where(F.col("slot") < limit)
    used = dict(placed.groupBy("shard").count().collect())
    rest = both.where("linked is null").select("doc_id", "size", "text_crc32", "group").unionByName(linked.where(F.col("slot") >= limit).select("doc_id", "size", "text_crc32", "group"))
    rest = ranked(rest.withColumn("one", F.lit(1)), ["one"], F.struct("doc_id", "group"), ["group", "doc_id"], many * shards, "number")
    which, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        have = used.get(s, 0)
        room = quota[s] - have
        here = (F.col("number") >= at) & (F.col("number") < at + room)
        which, slot = F.when(here, s).otherwise(which), F.when(here, F.col("number") - at + have).otherwise(slot)
        at += room
    filled = rest.select("doc_id", "size", "text_crc32", which.alias("shard"), slot.alias("slot"))
    out = placed.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(filled)
    return ws.finish(out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op6_balanced_shards(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
