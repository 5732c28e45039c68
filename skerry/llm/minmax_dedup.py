"""Near-duplicate documents by min-max hashing.

Every permutation gives two signature values, its minimum and its maximum over
the document's shingles, so a signature of 2P values costs P hash evaluations;
both match with probability equal to the Jaccard similarity.  Bands of ``ROWS``
values make candidate pairs, and every link is confirmed on the full shingle sets.

Work per group of copies stays linear where it can: equal sets collapse to one
representative before banding; in a bucket each member is first compared with
the bucket's pivot alone; only buckets whose members are still in different
components afterwards are searched further, by an exact prefix filter over the
shingles that different components share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import textnum as tn
from skerry.llm.graph import components
from skerry.llm.workspace import Workspace

#: Signature values in a band, and the chance that a pair exactly at the threshold shares no band.
ROWS, MISS = 5, 1e-8
#: Ratio of the sizes of two classes of sets.
SIZE_STEP = 1.02


def n_bands(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))) if threshold < 1 else 1


def signatures(x: np.ndarray, bounds: np.ndarray, n_values: int) -> np.ndarray:
    """(rows, n_values) min-max signatures of the non-empty sets that ``bounds`` cut from ``x``."""
    n_perm = (n_values + 1) // 2
    a, b = tn.constants(n_perm, 31), tn.constants(n_perm, 37)
    starts = bounds[:-1]
    out = np.empty((2 * n_perm, len(starts)), dtype=np.uint64)
    y = np.empty_like(x)
    for p in range(n_perm):
        np.multiply(x, a[p], out=y)
        np.add(y, b[p], out=y)
        y ^= y >> np.uint64(32)
        out[p] = np.minimum.reduceat(y, starts)
        out[n_perm + p] = np.maximum.reduceat(y, starts)
    return out[:n_values].T


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) keys; a band's number is part of its key."""
    c = tn.constants(ROWS, 41)
    v = sig[:, : bands * ROWS].reshape(len(sig), bands, ROWS)
    h = np.broadcast_to(tn.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)), v.shape[:2]).copy()
    for j in range(ROWS):
        h += v[:, :, j] * c[j]
    return tn.mix(h)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tn.buffers(batch.column(1))
            for lo, hi in tn.blocks(offsets):
                n = hi - lo
                bounds, x = tn.shingles(tn.words(data, offsets[lo : hi + 1]), n, k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                fp = np.zeros((2, n), dtype=np.uint64)
                keys = np.zeros((0, bands), dtype=np.uint64)
                if len(full):
                    own = np.append(bounds[:-1][full], bounds[-1])
                    fp[0, full] = np.add.reduceat(tn.mix(x), own[:-1])
                    fp[1, full] = np.add.reduceat(tn.mix(x ^ np.uint64(0x5851F42D4C957F2D)), own[:-1])
                    keys = band_keys(signatures(x, own, bands * ROWS), bands)
                each = np.zeros(n, dtype=np.int64)
                each[full] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(sizes), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), _lists(keys.reshape(-1), each)],
                    ["doc_id", "n_shingles", "fp_a", "fp_b", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tn.buffers(batch.column(1))
            for lo, hi in tn.blocks(offsets):
                bounds, x = tn.shingles(tn.words(data, offsets[lo : hi + 1]), hi - lo, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(x, np.diff(bounds))], ["rep", "shingles"])

    return run


def _linked(ws: Workspace, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"), F.size("shingles").cast("long").alias("n_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"), F.size("shingles").cast("long").alias("n_b"))
    near = F.expr(f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(near)
    both = both.withColumn("inter", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    return ws.write(both.where(F.expr(f"100L * inter >= {percent}L * (n_a + n_b - inter)")).select("a", "b").distinct())


def _across(ws: Workspace, apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives with different labels that may still link; no link is missed.

    ``apart`` has rep and label.  A link across labels consists of shingles that two
    labels have, so representatives with too few of those can't have one.  Of the
    others, a link shares one of each side's rarest shingles (prefix filter: all but
    percent of the set, plus one).  Per shingle only members outside its largest
    label are joined with the others, and only with sets of a size that, with what
    the two can still have in common, allows a link: pages of one template, alike but
    under the threshold, do not meet.
    """
    tokens = apart.join(sets, "rep").select("rep", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("g"))
    seen = ws.write(tokens.groupBy("g").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("g", "df"))
    shared = tokens.join(seen.hint("merge"), "g")
    own = Window.partitionBy("rep")
    shared = shared.withColumn("place", F.row_number().over(own.orderBy("df", "g"))).withColumn("s", F.count("*").over(own))
    prefix = F.expr(f"n - cast(ceil({percent} * n / 100.0) as bigint) + 1 - (n - s)")
    # From the first common shingle on, a pair has at most this many in common, which bounds the other's size.
    most = F.col("s") - F.col("place") + 1
    least_n = F.expr(f"cast(ceil({percent} * n / 100.0) as bigint)")
    most_n = F.least(F.expr(f"cast(floor(100 * n / {percent}.0) as bigint)"), F.floor((100 + percent) * F.col("most") / float(percent)).cast("long") - F.col("n"))
    prefix = shared.where(F.col("place") <= prefix).select("g", "rep", "label", "n", most.alias("most"))
    prefix = ws.write(prefix.withColumn("from_n", least_n).withColumn("to_n", most_n).where("from_n <= to_n"))
    largest = ws.write(prefix.groupBy("g", "label").count().groupBy("g").agg(F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("g", F.col("top.label").alias("major")))
    size = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")
    few = prefix.join(largest, "g").where("label <> major").select("g", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("most").alias("mx"), F.explode(F.sequence(size(F.col("from_n")), size(F.col("to_n")))).alias("size"))
    enough = f"{100 + percent}L * least(most, mx) >= {percent}L * (n + nx)"
    pairs = few.join(prefix.withColumn("size", size(F.col("n"))), ["g", "size"]).where(F.expr(f"label <> lx and 100L * least(n, nx) >= {percent}L * greatest(n, nx) and {enough}"))
    out = ws.write(pairs.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct())
    ws.drop(seen, prefix, largest)
    return out


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct([concat(t[i], ' ', t[i + 1], ' ', t[i + 2]) FOR i IN range(1, len(t) - 1)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, both_.b FROM reach JOIN both_ ON both_.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    ``docs`` has doc_id (long) and text; other columns are not read.  Words are runs
    of anything but space and ASCII controls 9 to 13, with A-Z lowered; a document's
    set holds its distinct k-word shingles, or its whole word sequence where it has
    fewer words.  Documents link where 100 * intersection >= percent * union.
    Null, empty and blank texts have an empty set, link with nothing and are kept.
    A row without doc_id is returned with a null component and kept.  Rows that
    share a doc_id are one node and each is returned.  An empty table gives an
    empty result.  Very long texts are read whole.  Shingles are known by 64-bit
    hashes of their words' bytes.  The result is a written table.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = n_bands(percent / 100)
    sketch = ws.write(docs.mapInArrow(_sketch(k, bands), "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>"))
    groups = ws.write(
        sketch.where("n_shingles > 0 and doc_id is not null")
        .groupBy("fp_a", "fp_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    buckets = groups.select("rep", F.explode("bands").alias("key"))
    shared = ws.write(buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last"))
    members = ws.write(buckets.join(shared, "key").select("key", "rep", "pivot"))
    first = ws.write(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(k), "rep long, shingles array<long>")
    sets = ws.write(sets)
    links = _linked(ws, first, sets, percent)
    labels = components(ws, links)

    own = labels.select(F.col("node").alias("rep"), "component")
    apart = ws.write(members.select("key", "rep").join(own, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label")))
    mixed = ws.write(apart.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
    rest = _across(ws, ws.write(apart.join(mixed, "key").select("rep", "label").distinct()), sets, percent)
    if not rest.isEmpty():
        labels = components(ws, links.union(_linked(ws, rest, sets, percent)))
    own = labels.select(F.col("node").alias("rep"), "component")
    reps = groups.select("fp_a", "fp_b", "n_shingles", "rep").join(own, "rep", "left")
    reps = reps.select("fp_a", "fp_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.drop("bands").join(reps.hint("merge"), ["fp_a", "fp_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(component)
    return ws.finish(out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, without the documents that ``near_duplicates`` doesn't keep; of each group the smallest doc_id stays.

    All rows of the doc_id that stays do; rows without doc_id, and documents without words, stay.
    """
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op7_minmax_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents linked at Jaccard 0.85 over 3-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
