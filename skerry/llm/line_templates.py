"""Line deduplication with a log-template tree of fixed depth.

A line goes down the tree by its number of words, then by its first words, with
words that hold a digit as wildcards.  Below that its other words make PARTS
parts, one level each, at which a line takes two branches: by the part's words,
or the wildcard.  A path with FREE wildcards at most is a template, so a line
belongs to itself and to ten more general lines, and variable fields may lie in
any two of the parts.  Templates found in several documents are recurring; a line
goes if one of its recurring templates occurs in an earlier document (by doc_id),
so the first document of a template keeps its line, or one that is like it.

What templates a line has depends on the line alone: neither the number of lines
or templates in a leaf nor the order of lines matters, and a rerun gives the same
result.  Lines and templates are known by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import textnum as tn
from skerry.llm.workspace import Workspace

#: Leading words that make the path to a leaf.
DEPTH = 3
#: Parts of the words after them, and parts that a template leaves open: three fifths of a line's words are kept at least.
PARTS, FREE = 5, 2
#: Documents in which a template must occur to be recurring, and those that suffice for one of more than LONG words.
MIN_DOCS, MIN_DOCS_LONG = 3, 2
LONG = 50
#: The parts that each general template keeps.
MASKS = tuple(tuple(j for j in range(PARTS) if j not in free) for free in combinations(range(PARTS), FREE))
_DIGITS = np.isin(np.arange(256), np.arange(48, 58))
_WILD = np.uint64(0x9AE16A3B2F90404F)
_COLUMNS = ["doc_id", "line", "leaf", "key", "parts", "long"]
_SCHEMA = "doc_id long, line long, leaf long, key long, parts array<long>, long boolean"


class Lines:
    """Lines of a block of rows that hold a word: row, number in the row, size in words, and the hashes of leaf, whole line and parts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lo, hi = int(offsets[0]), int(offsets[-1])
        d = data[lo:hi]
        rel = offsets - lo
        w = tn.words(data, offsets, lower=False)
        start, end = w.start - lo, w.end - lo
        digit = np.concatenate([[0], np.cumsum(_DIGITS[d], dtype=np.int32)])
        word = np.where(digit[end] > digit[start], _WILD, w.hash)
        breaks = np.concatenate([[0], np.cumsum(d == 10, dtype=np.int64)])
        line_of = breaks[start] + w.row  # line breaks before the word, plus row ends
        first = np.flatnonzero(np.diff(line_of, prepend=-1)) if len(start) else np.zeros(0, np.int64)
        self.row = w.row[first]
        self.number = breaks[start[first]] - breaks[rel[self.row]]
        self.size = np.diff(np.append(first, len(start)))
        n = len(first)
        c = tn.constants(DEPTH, 61)
        leaf = tn.mix(self.size.astype(np.uint64))
        for j in range(DEPTH):
            has = self.size > j
            leaf[has] += word[first[has] + j] * c[j]
        self.leaf = tn.mix(leaf)
        place = np.arange(len(word)) - np.repeat(first, self.size)
        rest = np.flatnonzero(place >= DEPTH)
        owner = np.repeat(np.arange(n), self.size)[rest]
        place = place[rest] - DEPTH
        part = owner * PARTS + ((place + 1) * PARTS - 1) // (self.size[owner] - DEPTH)
        each = tn.mix(word[rest] ^ tn.mix(place.astype(np.uint64) + np.uint64(77)))
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        self.parts = np.zeros(n * PARTS, dtype=np.uint64)
        if len(begins):
            self.parts[part[begins]] = np.add.reduceat(each, begins)
        self.parts = self.parts.reshape(n, PARTS)
        self.key = tn.mix((self.parts * tn.constants(PARTS, 67)).sum(axis=1, dtype=np.uint64) + self.leaf)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long = lambda x: pa.array(x.view(np.int64))
    for batch in batches:
        data, offsets = tn.buffers(batch.column(1))
        for lo, hi in tn.blocks(offsets):
            x = Lines(data, offsets[lo : hi + 1])
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, x.parts.size + 1, PARTS, dtype=np.int32)), long(x.parts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(x.row)), pa.array(x.number), long(x.leaf), long(x.key), parts, pa.array(x.size > LONG)], _COLUMNS)


def _without(text_at: int):
    """Drops the lines that the last column lists from the text column; the last column becomes their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            columns = list(batch.columns)
            columns[-1] = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
            touched = pc.and_(pc.greater(columns[-1], 0), pc.is_valid(columns[text_at]))
            if touched.true_count:
                new = []
                for text, gone in zip(columns[text_at].filter(touched).to_pylist(), lists.filter(touched).to_pylist(), strict=True):
                    gone = set(gone)
                    new.append("\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone))
                columns[text_at] = pc.replace_with_mask(columns[text_at], touched, pa.array(new, columns[text_at].type))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def recurring_lines(ws: Workspace, docs: DataFrame, min_docs: int = MIN_DOCS, min_docs_long: int = MIN_DOCS_LONG) -> DataFrame:
    """(doc_id, line) of every line to drop, of a table with doc_id and text; ``min_docs`` is 2 or 3, ``min_docs_long`` too."""
    if not {min_docs, min_docs_long} <= {2, 3}:
        raise ValueError("templates recur from 2 or 3 documents on")
    lines = ws.write(docs.where("doc_id is not null").mapInArrow(_scan, _SCHEMA))
    enough = F.when(F.col("long"), min_docs_long).otherwise(min_docs)
    # Literal lines: where one is in fewer than three documents, the first and the last are all of them.
    each = lines.groupBy("key", "doc_id").agg(F.first("leaf").alias("leaf"), F.first("parts").alias("parts"), F.first("long").alias("long"))
    literal = each.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("parts").alias("parts"), F.first("long").alias("long"), F.count("*").alias("n_docs"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    literal = ws.write(literal)
    # General templates: of leaves with several lines only, since otherwise they hold nothing but the line itself.
    shared = ws.write(literal.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf"))
    masks = F.array(*(F.xxhash64("leaf", F.lit(i), *(F.element_at("parts", j + 1) for j in kept)) for i, kept in enumerate(MASKS)))
    general = ws.write(literal.join(shared, "leaf").select("key", "long", "n_docs", "low", "high", F.explode(masks).alias("template")))
    found = general.select("template", "long", "n_docs", F.explode(F.array("low", "high")).alias("doc_id"))
    found = found.groupBy("template", "doc_id").agg(F.first("long").alias("long"), F.max("n_docs").alias("n_docs"))
    recurs = found.groupBy("template").agg(F.first("long").alias("long"), F.max("n_docs").alias("most"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    recurs = ws.write(recurs.where(F.greatest("n", "most") >= enough).select("template", "first"))
    by_template = general.join(recurs, "template").select("key", "first")
    by_line = literal.where(F.col("n_docs") >= enough).select("key", F.col("low").alias("first"))
    drop = ws.write(by_template.unionAll(by_line).groupBy("key").agg(F.min("first").alias("first")))
    out = ws.write(lines.select("doc_id", "line", "key").join(drop, "key").where("doc_id > first").select("doc_id", "line"))
    ws.drop(lines, literal, shared, general, recurs, drop)
    return out


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_docs_long: int = MIN_DOCS_LONG, counted: str = "n_dropped") -> DataFrame:
    """``docs`` with its recurring lines cut from text, and their number as ``counted``; one row per row of ``docs``.

    A template recurs from ``min_docs`` documents on, or ``min_docs_long`` if it has
    more than LONG words: only short lines repeat by chance.
    Lines end at a line feed; words are parted by space and ASCII controls 9 to 13.
    Blank lines are in no template and stay.  A document keeps its row even if no
    line is left (its text is then empty).  Null texts stay null; rows without
    doc_id are left as they are and count for nothing; rows that share a doc_id
    count as one document.  Other columns pass through (one named as ``counted`` is
    replaced); an empty table gives an empty result.  Very long texts and lines are
    read whole, in blocks of a megabyte.
    """
    ws = Workspace(docs.sparkSession)
    docs = docs.drop(counted).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    gone = ws.finish(recurring_lines(ws, docs.select("doc_id", "text"), min_docs, min_docs_long).groupBy("doc_id").agg(F.collect_set("line").alias(counted)))
    touched = docs.join(gone.hint("merge"), "doc_id", "left").select(*docs.columns, counted)
    schema = T.StructType([*docs.schema.fields, T.StructField(counted, T.LongType())])
    return touched.mapInArrow(_without(docs.columns.index("text")), schema)


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i, [CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END FOR x IN regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')] AS k FROM l),
o AS (SELECT doc_id, i, k, len(k) AS n FROM w WHERE len(k) > 0),
u AS (SELECT k, n, k[1:3] AS head, greatest(n - 3, 0) AS r FROM (SELECT DISTINCT k, n FROM o)),
free AS (SELECT a, b FROM range(0, 5) x(a), range(0, 5) y(b) WHERE a < b UNION ALL SELECT -1, -1),
t AS (
  SELECT k, n, {'n': n, 'a': a, 'b': b, 'head': head, 'kept': [k[4 + j * r // 5 : 3 + (j + 1) * r // 5] FOR j IN range(0, 5) IF j <> a AND j <> b]} AS template FROM u, free),
r AS (
  SELECT template, min(doc_id) AS first FROM o JOIN t USING (k)
  GROUP BY template HAVING count(DISTINCT doc_id) >= CASE WHEN template.n > 50 THEN 2 ELSE 3 END),
lowest AS (SELECT k, min(first) AS first FROM t JOIN r USING (template) GROUP BY k),
gone AS (SELECT doc_id, i FROM o JOIN lowest USING (k) WHERE doc_id > first),
cut AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text, count(gone.i) AS n_dropped
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(cut.text, '') END AS text, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


def op4_line_templates(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
