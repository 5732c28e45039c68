"""A log of batches on shared storage: numbered commits, snapshots, a cursor.

A batch's rows are written to a folder of their own first; then a commit record is
put under the next number, if nobody has put one there.  So a lost writer leaves
nothing that a reader sees, and two writers never share a number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.errors import ConcurrentModification, LogTruncated
from skerry.sources.store import Store

#: Commits that others may win before a writer gives up.
RETRIES = 50


def _key(kind: str, seq: int) -> str:
    return f"{kind}/{seq:016d}.json"


@dataclass
class Commit:
    seq: int
    op: str
    rows: int
    folder: str


class CommitLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, first: int = 1):
        """``schema`` is that of a batch's rows; numbers start from ``first``."""
        self.spark, self.path, self.schema, self.first = spark, path.rstrip("/"), schema, first
        self.store = Store(spark, self.path)
        self._known: dict[str, Commit] = {}  # records never change

    def commits(self, after: int = 0, upto: int | None = None) -> list[Commit]:
        """Commit records with after < seq <= upto; one small object a batch."""
        wanted = [n for n in self.store.names("log") if after < int(n[:16]) and (upto is None or int(n[:16]) <= upto)]
        for n in wanted:
            if n not in self._known:
                self._known[n] = Commit(int(n[:16]), **self.store.get_json(f"log/{n}"))
        return [self._known[n] for n in wanted]

    def snapshots(self) -> list[int]:
        return [int(n[:16]) for n in self.store.names("snapshots")]

    def head(self) -> int:
        """The last number given; ``first`` - 1 for an empty log."""
        last = [int(n[:16]) for n in self.store.names("log")[-1:]]
        return max([self.first - 1, *last, *self.snapshots()[-1:]])

    def cursor(self) -> int:
        """Batches up to here are gone; what they did is in a snapshot."""
        return self.store.get_json("cursor.json")["seq"] if self.store.exists("cursor.json") else 0

    def append(self, rows: DataFrame, op: str) -> Commit:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
        seq = self.head() + 1
        for seq in range(seq, seq + RETRIES):
            if self.store.put_if_absent(_key("log", seq), json.dumps({"op": op, "rows": n, "folder": folder}).encode()):
                return Commit(seq, op, n, folder)
        raise ConcurrentModification(f"{self.path}: {RETRIES} commits of others in a row")

    def read(self, after: int = 0, upto: int | None = None, ops: str = "") -> DataFrame | None:
        """Rows with seq and op of the commits in a range (of some kinds); None if there are none.  Only their folders are read."""
        if after < self.cursor():
            raise LogTruncated(f"{self.path}: batches up to {self.cursor()} are gone")
        found = [c for c in self.commits(after, upto) if not ops or c.op in ops]
        if not found:
            return None
        named = F.broadcast(self.spark.createDataFrame([(c.folder[5:], c.seq, c.op) for c in found], "_folder string, seq long, op string"))
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{c.folder}" for c in found))
        return rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)).join(named, "_folder").drop("_folder")

    def write_snapshot(self, rows: DataFrame, seq: int) -> None:
        """Rows that stand for all batches up to ``seq``."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self.store.put_if_absent(_key("snapshots", seq), json.dumps({"folder": folder, "schema": rows.schema.jsonValue()}).encode())

    def read_snapshot(self, upto: int | None = None) -> tuple[int, DataFrame] | None:
        """(seq, rows) of the last snapshot up to ``upto``."""
        known = [s for s in self.snapshots() if upto is None or s <= upto]
        if not known:
            return None
        at = self.store.get_json(_key("snapshots", known[-1]))
        return known[-1], self.spark.read.schema(T.StructType.fromJson(at["schema"])).parquet(f"{self.path}/{at['folder']}")

    def truncate(self, upto: int) -> int:
        """Remove batches up to ``upto`` and snapshots before the one that holds them; how many batches went."""
        if not any(s >= upto for s in self.snapshots()):
            raise ValueError(f"no snapshot holds the batches up to {upto}")
        gone = self.commits(0, upto)
        self.store.put("cursor.json", json.dumps({"seq": max(upto, self.cursor())}).encode())
        for c in gone:
            self.store.delete(_key("log", c.seq))
            self.store.delete(c.folder)
        for s in [s for s in self.snapshots() if s < upto]:
            self.store.delete(self.store.get_json(_key("snapshots", s))["folder"])
            self.store.delete(_key("snapshots", s))
        return len(gone)

