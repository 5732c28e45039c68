"""Collections in tenants and databases, on tables in a folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import CollectionNotFound, ConcurrentModification, DimensionMismatch, DuplicateID, QuotaExceeded, TenantNotFound, VectorNotFound
from skerry.functions import distance as D
from skerry.functions.filters import compile_filter, json_of
from skerry.operators import catalog, cluster, fusion, graph_index, knn, oplog, sparse
from skerry.operators.commitlog import RETRIES, CommitLog
from skerry.sources import tables
from skerry.sources.store import Store

INDEXES = ("flat", "ivf", "ivfpq", "hnsw", "spann")
_ROWS = "id long, vector array<float>, document string, metadata string"
_OPS = f"seq long, op string, {_ROWS}"
#: Operations on metadata: new values of keys, and removal of all keys.
UPDATE, CLEAR = "U", "X"
#: Versions of the catalogue that are kept.
VERSIONS = 10
#: Limits of a tenant; 0 is none.
LIMITS = ("max_databases", "max_collections", "max_vectors")


class Engine:
    """Tenants, databases and collections; a collection's rows are a log of operations, folded on read.

    The catalogue is a small object under ``root``, a new version for every change:
    whoever opens the same root sees the same, and of two writers one has to read
    again.  Every read of vectors gives a lazy DataFrame.  What belongs to another
    tenant is not found.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)
        self._version, self._state = 0, {"tenants": {catalog.DEFAULT_TENANT: dict.fromkeys(LIMITS, 0)}, "databases": [[catalog.DEFAULT_TENANT, catalog.DEFAULT_DATABASE]], "collections": {}}
        self._open: dict[str, Collection] = {}
        self._logs: dict[str, CommitLog] = {}

    def log(self, path: str, first: int = 1) -> CommitLog:
        """The log of a collection's folder."""
        if path not in self._logs:
            self._logs[path] = CommitLog(self.spark, path, _ROWS, first)
        self._logs[path].first = max(first, self._logs[path].first)
        return self._logs[path]

    def _read(self) -> dict:
        names = self.store.names("catalogue")
        if names and int(names[-1][:12]) > self._version:
            self._version, self._state = int(names[-1][:12]), self.store.get_json(f"catalogue/{names[-1]}")
        return self._state

    def _change(self, change: Callable[[dict], Any]) -> Any:
        """Apply a change to the newest catalogue and put the next version; again if someone else was first."""
        for _ in range(RETRIES):
            state = json.loads(json.dumps(self._read()))
            out = change(state)
            if self.store.put_if_absent(f"catalogue/{self._version + 1:012d}.json", json.dumps(state).encode()):
                self._version, self._state = self._version + 1, state
                for old in self.store.names("catalogue")[:-VERSIONS]:
                    self.store.delete(f"catalogue/{old}")
                return out
        raise ConcurrentModification("the catalogue")

    def create_tenant(self, name: str, max_databases: int = 0, max_collections: int = 0, max_vectors: int = 0) -> None:
        def change(state: dict) -> None:
            if name in state["tenants"]:
                raise DuplicateID(f"tenant {name}")
            state["tenants"][name] = dict(zip(LIMITS, (max_databases, max_collections, max_vectors), strict=True))

        self._change(change)

    def list_tenants(self) -> list[str]:
        return sorted(self._read()["tenants"])

    def delete_tenant(self, name: str) -> None:
        """The tenant's databases go; its collections stay in the catalogue, out of reach."""

        def change(state: dict) -> None:
            self._tenant(name, state)
            del state["tenants"][name]
            state["databases"] = [d for d in state["databases"] if d[0] != name]

        self._change(change)

    def create_database(self, tenant: str, name: str) -> None:
        def change(state: dict) -> None:
            limits = self._tenant(tenant, state)
            if [tenant, name] in state["databases"]:
                raise DuplicateID(f"database {name}")
            catalog.check_quota(sum(d[0] == tenant for d in state["databases"]), limits["max_databases"])
            state["databases"].append([tenant, name])

        self._change(change)

    def delete_database(self, tenant: str, name: str) -> None:
        """The database goes with its collections."""

        def change(state: dict) -> None:
            self._tenant(tenant, state)
            if [tenant, name] not in state["databases"]:
                raise CollectionNotFound(f"database {name}")
            state["databases"].remove([tenant, name])
            for c in state["collections"].values():
                if (c["tenant"], c["database"]) == (tenant, name):
                    c["deleted"] = True

        self._change(change)

    def list_databases(self, tenant: str) -> list[str]:
        state = self._read()
        self._tenant(tenant, state)
        return sorted(d for t, d in state["databases"] if t == tenant)

    def _tenant(self, name: str, state: dict) -> dict:
        if name not in state["tenants"]:
            raise TenantNotFound(name)
        return state["tenants"][name]

    def quotas(self, tenant: str) -> dict[str, int]:
        """The tenant's limits; 0 is none."""
        return dict(self._tenant(tenant, self._read()))

    def usage(self, tenant: str) -> dict[str, int]:
        """What the tenant has: databases, collections, live vectors and their bytes."""
        own = self.list_collections(tenant)
        counted = [(c.count(), c.dimension) for c in own]
        return {"databases": len(self.list_databases(tenant)), "collections": len(own), "vectors": sum(n for n, _ in counted), "bytes": sum(4 * n * d for n, d in counted)}

    def create_collection(self, name: str, dimension: int, metric: str = "l2", index: str = "flat", tenant: str = catalog.DEFAULT_TENANT, database: str = catalog.DEFAULT_DATABASE, **options: Any) -> "Collection":
        return self._create(name, dimension, metric, index, tenant, database, options, [])

    def _create(self, name: str, dimension: int, metric: str, index: str, tenant: str, database: str, options: dict, inherited: list) -> "Collection":
        D.metric(metric)
        if index not in INDEXES:
            raise ValueError(f"unknown index {index!r}; valid: {', '.join(INDEXES)}")
        if index == "ivfpq" and dimension % options.get("parts", 8):
            raise DimensionMismatch(f"{dimension} dimensions can't be cut into {options.get('parts', 8)} parts")
        id = uuid.uuid4().hex
        record = {"name": name, "dimension": dimension, "metric": metric, "index": index, "tenant": tenant, "database": database, "options": options, "inherited": inherited, "deleted": False}

        def change(state: dict) -> None:
            limits = self._tenant(tenant, state)
            if [tenant, database] not in state["databases"]:
                raise CollectionNotFound(f"database {database}")
            own = [c for c in state["collections"].values() if c["tenant"] == tenant and not c["deleted"]]
            if any((c["name"], c["database"]) == (name, database) for c in own):
                raise DuplicateID(f"collection {name}")
            if limits["max_collections"] and len(own) >= limits["max_collections"]:
                raise QuotaExceeded(f"{len(own)} of {limits['max_collections']} collections")
            state["collections"][id] = record

        self._change(change)
        return self._collection(id, record)

    def _collection(self, id: str, record: dict) -> "Collection":
        if id not in self._open:
            self._open[id] = Collection(self, id, record)
        return self._open[id]

    def list_collections(self, tenant: str = catalog.DEFAULT_TENANT, database: str | None = None) -> list["Collection"]:
        state = self._read()
        self._tenant(tenant, state)
        return [self._collection(i, c) for i, c in state["collections"].items() if c["tenant"] == tenant and not c["deleted"] and database in (None, c["database"])]

    def get_collection(self, id_or_name: str, tenant: str = catalog.DEFAULT_TENANT) -> "Collection":
        for c in self.list_collections(tenant):
            if id_or_name in (c.id, c.name):
                return c
        raise CollectionNotFound(id_or_name)

    def delete_collection(self, id_or_name: str, tenant: str = catalog.DEFAULT_TENANT) -> None:
        """The collection is not found any more; its rows stay for its forks."""
        id = self.get_collection(id_or_name, tenant).id

        def change(state: dict) -> None:
            state["collections"][id]["deleted"] = True

        self._change(change)

    def fork(self, id_or_name: str, name: str, tenant: str = catalog.DEFAULT_TENANT) -> "Collection":
        """A new collection on the same rows; what is written to either later stays its own."""
        old = self.get_collection(id_or_name, tenant)
        return self._create(name, old.dimension, old.metric, old.index, old.tenant, old.database, old.options, [*old.inherited, [old.path, old.head()]])

    def flush(self, tenant: str = catalog.DEFAULT_TENANT) -> None:
        """A snapshot of every collection."""
        for c in self.list_collections(tenant):
            c.snapshot()

    def forks_of(self, path: str) -> int:
        return sum(any(p == path for p, _ in c["inherited"]) for c in self._read()["collections"].values() if not c["deleted"])


class Collection:
    def __init__(self, engine: Engine, id: str, record: Mapping[str, Any]):
        self.engine, self.id = engine, id
        self.name, self.dimension, self.metric, self.index = (record[k] for k in ("name", "dimension", "metric", "index"))
        self.tenant, self.database, self.options = record["tenant"], record["database"], dict(record["options"])
        self.inherited: list[list] = record["inherited"]
        first = self.inherited[-1][1] + 1 if self.inherited else 1
        self._log = engine.log(self.path, first)
        self._built: tuple[int, Any] | None = None

    @property
    def path(self) -> str:
        return f"{self.engine.root}/{self.tenant}/{self.id}"

    # --- writing ---

    def insert(self, rows: DataFrame | Iterable[tuple]) -> None:
        """Add rows (id, vector [, document] [, metadata as JSON text]); an id that is there keeps its first row."""
        spark = self.engine.spark
        if not isinstance(rows, DataFrame):
            rows = spark.createDataFrame([(int(r[0]), [float(x) for x in r[1]], *(list(r[2:]) + [None, None])[:2]) for r in rows], "id long, vector array<float>, document string, metadata string")
        for c in ("document", "metadata"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        if not rows.where(F.col("vector").isNull() | (F.size("vector") != self.dimension)).isEmpty():
            raise DimensionMismatch(f"the collection has {self.dimension} dimensions")
        limit = self.engine.quotas(self.tenant)["max_vectors"]
        # One number a batch: within a batch of one kind the order of different ids does not matter.
        rows = rows.groupBy("id").agg(F.min(F.struct("vector", "document", "metadata")).alias("r")).select("id", "r.*")
        if limit and self.engine.usage(self.tenant)["vectors"] + rows.join(self.vectors().select("id"), "id", "left_anti").count() > limit:
            raise QuotaExceeded(f"more than {limit} vectors")
        self._append(rows, oplog.INSERT)

    def delete(self, ids: Iterable[int] | DataFrame) -> None:
        rows = ids if isinstance(ids, DataFrame) else self.engine.spark.createDataFrame([(int(i),) for i in ids], "id long")
        self._append(self._bare(rows).distinct(), oplog.DELETE)

    def update_metadata(self, rows: DataFrame | Iterable[tuple[int, Mapping]]) -> None:
        """New values of metadata keys, (id, metadata): other keys stay; ids that are not there change nothing."""
        if not isinstance(rows, DataFrame):
            rows = self.engine.spark.createDataFrame([(int(i), m if isinstance(m, str) else json.dumps(m)) for i, m in rows], "id long, metadata string")
        rows = rows.groupBy("id").agg(F.max("metadata").alias("metadata"))
        self._append(rows.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("document"), "metadata"), UPDATE)

    def delete_metadata(self, ids: Iterable[int]) -> None:
        """Remove all metadata of some ids."""
        self._append(self._bare(self.engine.spark.createDataFrame([(int(i),) for i in ids], "id long")).distinct(), CLEAR)

    def ingest_images(self, path: str, embedder: Any, first_id: int = 1) -> int:
        """Insert the image files under ``path``: ids in path order from ``first_id``, the file name as document; how many.

        ``embedder`` is a column function from the files' bytes to vectors.
        """
        files = tables.read_images(self.engine.spark, path)
        rows = files.select((F.col("id") + (first_id - 1)).alias("id"), embedder("content").alias("vector"), F.col("filename").alias("document"), F.to_json(F.struct("path")).alias("metadata"))
        rows = tables.written(rows)  # the embedder runs once
        self.insert(rows)
        return rows.count()

    @staticmethod
    def _bare(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("string").alias("metadata"))

    def _append(self, rows: DataFrame, op: str) -> None:
        self._log.append(rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "document", "metadata"), op)
        if op in (oplog.INSERT, oplog.DELETE) and self.options.get("auto_rebuild", True):
            self.maintain()

    # --- reading ---

    def head(self) -> int:
        """Number of the last batch."""
        return self._log.head()

    def _chain(self) -> list[tuple[CommitLog, int]]:
        """Logs that the rows come from, and the last number of each that counts."""
        return [(self.engine.log(p), last) for p, last in self.inherited] + [(self._log, self._log.head())]

    def _sources(self) -> tuple[int, DataFrame | None, list[tuple[CommitLog, int]]]:
        """(snapshot's number, its rows, logs with the last number of each): what the live rows are made of."""
        logs = self._chain()
        for i in range(len(logs) - 1, -1, -1):
            if found := logs[i][0].read_snapshot(logs[i][1]):
                return *found, logs[i:]
        return 0, None, logs

    def _ops(self, logs: list[tuple[CommitLog, int]], after: int, kinds: str) -> DataFrame:
        out = self.engine.spark.createDataFrame([], _OPS)
        for log, last in logs:
            part = log.read(after, last, kinds) if last > after else None
            if part is not None:
                out = out.unionByName(part.select(*out.columns))
            after = max(after, last)
        return out

    def log(self, after: int = 0) -> DataFrame:
        """Operations (seq, op, id, vector, document, metadata) after a number; those before a truncation are gone."""
        return self._ops(self._chain(), after, "")

    def _live(self, id: int | None = None) -> DataFrame:
        """Live rows with the number of the batch that brought them."""
        seq, snapshot, logs = self._sources()
        own = (lambda df: df) if id is None else (lambda df: df.where(F.col("id") == id))
        ops = own(self._ops(logs, seq, oplog.INSERT + oplog.DELETE))
        rows = oplog.fold(ops) if snapshot is None else oplog.fold_on_snapshot(own(snapshot), ops, seq)
        if not any(c.op in UPDATE + CLEAR for log, last in logs for c in log.commits(max(seq, log.cursor()), last)):
            return rows
        changes = own(self._ops(logs, seq, UPDATE + CLEAR).select(F.col("seq").alias("at"), "op", "id", F.col("metadata").alias("new")))
        # Changes apply to the row that was there, in their order.
        listed = rows.select("id", "seq").join(changes, "id").where("at > seq").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "op", "new"))).alias("changes"))
        merged = F.aggregate("changes", F.col("metadata"), lambda m, c: F.when(c["op"] == CLEAR, F.lit(None).cast("string")).otherwise(catalog.merge_json(m, c["new"])))
        return rows.join(listed, "id", "left").withColumn("metadata", F.when(F.col("changes").isNull(), F.col("metadata")).otherwise(merged)).drop("changes")

    def vectors(self) -> DataFrame:
        """Live rows: id, vector, document, metadata."""
        return self._live().drop("seq")

    def count(self) -> int:
        return self.vectors().count()

    def get(self, id: int) -> DataFrame:
        return self._live(id).drop("seq")

    def vector(self, id: int) -> list[float]:
        row = self.get(id).first()
        if row is None:
            raise VectorNotFound(str(id))
        return row.vector

    def _filtered(self, spec: Mapping[str, Any] | None) -> DataFrame:
        rows = self.vectors()
        return rows.where(compile_filter(spec, json_of(F.coalesce("metadata", F.lit("{}"))))) if spec else rows

    # --- snapshots ---

    def snapshot(self) -> int:
        """Write the live rows as a table, so that reads fold only later batches; the number it stands for."""
        seq = self.head()
        if seq and seq not in self._log.snapshots():
            self._log.write_snapshot(self._live(), seq)
        return seq

    def truncate(self, upto: int | None = None) -> int:
        """Remove batches that a snapshot holds (up to the last one, or to ``upto``); how many.  A collection with forks keeps all."""
        known = self._log.snapshots()
        if not known or self.engine.forks_of(self.path):
            return 0
        return self._log.truncate(known[-1] if upto is None else upto)

    # --- the index ---

    def build_index(self, path: str | None = None) -> None:
        """Build, write and use the index; a later engine on the same root loads it (from ``path``, if given)."""
        seq, o = self.head(), self.options
        rows, cells = self.vectors().select("id", "vector"), o.get("cells", cluster.CELLS)
        path = path or f"{self.path}/index/{seq:016d}-{uuid.uuid4().hex}"
        spark, model = self.engine.spark, b""
        if self.index == "flat":
            return
        if self.index == "hnsw":
            graph_index.build_graphs(rows, self.metric, o.get("shards")).write.mode("overwrite").parquet(path)
            built = spark.read.schema(graph_index.GRAPH).parquet(path)
        else:
            if self.index == "spann":
                built = cluster.build_posting_lists(rows, cells, self.metric, path=path)
            else:
                built = cluster.build_ivf(rows, cells, "l2" if self.index == "ivfpq" else self.metric, o.get("parts", 8) if self.index == "ivfpq" else 0, path=path)
            model = cluster.pack(built)
        name = f"indexes/{seq:016d}-{uuid.uuid4().hex}"
        store = Store(spark, self.path)
        if model:
            store.put(f"{name}.npz", model)
        store.put(f"{name}.json", json.dumps({"seq": seq, "path": path, "kind": self.index}).encode())
        self._built = seq, built

    def _index(self) -> tuple[int, Any] | None:
        """(number it was built at, index), loaded if another engine built it."""
        if self._built is None:
            store = Store(self.engine.spark, self.path)
            found = [n for n in store.names("indexes") if n.endswith(".json")]
            if found:
                at = store.get_json(f"indexes/{found[-1]}")
                if self.index == "hnsw":
                    built = self.engine.spark.read.schema(graph_index.GRAPH).parquet(at["path"])
                else:
                    built = cluster.unpack(self.engine.spark, store.get(f"indexes/{found[-1][:-5]}.npz"), at["path"], "l2" if self.index == "ivfpq" else self.metric)
                self._built = at["seq"], built
        return self._built

    def changed_rows(self) -> int:
        """Rows in batches after the index was built; 0 without an index."""
        at = self._index()
        return sum(c.rows for c in self._log.commits(at[0]) if c.op in oplog.INSERT + oplog.DELETE) if at else 0

    def maintain(self) -> bool:
        """Build the index again if too many rows have changed since."""
        if not cluster.stale(self.changed_rows()):
            return False
        self.build_index()
        return True

    def search(self, query: Sequence[float], k: int = 10, nprobe: int = 0, filter: Mapping[str, Any] | None = None, with_metadata: bool = False) -> DataFrame:
        """Nearest rows: id, distance, score; through the index if one is built and nothing is filtered, else exact.

        Rows that came after the index was built are searched exactly beside it, and
        those that went are left out.
        """
        if len(query) != self.dimension:
            raise DimensionMismatch(f"query has {len(query)} dimensions, the collection {self.dimension}")
        at = None if filter or self.index == "flat" else self._index()
        out = knn.flat_knn(self._filtered(filter), query, k, self.metric) if at is None else self._search_index(*at, query, k, nprobe)
        return knn.hydrate(out, self.vectors().select("id", "document", "metadata")) if with_metadata else out

    def _search_index(self, seq: int, built: Any, query: Sequence[float], k: int, nprobe: int) -> DataFrame:
        recent = [c for c in self._log.commits(max(seq, self._log.cursor())) if c.op in oplog.INSERT + oplog.DELETE] if self.head() > seq else []
        dead, n_dead, new = None, 0, None
        if recent:
            if self._log.cursor() > seq:  # what went since is not on record any more
                return knn.flat_knn(self.vectors(), query, k, self.metric)
            n_dead = sum(c.rows for c in recent if c.op == oplog.DELETE)
            if n_dead:
                dead = self._log.read(seq, None, oplog.DELETE).select("id").distinct()
            new = self._live().where(F.col("seq") > seq).select("id", "vector")
        if self.index == "hnsw":
            asked = self.engine.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, q array<double>")
            out = graph_index.search_graphs(built, asked, k + n_dead, self.metric, max(nprobe or graph_index.EF, k + n_dead)).select("id", "distance", "score")
            out = out.join(F.broadcast(dead), "id", "left_anti") if dead is not None else out
        else:
            out = built.search(query, k, nprobe or cluster.NPROBE, dead)
        return knn.merge_results(out, knn.flat_knn(new, query, k, self.metric), k) if new is not None else out.orderBy("distance", "id").limit(max(0, k))

    def batch_search(self, queries: DataFrame, k: int = 10, filter: Mapping[str, Any] | None = None) -> DataFrame:
        return knn.batch_knn(self._filtered(filter), queries, k, self.metric)

    def hybrid_search(self, text: str, query: Sequence[float], k: int = 10, filter: Mapping[str, Any] | None = None) -> DataFrame:
        rows = self._filtered(filter)
        return fusion.hybrid(knn.flat_knn(rows, query, k, self.metric), sparse.bm25(rows, text, k), k)

    def describe(self) -> dict:
        return json.loads(json.dumps({"id": self.id, "name": self.name, "dimension": self.dimension, "metric": self.metric, "index": self.index, "tenant": self.tenant, "database": self.database}))
