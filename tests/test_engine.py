"""What must outlast an engine: catalogue, log, snapshots, indexes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import errors
from skerry.api import Engine
from skerry.operators import knn, migrate, sparse
from skerry.operators.commitlog import CommitLog
from skerry.sources import tables
from skerry.sources.store import Store


def live(c):
    return {r.id: r.vector for r in c.vectors().collect()}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.names("a") == [] and not s.exists("a/x")
    assert s.put_if_absent("a/x", b"1") and not s.put_if_absent("a/x", b"2") and s.get("a/x") == b"1"
    s.put("a/x", b"\x00\xff")
    s.put("a/b", b"{}")
    assert s.get("a/x") == b"\x00\xff" and s.names("a") == ["b", "x"] and s.get_json("a/b") == {}
    assert s.delete("a") and not s.exists("a/x")


def test_a_second_engine_sees_the_same(spark, tmp_path):
    root = f"file://{tmp_path}"
    a = Engine(spark, root)
    a.create_tenant("t", max_databases=2)
    a.create_database("t", "d")
    c = a.create_collection("c", 2, tenant="t", database="d")
    c.insert([(1, [0, 1]), (2, [1, 0])])
    b = Engine(spark, root)
    assert b.list_tenants() == ["default_tenant", "t"] and b.list_databases("t") == ["d"]
    same = b.get_collection("c", tenant="t")
    same.delete([1])
    same.insert([(3, [5, 5])])
    c.insert([(4, [6, 6])])  # numbers go on after the other engine's
    assert live(c) == live(same) == {2: [1, 0], 3: [5, 5], 4: [6, 6]} and c.head() == 4
    b.create_database("t", "e")
    with pytest.raises(errors.QuotaExceeded):
        a.create_database("t", "f")
    with pytest.raises(errors.DuplicateID):
        a.create_collection("c", 2, tenant="t", database="d")
    a.delete_collection("c", tenant="t")
    with pytest.raises(errors.CollectionNotFound):
        b.get_collection("c", tenant="t")
    a.delete_database("t", "d")
    assert b.list_databases("t") == ["e"]


def test_writers_never_share_a_number(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    a, b = (CommitLog(spark, f"file://{tmp_path}/log", "id long") for _ in range(2))
    head = a.head
    a.head = lambda: 0  # a late reader
    assert [b.append(rows, "I").seq, a.append(rows, "I").seq, b.append(rows, "D").seq] == [1, 2, 3]
    a.head = head
    assert sorted((r.seq, r.op) for r in a.read().collect()) == [(1, "I"), (2, "I"), (3, "D")]
    assert [r.seq for r in a.read(1, 2).collect()] == [2] and a.read(3) is None and a.read(0, None, "D").count() == 1
    with pytest.raises(ValueError):
        a.truncate(2)
    a.write_snapshot(rows, 2)
    assert a.truncate(2) == 2 and a.cursor() == 2 and [r.seq for r in b.read(2).collect()] == [3]
    with pytest.raises(errors.LogTruncated):
        b.read(1)


def test_snapshot_and_truncation(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    c = e.create_collection("c", 1)
    c.insert([(1, [1.0], "one", '{"a": 1}'), (2, [2.0])])
    c.delete([2])
    assert c.snapshot() == 2 and c.truncate() == 2 and live(c) == {1: [1.0]}
    c.insert([(2, [9.0]), (1, [7.0])])
    assert live(c) == {1: [1.0], 2: [9.0]}
    other = Engine(spark, f"file://{tmp_path}").get_collection("c")
    assert live(other) == live(c) and other.get(1).first().document == "one"
    f = e.fork("c", "f")
    c.delete([1])
    e.flush()
    assert c.truncate() == 0  # the fork reads it
    assert live(f) == {1: [1.0], 2: [9.0]} and live(c) == {2: [9.0]}
    f.insert([(3, [3.0])])
    g = e.fork("f", "g")
    f.delete([3])
    assert live(g) == {1: [1.0], 2: [9.0], 3: [3.0]} and live(f) == {1: [1.0], 2: [9.0]}


def test_metadata_changes(spark, tmp_path):
    c = Engine(spark, f"file://{tmp_path}").create_collection("c", 1)
    c.insert([(1, [1.0], None, '{"n": 10, "s": "x"}'), (2, [2.0]), (3, [3.0], None, '{"n": 1}')])
    c.update_metadata([(1, {"n": 11, "t": [1]}), (2, {"n": 5}), (9, {"n": 0})])
    read = lambda: {r.id: r.metadata and json.loads(r.metadata) for r in c.vectors().collect()}
    assert read() == {1: {"n": 11, "s": "x", "t": [1]}, 2: {"n": 5}, 3: {"n": 1}}
    assert [r.id for r in c.search([0.0], filter={"n": {"$gte": 5}}).collect()] == [1, 2]
    c.delete_metadata([1])
    c.update_metadata([(1, {"z": True})])
    c.snapshot()
    c.delete([3])
    c.insert([(3, [4.0], None, '{"n": 2}')])  # a new row has its own metadata
    assert read() == {1: {"z": True}, 2: {"n": 5}, 3: {"n": 2}}


@pytest.mark.parametrize("index", ["ivf", "hnsw", "spann", "ivfpq"])
def test_index_outlasts_writes_and_engines(spark, tmp_path, index):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    e = Engine(spark, f"file://{tmp_path}")
    c = e.create_collection("c", 8, index=index, cells=4)
    c.insert([(i, v.tolist()) for i, v in enumerate(x)])
    c.build_index()
    c.insert([(500, x[3].tolist()), (501, (x[3] + 0.001).tolist()), (4, [0.0] * 8)])
    c.delete([3, 500])
    c.insert([(7, [0.0] * 8)])  # is there: changes nothing
    want = [r.id for r in knn.flat_knn(c.vectors(), x[3].tolist(), 3, c.metric).collect()]
    for engine in (e, Engine(spark, f"file://{tmp_path}")):
        own = engine.get_collection("c")
        assert own.changed_rows() == 6 and own._index()[0] == 1
        assert [r.id for r in own.search(x[3].tolist(), 3, nprobe=4 if index != "hnsw" else 100).collect()] == want and want[0] == 501
    many = [(1000 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((110, 8)))]
    c.insert(many)
    assert c._index()[0] == c.head() and c.changed_rows() == 0  # built again by itself
    assert [r.id for r in c.search(many[5][1], 1, nprobe=4).collect()] == [1005]


def test_quotas_and_usage(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.create_tenant("t", max_vectors=3)
    e.create_database("t", "d")
    c = e.create_collection("c", 2, tenant="t", database="d")
    c.insert([(1, [0, 0]), (2, [1, 1])])
    c.insert([(1, [5, 5]), (3, [2, 2])])  # one of them is there
    with pytest.raises(errors.QuotaExceeded):
        c.insert([(4, [0, 0])])
    assert e.usage("t") == {"databases": 1, "collections": 1, "vectors": 3, "bytes": 24} and e.quotas("t")["max_vectors"] == 3
    with pytest.raises(errors.VectorNotFound):
        c.vector(4)


def test_image_ingest(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for i in range(7):
        (tmp_path / "img" / f"{i}.png").write_bytes(bytes([i] * 9))
    c = Engine(spark, f"file://{tmp_path}/root").create_collection("c", 8)
    assert c.ingest_images(str(tmp_path / "img"), tables.hash_embedder(8), first_id=10) == 7
    assert {r.id: r.document for r in c.vectors().collect()} == {10 + i: f"{i}.png" for i in range(7)}


def test_migration(spark, tmp_path):
    rows = spark.range(2500).repartition(3)

    def send(batch, out=str(tmp_path)):
        import os
        import uuid

        mark = f"{out}/failed-{os.getpid()}"
        if not os.path.exists(mark):  # the first batch of every process fails once
            open(mark, "w").close()
            raise OSError("away")
        with open(f"{out}/{uuid.uuid4().hex}.sent", "w") as f:
            f.write(" ".join(str(r.id) for r in batch))

    assert migrate.migrate(rows, send, batch=400) == 2500
    sent = [p.read_text().split() for p in tmp_path.glob("*.sent")]
    assert sorted(int(i) for x in sent for i in x) == list(range(2500)) and max(len(x) for x in sent) == 400
    tries = []

    def never(batch):
        tries.append(len(batch))
        raise OSError("gone")

    with pytest.raises(OSError):
        migrate.with_retries(never, [1, 2], retries=3, wait=0.0)
    assert tries == [2] * 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hydrate_does_not_shuffle_metadata(spark):
    spark.range(1000).selectExpr("id", "id * 2 as twice").createOrReplaceTempView("m")
    results = spark.createDataFrame([(3, 0.5), (5000, 0.7)], "id long, distance double")
    out = knn.hydrate(results, spark.table("m"))
    assert "SortMergeJoin" not in plan(out) and "Exchange hash" not in plan(out)
    assert {(r.id, r.distance, r.twice) for r in out.collect()} == {(3, 0.5, 6), (5000, 0.7, None)}


def test_keyword_search_reads_texts_once(spark):
    docs = spark.createDataFrame([(i, "red cat " * (i % 5) + "blue dog") for i in range(60)], "id long, document string")
    out = sparse.bm25(docs, "red cat", 10, digits=6)
    assert "limit=10," in plan(out) and "regexp_extract_all" not in plan(out)
    only = sparse.bm25(docs, "red cat", 10, keep=spark.range(30).where("id % 5 = 1"))
    assert [r.id for r in only.collect()] == [1, 6, 11, 16, 21, 26]


def test_residual_codes_are_finer(spark):
    """Codes of what is left after the centroid are nearer to the vectors than codes of whole vectors."""
    from skerry.operators import cluster
    from skerry.operators import quantize as Q

    rng = np.random.default_rng(3)
    x = rng.standard_normal((16, 16))[rng.integers(0, 16, 800)] * 5 + rng.standard_normal((800, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = cluster.build_ivf(df, 16, "l2", parts=4, codewords=16)
    rows = index.lists.orderBy("id").collect()
    back = lambda codes, book: np.concatenate([book[p, c] for p, c in enumerate(codes)])
    residual = np.mean([((index.centroids[r.cid] + back(r.codes, index.codebook) - x[r.id]) ** 2).sum() for r in rows])
    book = Q.pq_fit(x, 4, 16)
    whole = np.mean([((back(c, book) - v) ** 2).sum() for c, v in zip(Q.pq_codes(x, book), x)])
    assert residual < whole / 3
    found = [r.id for r in index.search(x[5].tolist(), 5, 16).collect()]
    assert found == [r.id for r in knn.flat_knn(df, x[5].tolist(), 5).collect()]
    assert index.lists.where(F.size("codes") == 4).count() == 800


def test_segment_table(spark, tmp_path):
    """Committed segments are read whole; files that no manifest names are not; overwriting replaces them."""
    from skerry.sources import segments

    segments.register(spark)
    path = f"{tmp_path}/seg"
    x = np.random.default_rng(1).standard_normal((250, 4)).astype(np.float32)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<float>").repartition(3)
    df.write.format("skerry_segments").option("rows", 40).mode("append").save(path)
    (tmp_path / "seg" / "left.seg").write_bytes(tables.write_segment(x[:5]))
    back = spark.read.format("skerry_segments").load(path)
    assert sorted(tuple(r.vector) for r in back.collect()) == sorted(map(tuple, x.tolist()))
    assert max(r["count"] for r in back.groupBy("segment").count().collect()) <= 40
    df.limit(7).write.format("skerry_segments").mode("append").save(path)
    assert spark.read.format("skerry_segments").load(path).count() == 257
    df.limit(3).write.format("skerry_segments").mode("overwrite").save(path)
    assert spark.read.format("skerry_segments").load(path).count() == 3
    assert len(list((tmp_path / "seg").glob("*.manifest"))) == 1
    assert spark.read.format("skerry_segments").load(f"{tmp_path}/none").count() == 0
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<float>").coalesce(1)
    with pytest.raises(Exception, match="one dimension"):
        mixed.write.format("skerry_segments").mode("append").save(path)
    assert spark.read.format("skerry_segments").load(path).count() == 3
