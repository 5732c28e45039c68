import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry import errors
from skerry.api import Engine
from skerry.functions import distance as D
from skerry.operators import catalog, cluster, fusion, graph_index, knn, monitor, oplog, sparse
from skerry.operators import quantize as Q
from skerry.sources import tables
from skerry.streaming import fold as stream


def rows(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [-3.0, -4.0])], "a array<double>, z array<double>, n array<double>")
    r = df.select(D.l2_squared(F.col("a"), F.col("z")), D.l2(F.col("a"), F.col("z")), D.cosine(F.col("a"), F.col("z")), D.cosine(F.col("a"), F.col("n")), D.cosine(F.col("a"), F.col("a")), D.dot_distance(F.col("a"), F.col("n")), D.manhattan(F.col("a"), F.col("z")), D.normalize(F.col("a")), D.normalize(F.col("z"))).first()
    assert list(r) == [25.0, 5.0, 1.0, 2.0, 0.0, 25.0, 7.0, [0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(ValueError, match="l2, cosine, dot, manhattan"):
        D.metric("hamming")
    s = spark.range(1).select(*(D.score(F.lit(4.0), m) for m in ("l2", "cosine", "dot", "manhattan", "x"))).first()
    assert list(s) == [1 / 3, 0.0, -1.5, 0.2, 0.0]


@pytest.mark.parametrize("metric", list(D.METRICS))
def test_batch_equals_single(spark, metric):
    x = np.random.default_rng(1).standard_normal((120, 7))
    x[5], x[6] = 0, x[7]
    v = rows(spark, x)
    q = v.where("id in (5, 7)").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    batch = {(r.qid, r.rank): (r.id, r.distance, r.score) for r in knn.batch_knn(v, q, 9, metric).collect()}
    for qid in (5, 7):
        for i, r in enumerate(knn.flat_knn(v, x[qid].tolist(), 9, metric).collect()):
            assert batch[qid, i + 1] == (r.id, r.distance, r.score)


def test_top_k_edges(spark):
    v = rows(spark, [[1, 0], [0, 1], [1, 0], [0, 1]])
    assert [r.id for r in knn.flat_knn(v, [0, 0], 3).collect()] == [0, 1, 2]
    assert knn.flat_knn(v, [0, 0], 0).count() == knn.flat_knn(v, [0, 0], -1).count() == knn.flat_knn(v.limit(0), [0, 0]).count() == 0
    assert knn.flat_knn(v, [0, 0], 99).count() == 4
    with pytest.raises(errors.DimensionMismatch):
        knn.flat_knn(v, [0], 3, dim=2)


def test_graph_recall(spark):
    x, q = np.random.default_rng(42).random((1000, 128)), np.random.default_rng(99).random((100, 128))
    v = rows(spark, x)
    asked = rows(spark, q).select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    found = graph_index.search_graphs(graph_index.build_graphs(v), asked, 10)
    recall = knn.recall_at_k(knn.batch_knn(v, asked, 10), found).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_ivf_with_all_cells_is_exact(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((300, 16))
    v = rows(spark, x)
    want = [(r.id, r.distance) for r in knn.flat_knn(v, x[9].tolist()).collect()]
    for index in (cluster.build_ivf(v, 12, path=str(tmp_path / "ivf")), cluster.build_posting_lists(v, 12)):
        assert [(r.id, r.distance) for r in index.search(x[9].tolist(), nprobe=12).collect()] == want
        assert index.search(x[9].tolist(), nprobe=1).count() <= 10
    pq = cluster.build_ivf(v, 12, parts=8, codewords=32)
    assert pq.search(x[9].tolist(), nprobe=12).first().id == 9
    assert len(cluster.kmeans(rows(spark, x[:5]), 12)) == 5
    with pytest.raises(errors.DimensionMismatch):
        Q.pq_train(rows(spark, x[:, :15]), 8)


def test_sq8_edges(spark):
    v = rows(spark, [[0, 5], [255, 5], [0.5, 5]])
    m = Q.sq8_model(Q.sq8_train(v))
    assert [list(r[0]) for r in v.select(Q.sq8_encode(F.col("vector"), m)).collect()] == [[0, 0], [255, 0], [1, 0]]
    assert list(rows(spark, [[999, -9]]).select(Q.sq8_encode(F.col("vector"), m)).first()[0]) == [255, 0]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "the of and"), (2, "cat cat dog"), (3, "é 数 x dog"), (4, ""), (5, None)], "id long, document string")
    assert sparse.corpus_stats(docs).first().n == 3
    assert sparse.bm25(docs, "the").count() == 0 and sparse.bm25(docs, "absent").count() == 0
    once, twice = (sparse.bm25(docs, q).first().score for q in ("cat", "cat cat"))
    assert twice == 2 * once
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert math.isclose(once, idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (6 / 3))))
    assert {r.id for r in sparse.bm25(docs, "数 é").collect()} == {3}


def test_rrf_edges(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.score for r in fusion.rrf([a, b], k=-1, weights=[1.0]).collect()}
    assert got == {1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}
    assert [r.id for r in fusion.rrf([a, b], top=1).collect()] == [2]


op = st.tuples(st.sampled_from("ID"), st.integers(0, 3))


def replay(log):
    live = {}
    for seq, (kind, i) in enumerate(log, 1):
        if kind == "I":
            live.setdefault(i, seq)
        else:
            live.pop(i, None)
    return live


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(log=st.lists(op, max_size=25), cut=st.integers(0, 25))
def test_fold_is_replay(spark, log, cut):
    df = spark.createDataFrame([(s, k, i, float(s)) for s, (k, i) in enumerate(log, 1)], "seq long, op string, id long, value double")
    assert {r.id: r.seq for r in oplog.fold(df).collect()} == replay(log)
    snapshot = oplog.fold(df.where(F.col("seq") <= cut))
    assert {r.id: r.seq for r in oplog.fold_on_snapshot(snapshot, df, cut).collect()} == replay(log)


def test_stream_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    log = [("ID"[int(rng.random() < 0.3)], int(i)) for i in rng.integers(0, 9, 200)]
    df = spark.createDataFrame([(s, k, i, float(s)) for s, (k, i) in enumerate(log, 1)], "seq long, op string, id long, value double")
    for i in rng.permutation(5):
        df.where(F.col("seq") % 5 == int(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ops = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {r.id: r.seq for r in stream.run_available(ops).collect()} == replay(log)


def test_log_folders(spark, tmp_path):
    df = spark.createDataFrame([(s, "I", s) for s in (1, 4095, 4096, 9000)], "seq long, op string, id long")
    oplog.append(df, str(tmp_path))
    assert sorted(r.seq for r in oplog.read_since(spark, str(tmp_path), 4095).collect()) == [4096, 9000]
    assert not oplog.truncated(df, 0) and oplog.truncated(df.where("seq > 4000"), 7)


def test_sources(spark, tmp_path):
    x = np.array([[1.5, -2.5, 3.14159, 0, 100], [0, 1, 2, 3, 4]], dtype=np.float32)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<float>")
    back = df.select(tables.decode_blob(tables.encode_blob("v")).alias("v")).collect()
    assert [r.v for r in back] == [r.tolist() for r in x]
    (tmp_path / "a.seg").write_bytes(tables.write_segment(x))
    assert [r.vector for r in tables.read_segments(spark, str(tmp_path / "a.seg")).orderBy("row").collect()] == [r.tolist() for r in x]
    broken = bytearray(tables.write_segment(x))
    broken[-1] ^= 1
    with pytest.raises(errors.IntegrityFailure):
        tables.read_segment(bytes(broken))
    with pytest.raises(errors.CorruptedFile):
        tables.read_segment(b"nothing")
    for name in ("b.png", "a.JPG", "c.txt"):
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / "img" / name).write_bytes(name.encode())
    images = tables.read_images(spark, str(tmp_path / "img")).withColumn("v", tables.hash_embedder(8)("content")).orderBy("id").collect()
    assert [r.filename for r in images] == ["a.JPG", "b.png"] and math.isclose(float(np.linalg.norm(images[0].v)), 1, rel_tol=1e-5)


def test_metadata_limits(spark):
    maps = [{f"k{i}": "v" for i in range(n)} for n in (50, 51)] + [{"k" * 65: "v"}, {"bad key": "v"}, {"k": "é" * 512}, {"k": "é" * 513}]
    df = spark.createDataFrame(list(enumerate(maps)), "id int, metadata map<string,string>")
    assert {r.id: r.error for r in catalog.metadata_errors(df).collect()} == {1: "too many keys", 2: "bad key", 3: "bad key", 5: "value too long"}


def test_phi(spark):
    beats = [("a", float(t)) for t in range(20)] + [("b", 0.0), ("b", 1.0)]
    df = spark.createDataFrame(beats, "node string, t double")
    got = {r.node: r for r in monitor.phi_accrual(df, 29.0).collect()}
    assert math.isclose(got["a"].phi, 10 / math.log(10)) and got["a"].state == "suspect"
    assert got["b"].phi is None and got["b"].state == "dead"


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.create_tenant("t", max_databases=1, max_collections=2)
    e.create_database("t", "d")
    with pytest.raises(errors.QuotaExceeded):
        e.create_database("t", "d2")
    c = e.create_collection("c", 2, tenant="t", database="d")
    with pytest.raises(errors.DuplicateID):
        e.create_collection("c", 2, tenant="t", database="d")
    with pytest.raises(errors.CollectionNotFound):
        e.get_collection(c.id)
    with pytest.raises(errors.TenantNotFound):
        e.list_collections("nobody")
    c.insert([(1, [0, 0], "red cat", '{"n": 10}'), (2, [1, 0], "blue dog", '{"n": 9}'), (3, [5, 5])])
    c.insert([(1, [9, 9])])  # the first insert stays
    assert [(r.id, r.distance) for r in c.search([0, 0], 2).collect()] == [(1, 0.0), (2, 1.0)]
    assert [r.id for r in c.search([0, 0], filter={"n": {"$gt": 9}}).collect()] == [1]
    assert c.hybrid_search("dog", [0.0, 0.0], 2).first().id == 2
    assert {r.id: r.document for r in c.search([0, 0], 1, with_metadata=True).collect()} == {1: "red cat"}
    f = e.fork("c", "copy", tenant="t")
    c.delete([1])
    c.insert([(1, [7, 7])])
    assert c.get(1).first().vector == [7, 7] and f.get(1).first().vector == [0, 0] and f.count() == 3
    with pytest.raises(errors.QuotaExceeded):
        e.create_collection("third", 2, tenant="t", database="d")
    with pytest.raises(errors.DimensionMismatch):
        c.insert([(8, [1, 2, 3])])
    with pytest.raises(errors.DimensionMismatch):
        c.search([1])
    e.delete_collection("c", tenant="t")
    with pytest.raises(errors.CollectionNotFound):
        e.get_collection("c", tenant="t")


@pytest.mark.parametrize("index", ["ivf", "hnsw", "spann", "ivfpq"])
def test_engine_indexes(spark, tmp_path, index):
    x = np.random.default_rng(1).standard_normal((60, 8))
    c = Engine(spark, f"file://{tmp_path}").create_collection("c", 8, index=index, cells=4)
    c.insert(rows(spark, x))
    c.build_index(str(tmp_path / "index"))
    assert c.search(x[3].tolist(), 3, nprobe=4).first().id == 3


def test_phi_leaves_pauses_out(spark):
    rows = [("a", float(i)) for i in range(12)] + [("a", 1000.0 + i) for i in range(3)] + [("a", 1002.0)]
    got = monitor.phi_accrual(spark.createDataFrame(rows, "node string, t double"), 1007.0).first()
    assert (got.n, got.mean, got.elapsed) == (13, 1.0, 5.0)
    many = [("b", float(i) ** 1.5) for i in range(200)]
    got = monitor.phi_accrual(spark.createDataFrame(many, "node string, t double"), 199.0**1.5).first()
    assert got.n == 100 and math.isclose(got.mean, (199.0**1.5 - 99.0**1.5) / 100)


def test_dedupe_ttl(spark):
    """What is held back does not renew the wait; the bound itself is still held back; hot and null keys; small batches."""
    rows = [("a", 0.0, 1), ("a", 20.0, 2), ("a", 30.0, 3), ("a", 40.0, 4), ("a", 40.0, 5), ("a", None, 6), (None, 5.0, 7), (None, 6.0, 8), ("b", 100.0, 9)]
    rows += [("hot", float(i), i) for i in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        df = spark.createDataFrame(rows, "k string, t double, n long")
        got = sorted((str(r.k), r.t, r.n) for r in monitor.dedupe_ttl(df, ["k"]).collect())
        assert monitor.dedupe_ttl(df.limit(0), ["k"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([("a", 0.0, 1), ("a", 40.0, 4), ("None", 5.0, 7), ("b", 100.0, 9), *(("hot", float(i), i) for i in range(0, 1000, 31))])
