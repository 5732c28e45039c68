"""Named queries over the test tables, with the DuckDB SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import distance as D
from skerry.functions import placement as P
from skerry.functions.filters import columns_of, compile_filter, json_of
from skerry.functions.text import STOP_WORDS, tokens
from skerry.operators import catalog, cluster, fusion, graph_index, knn, monitor, oplog, sparse
from skerry.operators import quantize as Q
from skerry.operators.commitlog import CommitLog
from skerry.sources import tables
from skerry.streaming import fold as stream

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- tables ---


def vectors(spark: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    """id, vector (doubles), label; ``scaled`` multiplies by label + 1, so that the metrics differ."""
    v = D.vector(F.col("embedding"))
    if scaled:
        v = F.transform(v, lambda x: x * (F.col("label") + 1.0))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), v.alias("vector"), "label")


def vector_of(df: DataFrame, id: int) -> list[float]:
    return df.where(F.col("id") == id).select("vector").first()[0]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the metadata keys lang, source, n_chars, and quality and toxic where labels has them."""
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return docs.join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("doc_id", "id"), "id", "left")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("document"))


def ops(spark: SparkSession, d: str) -> DataFrame:
    """events as an operation log: errors delete, purchases do nothing, the rest insert."""
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type").isin("signup", "click", "view"), "I")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), "value").where("op is not null")


# --- SQL pieces ---

E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
ES = "e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1.0::DOUBLE)) AS v, label FROM embeddings)"


def _zip(a: str, b: str, f: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: {f}), lambda p, x: p + x)"


def s_l2(a: str, b: str) -> str:
    return _zip(a, b, "(z[1] - z[2]) * (z[1] - z[2])")


def s_dot(a: str, b: str) -> str:
    return _zip(a, b, "z[1] * z[2]")


def s_l1(a: str, b: str) -> str:
    return _zip(a, b, "abs(z[1] - z[2])")


def s_cos(a: str, b: str) -> str:
    norms = f"({s_dot(a, a)} * {s_dot(b, b)})"
    return f"CASE WHEN {norms} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {s_dot(a, b)} / sqrt({norms}))) END"


S_METRIC = {"l2": s_l2, "cosine": s_cos, "dot": lambda a, b: f"-({s_dot(a, b)})", "manhattan": s_l1}
S_SCORE = {
    "l2": "1.0::DOUBLE / (1.0::DOUBLE + sqrt(distance))",
    "cosine": "greatest(0.0::DOUBLE, 1.0::DOUBLE - distance / 2.0::DOUBLE)",
    "dot": "(1.0::DOUBLE - distance) / 2.0::DOUBLE",
    "manhattan": "1.0::DOUBLE / (1.0::DOUBLE + distance)",
}


def s_knn(metric: str, rows: str = "e", k: int = 10, q: int = 0) -> str:
    return f"SELECT id, distance, {S_SCORE[metric]} AS score FROM (SELECT id, {S_METRIC[metric]('v', f'(SELECT v FROM e WHERE id = {q})')} AS distance FROM {rows}) ORDER BY distance, id LIMIT {k}"


# --- distances and kNN ---

for _m in D.METRICS:
    query(f"knn_{_m}", f"WITH {E} {s_knn(_m)}")(lambda s, d, m=_m: knn.flat_knn(v := vectors(s, d), vector_of(v, 0), 10, m))
    query(f"knn_{_m}_scaled", f"WITH {ES} {s_knn(_m, q=3)}")(lambda s, d, m=_m: knn.flat_knn(v := vectors(s, d, True), vector_of(v, 3), 10, m))
    query(
        f"batch_knn_{_m}",
        f"WITH {ES}, x AS (SELECT q.id AS qid, e.id, {S_METRIC[_m]('q.v', 'e.v')} AS distance FROM e JOIN e q ON q.id % 50 = 0) SELECT qid, id, distance, {S_SCORE[_m]} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM x) WHERE rank <= 10",
    )(lambda s, d, m=_m: knn.batch_knn(v := vectors(s, d, True), v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q")), 10, m))


@query("vector_norms", f"WITH {ES} SELECT id, {s_dot('v', 'v')} AS squared, sqrt({s_dot('v', 'v')}) AS norm FROM e")
def vector_norms(s, d):
    return vectors(s, d, True).select("id", D.squared_norm(F.col("vector")).alias("squared"), F.sqrt(D.squared_norm(F.col("vector"))).alias("norm"))


@query("normalize", f"WITH {ES}, n AS (SELECT id, v, sqrt({s_dot('v', 'v')}) AS n FROM e) SELECT id, unnest(range(0, len(v))) AS pos, unnest(CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda x: x / n) END) AS x FROM n")
def normalize(s, d):
    return vectors(s, d, True).select("id", F.posexplode(D.normalize(F.col("vector"))).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


@query("cosine_similarity", f"WITH {ES} SELECT id, 1.0::DOUBLE - ({s_cos('v', '(SELECT v FROM e WHERE id = 1)')}) AS similarity FROM e")
def cosine_similarity(s, d):
    v = vectors(s, d, True)
    return v.select("id", D.cosine_similarity(F.col("vector"), D.vector(vector_of(v, 1))).alias("similarity"))


@query("l2_true", f"WITH {ES} SELECT id, sqrt({s_l2('v', '(SELECT v FROM e WHERE id = 1)')}) AS distance FROM e")
def l2_true(s, d):
    v = vectors(s, d, True)
    return v.select("id", D.l2(F.col("vector"), D.vector(vector_of(v, 1))).alias("distance"))


@query(
    "score_all_metrics",
    f"WITH {ES}, q AS (SELECT v AS q FROM e WHERE id = 2), x AS (SELECT id, "
    + ", ".join(f"{S_METRIC[m]('v', '(SELECT q FROM q)')} AS d_{m}" for m in D.METRICS)
    + " FROM e) SELECT *, "
    + ", ".join(f"{S_SCORE[m].replace('distance', f'd_{m}')} AS s_{m}" for m in D.METRICS)
    + " FROM x",
)
def score_all_metrics(s, d):
    v = vectors(s, d, True)
    q = D.vector(vector_of(v, 2))
    x = v.select("id", *(D.metric(m)(F.col("vector"), q).alias(f"d_{m}") for m in D.METRICS))
    return x.select("*", *(D.score(F.col(f"d_{m}"), m).alias(f"s_{m}") for m in D.METRICS))


# --- filters ---

M = "m AS (SELECT d.doc_id AS id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
FILTERS = {
    "filter_eq": ({"lang": "fr"}, "coalesce(lang = 'fr', false)"),
    "filter_ne": ({"quality": {"$ne": 1}}, "quality IS NULL OR quality <> 1"),
    "filter_range": ({"n_chars": {"$gte": 500, "$lt": 2000}}, "n_chars >= 500 AND n_chars < 2000"),
    "filter_gt_lte": ({"n_chars": {"$gt": 500, "$lte": 5000}}, "n_chars > 500 AND n_chars <= 5000"),
    "filter_in": ({"source": {"$in": ["src1", "src4"]}}, "coalesce(source IN ('src1', 'src4'), false)"),
    "filter_nin": ({"quality": {"$nin": [0]}}, "quality IS NULL OR quality NOT IN (0)"),
    "filter_and_or_nested": ({"$and": [{"$or": [{"lang": "de"}, {"lang": "es"}]}, {"n_chars": {"$gt": 800}}, {}]}, "lang IN ('de', 'es') AND n_chars > 800"),
    "filter_or_sibling": ({"lang": "en", "$or": [{"quality": 0}, {"toxic": 1}]}, "lang = 'en' AND (coalesce(quality = 0, false) OR coalesce(toxic = 1, false))"),
    "filter_missing_key": ({"$or": [{"nothing": 3}, {"nothing": {"$ne": 3}, "quality": 1}]}, "coalesce(quality = 1, false)"),
    "filter_unknown_operator": ({"lang": {"$like": "e"}}, "false"),
}
for _n, (_spec, _where) in FILTERS.items():
    query(_n, f"WITH {M} SELECT * FROM m WHERE {_where}")(lambda s, d, spec=_spec: (m := marked(s, d)).where(compile_filter(spec, columns_of(m))))


@query("filter_text_order", f"WITH {M} SELECT * FROM m WHERE n_chars::VARCHAR > '500'")
def filter_text_order(s, d):
    m = marked(s, d)
    return m.where(compile_filter({"n_chars": {"$gt": 500}}, columns_of(m), string_compare=True))


@query("filter_json_props", "SELECT event_id, props FROM events WHERE (props::JSON->>'$.k')::DOUBLE >= 50 AND (props::JSON->>'$.k')::DOUBLE <> 60")
def filter_json_props(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "props")
    return e.where(compile_filter({"k": {"$gte": 50, "$ne": 60}}, json_of(F.col("props"))))


@query("knn_prefilter", f"WITH {E} {s_knn('l2', '(SELECT * FROM e WHERE label IN (1, 2))')}")
def knn_prefilter(s, d):
    v = vectors(s, d)
    return knn.filtered_knn(v, vector_of(v, 0), {"label": {"$in": [1, 2]}})


@query(
    "knn_postfilter",
    f"WITH {E}, t AS (SELECT id, label, {s_l2('v', '(SELECT v FROM e WHERE id = 0)')} AS distance FROM e ORDER BY distance, id LIMIT (SELECT greatest(50, least(100, count(*))) FROM e)) SELECT id, distance, {S_SCORE['l2']} AS score FROM t WHERE label = 3 ORDER BY distance, id LIMIT 10",
)
def knn_postfilter(s, d):
    v = vectors(s, d)
    return knn.filtered_knn(v, vector_of(v, 0), {"label": 3}, mode="post")


@query("knn_hydrate", f"WITH {E}, r AS ({s_knn('cosine')}) SELECT r.id, distance, score, lang, source FROM r LEFT JOIN documents ON doc_id = r.id")
def knn_hydrate(s, d):
    v = vectors(s, d)
    meta = documents(s, d).select(F.col("doc_id").alias("id"), "lang", "source")
    return knn.hydrate(knn.flat_knn(v, vector_of(v, 0), 10, "cosine"), meta).select("id", "distance", "score", "lang", "source")


@query("scatter_gather", f"WITH {E} {s_knn('l2')}")
def scatter_gather(s, d):
    v = vectors(s, d)
    return knn.scatter_gather(v, vector_of(v, 0), 10, F.col("id") % 4, 4)


@query("merge_results_dedup", f"WITH {E}, a AS ({s_knn('l2', '(SELECT * FROM e WHERE id % 2 = 0)')}), b AS ({s_knn('l2', '(SELECT * FROM e WHERE id % 3 = 0)')}) SELECT id, distance, score FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)) ORDER BY distance, id LIMIT 10")
def merge_results(s, d):
    v = vectors(s, d)
    q = vector_of(v, 0)
    return knn.merge_results(knn.flat_knn(v.where("id % 2 = 0"), q), knn.flat_knn(v.where("id % 3 = 0"), q), 10)


@query(
    "recall_at_k",
    f"WITH {E}, x AS (SELECT q.id AS qid, e.id, e.label, {s_l2('q.v', 'e.v')} AS distance FROM e JOIN e q ON q.id % 50 = 0), t AS (SELECT qid, id FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 10), f AS (SELECT qid, id FROM x WHERE label < 7 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 10) SELECT t.qid, count(f.id)::DOUBLE / count(*) AS recall FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id GROUP BY t.qid",
)
def recall_at_k(s, d):
    v = vectors(s, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    return knn.recall_at_k(knn.batch_knn(v, q), knn.batch_knn(v.where("label < 7"), q))


@query("point_lookup", f"WITH {E} SELECT id, label, v[1] AS first FROM e WHERE id = 17")
def point_lookup(s, d):
    return vectors(s, d).where("id = 17").select("id", "label", F.col("vector")[0].alias("first"))


# --- keyword search ---

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOK = f"tok AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains({STOP}, w)) AS t FROM documents WHERE text IS NOT NULL AND text <> '')"
POST = f"{TOK}, post AS (SELECT id, len(t) AS dl, w AS term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS w FROM tok) GROUP BY ALL)"


def s_bm25(words: list[str], k: int = 10) -> str:
    terms = ", ".join(f"('{w}')" for w in words)
    return f"""SELECT id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM post JOIN (VALUES {terms}) q(term) USING (term) JOIN (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term) USING (term), (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok)
    GROUP BY id ORDER BY score DESC, id LIMIT {k}"""


TERMS = "thand erthe tionre thand ouble"


def _bm25(s, d, words: str = TERMS, k: int = 10) -> DataFrame:
    """Rounded scores order the list, as in the SQL."""
    return sparse.bm25(texts(s, d), words, k, digits=6)


@query("tokenize_counts", f"WITH {TOK} SELECT id, len(t) AS n_tokens FROM tok")
def tokenize_counts(s, d):
    return texts(s, d).where("document <> ''").select("id", F.size(tokens(F.col("document"))).cast("long").alias("n_tokens"))


@query("term_df", f"WITH {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def term_df(s, d):
    return sparse.document_frequency(texts(s, d))


@query("doc_len_stats", f"WITH {TOK} SELECT count(*) AS n, round(avg(len(t)), 9) AS avgdl FROM tok")
def doc_len_stats(s, d):
    return sparse.corpus_stats(texts(s, d)).select("n", F.round("avgdl", 9).alias("avgdl"))


@query("vocab_size", f"WITH {POST} SELECT count(DISTINCT term) AS terms FROM post")
def vocab_size(s, d):
    return sparse.vocabulary_size(texts(s, d))


query("bm25_search", f"WITH {POST} {s_bm25(['thand', 'ouble', 'tionre'])}")(lambda s, d: _bm25(s, d, "Thand ouble, the tionre"))
query("bm25_repeated_term", f"WITH {POST} {s_bm25(TERMS.split())}")(lambda s, d: _bm25(s, d))


@query("bm25_idf", f"WITH {POST} SELECT term, round(ln(1.0::DOUBLE + ((SELECT count(*) FROM tok) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 9) AS idf FROM post GROUP BY term")
def bm25_idf(s, d):
    n = sparse.corpus_stats(texts(s, d)).select("n")
    df = sparse.document_frequency(texts(s, d)).crossJoin(F.broadcast(n))
    return df.select("term", F.round(sparse.idf(F.col("n"), F.col("df")), 9).alias("idf"))


# --- fusion ---


def _dense(s, d, k: int = 20) -> DataFrame:
    v = vectors(s, d)
    return knn.flat_knn(v, vector_of(v, 0), k, "cosine")


S_LISTS = f"WITH {E}, {POST}, dn AS ({s_knn('cosine', k=20)}), sp AS ({s_bm25(TERMS.split(), 20)}), a AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM dn), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM sp)"


def s_fuse(wa: str = "1.0", wb: str = "1.0") -> str:
    return f"SELECT coalesce(a.id, b.id) AS id, 0.0::DOUBLE + coalesce({wa}::DOUBLE / (60.0::DOUBLE + a.r), 0.0::DOUBLE) + coalesce({wb}::DOUBLE / (60.0::DOUBLE + b.r), 0.0::DOUBLE) AS score FROM a FULL OUTER JOIN b ON a.id = b.id"


def _lists(s, d) -> list[DataFrame]:
    return [fusion.with_rank(_dense(s, d), "distance", "id"), fusion.with_rank(_bm25(s, d, k=20), F.desc("score"), "id")]


query("rrf", f"{S_LISTS} {s_fuse()}")(lambda s, d: fusion.rrf(_lists(s, d)))
query("weighted_rrf", f"{S_LISTS} {s_fuse('0.7', '0.3')}")(lambda s, d: fusion.rrf(_lists(s, d), weights=[0.7, 0.3]))
query("rrf_topk", f"{S_LISTS} {s_fuse()} ORDER BY score DESC, id LIMIT 5")(lambda s, d: fusion.rrf(_lists(s, d), k=0, weights=[1.0], top=5))
query("hybrid", f"{S_LISTS} SELECT id, 0.0::DOUBLE AS distance, score FROM ({s_fuse()}) ORDER BY score DESC, id LIMIT 10")(lambda s, d: fusion.hybrid(_dense(s, d), _bm25(s, d, k=20), 10))


@query(
    "hybrid_filtered",
    f"WITH {E}, {POST}, f AS (SELECT doc_id FROM documents WHERE lang = 'en'), dn AS ({s_knn('cosine', '(SELECT * FROM e WHERE id IN (SELECT doc_id FROM f))')}), sp AS (SELECT * FROM ({s_bm25(TERMS.split(), 100000000)}) WHERE id IN (SELECT doc_id FROM f) ORDER BY score DESC, id LIMIT 10), a AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM dn), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM sp) SELECT id, 0.0::DOUBLE AS distance, score FROM ({s_fuse()}) ORDER BY score DESC, id LIMIT 10",
)
def hybrid_filtered(s, d):
    docs = documents(s, d)
    keep = docs.where(compile_filter({"lang": "en"}, columns_of(docs))).select(F.col("doc_id").alias("id"))
    v = vectors(s, d)
    dense = knn.flat_knn(v.join(keep, "id", "left_semi"), vector_of(v, 0), 10, "cosine")
    words = sparse.bm25(texts(s, d), TERMS, 10, digits=6, keep=keep)
    return fusion.hybrid(dense, words, 10)


# --- quantisation ---

SQ = "tr AS (SELECT pos, min(x) AS low, (max(x) - min(x)) / 255.0::DOUBLE AS scale FROM (SELECT unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM e) GROUP BY pos), md AS (SELECT list(low ORDER BY pos) AS low, list(scale ORDER BY pos) AS scale FROM tr)"
S_CODES = "list_transform(list_zip(v, low, scale), lambda z: CASE WHEN z[3] = 0 THEN 0 ELSE greatest(0, least(255, round((z[1] - z[2]) / z[3]))) END::SMALLINT)"
S_DECODED = "list_transform(list_zip(codes, low, scale), lambda z: z[2] + z[1] * z[3])"
SQC = f"{SQ}, c AS (SELECT id, v, low, scale, {S_CODES} AS codes FROM e, md), dc AS (SELECT id, v, {S_DECODED} AS w FROM c)"


@query("sq8_train", f"WITH {ES}, {SQ} SELECT pos, low, scale FROM tr")
def sq8_train(s, d):
    return Q.sq8_train(vectors(s, d, True)).withColumn("pos", F.col("pos").cast("long"))


@query("sq8_codes", f"WITH {ES}, {SQC} SELECT id, unnest(range(0, len(codes))) AS pos, unnest(codes)::BIGINT AS code FROM c")
def sq8_codes(s, d):
    v = vectors(s, d, True)
    m = Q.sq8_model(Q.sq8_train(v))
    return v.select("id", F.posexplode(Q.sq8_encode(F.col("vector"), m)).alias("pos", "code")).select("id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


@query("sq8_roundtrip_error", f"WITH {ES}, {SQC} SELECT id, {s_l2('v', 'w')} AS error FROM dc")
def sq8_roundtrip_error(s, d):
    v = vectors(s, d, True)
    m = Q.sq8_model(Q.sq8_train(v))
    return v.select("id", D.l2_squared(F.col("vector"), Q.sq8_decode(Q.sq8_encode(F.col("vector"), m), m)).alias("error"))


@query("sq8_search", f"WITH {ES}, {SQC} SELECT id, {s_l2('(SELECT v FROM e WHERE id = 0)', 'w')} AS distance FROM dc ORDER BY distance, id LIMIT 10")
def sq8_search(s, d):
    v = vectors(s, d, True)
    m, q = Q.sq8_model(Q.sq8_train(v)), vector_of(v, 0)
    return v.select("id", Q.sq8_distance(q, Q.sq8_encode(F.col("vector"), m), m).alias("distance")).orderBy("distance", "id").limit(10)


@query("sq8_rerank", f"WITH {ES}, {SQC}, t AS (SELECT id FROM dc ORDER BY {s_l2('(SELECT v FROM e WHERE id = 0)', 'w')}, id LIMIT 100) SELECT id, {s_l2('v', '(SELECT v FROM e WHERE id = 0)')} AS distance FROM e WHERE id IN (SELECT id FROM t) ORDER BY distance, id LIMIT 10")
def sq8_rerank(s, d):
    v = vectors(s, d, True)
    m, q = Q.sq8_model(Q.sq8_train(v)), vector_of(v, 0)
    codes = v.select("id", Q.sq8_encode(F.col("vector"), m).alias("codes"))
    return Q.quantized_search(codes, Q.sq8_distance(q, F.col("codes"), m), v, q, 10)


# The fixed codebook: eight parts of the first 16 vectors.
S_BOOK = "bk AS (SELECT p, id AS c, v[p * 8 + 1:p * 8 + 8] AS w FROM e, (SELECT unnest(range(0, 8)) AS p) WHERE id < 16)"
S_PQ = f"{S_BOOK}, pq AS (SELECT e.id, p, arg_min(c, (x, c)) AS code FROM (SELECT e.id, p, c, {s_l2('e.v[p * 8 + 1:p * 8 + 8]', 'w')} AS x FROM e, bk) e GROUP BY e.id, p)"


def _book(v: DataFrame) -> np.ndarray:
    x = np.array([r.vector for r in v.where("id < 16").orderBy("id").select("vector").collect()])
    return x.reshape(16, 8, 8).transpose(1, 0, 2)


@query("pq_encode_fixed_codebook", f"WITH {ES}, {S_PQ} SELECT id, p::BIGINT AS part, code::BIGINT AS code FROM pq")
def pq_encode(s, d):
    v = vectors(s, d, True)
    return Q.pq_encode(v, _book(v)).select("id", F.posexplode("codes").alias("part", "code")).select("id", F.col("part").cast("long").alias("part"), F.col("code").cast("long").alias("code"))


@query("pq_adc", f"WITH {ES}, {S_PQ}, q AS (SELECT v AS q FROM e WHERE id = 30), a AS (SELECT pq.id, p, {s_l2('q[p * 8 + 1:p * 8 + 8]', 'w')} AS x FROM pq JOIN bk USING (p), q WHERE bk.c = pq.code) SELECT id, list_reduce(list(x ORDER BY p), lambda m, n: m + n) AS distance FROM a GROUP BY id ORDER BY distance, id LIMIT 20")
def pq_adc(s, d):
    v = vectors(s, d, True)
    book = _book(v)
    return Q.pq_encode(v, book).select("id", Q.pq_distance(F.col("codes"), Q.pq_table(vector_of(v, 30), book)).alias("distance")).orderBy("distance", "id").limit(20)


@query("pq_decode", f"WITH {ES}, {S_PQ} SELECT pq.id, (p * 8 + j)::BIGINT AS pos, w[j + 1] AS x FROM pq JOIN bk USING (p), (SELECT unnest(range(0, 8)) AS j) WHERE bk.c = pq.code")
def pq_decode(s, d):
    v = vectors(s, d, True)
    book = _book(v)
    return Q.pq_encode(v, book).select("id", F.posexplode(Q.pq_decode(F.col("codes"), book)).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


@query("compression_ratio", "SELECT 4.0::DOUBLE AS sq8, 32.0::DOUBLE AS pq")
def compression_ratio(s, d):
    return s.range(1).select(F.lit(Q.SQ8_COMPRESSION).alias("sq8"), F.lit(Q.pq_compression(64, 8)).alias("pq"))


# --- clustering and indexes ---

S_ASSIGN = f"ce AS (SELECT id AS cid, v AS c FROM e WHERE id < 16), asg AS (SELECT id, arg_min(cid, (x, cid)) AS cid FROM (SELECT e.id, cid, {s_l2('v', 'c')} AS x FROM e, ce) GROUP BY id)"


@query("kmeans_assign", f"WITH {E}, {S_ASSIGN} SELECT id, cid::BIGINT AS cid FROM asg")
def kmeans_assign(s, d):
    v = vectors(s, d)
    return cluster.assign(v, cluster.first_centroids(v, 16)).select("id", F.col("cid").cast("long").alias("cid"))


@query("kmeans_one_lloyd_step", f"WITH {E}, {S_ASSIGN} SELECT cid::BIGINT AS cid, pos, round(avg(x), 9) AS mean, count(*) AS size FROM (SELECT cid, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM asg JOIN e USING (id)) GROUP BY ALL")
def kmeans_step(s, d):
    v = vectors(s, d)
    out = cluster.means(cluster.assign(v, cluster.first_centroids(v, 16)))
    return out.select(F.col("cid").cast("long").alias("cid"), F.col("pos").cast("long").alias("pos"), F.round("mean", 9).alias("mean"), "size")


def s_probe(nprobe: int) -> str:
    return f"WITH {E}, {S_ASSIGN}, pr AS (SELECT cid FROM ce ORDER BY {s_l2('c', '(SELECT v FROM e WHERE id = 40)')}, cid LIMIT {nprobe}) {s_knn('l2', '(SELECT e.* FROM e JOIN asg USING (id) WHERE cid IN (SELECT cid FROM pr))', q=40)}"


def _fixed_ivf(s, d) -> tuple[DataFrame, cluster.IvfIndex]:
    v = vectors(s, d)
    c = cluster.first_centroids(v, 16)
    return v, cluster.IvfIndex(c, cluster.assign(v, c))


@query("ivf_probe", s_probe(4))
def ivf_probe(s, d):
    v, index = _fixed_ivf(s, d)
    return index.search(vector_of(v, 40), 10, 4)


@query("ivf_buffer", f"WITH {E} {s_knn('l2', q=40)}")
def ivf_buffer(s, d):
    v = vectors(s, d)
    c = cluster.first_centroids(v, 16)
    index = cluster.IvfIndex(c, cluster.assign(v.where("id % 5 > 0"), c), buffer=v.where("id % 5 = 0"))
    return index.search(vector_of(v, 40), 10, 16)


@query("spann_probe", s_probe(6))
def spann_probe(s, d):
    v, index = _fixed_ivf(s, d)
    return index.search(vector_of(v, 40), 10, 6)


@query(
    "ivf_batch",
    f"WITH {E}, {S_ASSIGN}, pr AS (SELECT q.id AS qid, q.v AS q, cid FROM e q, ce WHERE q.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {s_l2('q.v', 'c')}, cid) <= 4), x AS (SELECT qid, e.id, {s_l2('e.v', 'q')} AS distance FROM pr JOIN asg USING (cid) JOIN e USING (id)) SELECT qid, id, distance, {S_SCORE['l2']} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM x) WHERE rank <= 10",
)
def ivf_batch(s, d):
    v, index = _fixed_ivf(s, d)
    return cluster.ivf_batch(index, v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q")), 10, 4)


_indexes: dict[tuple[str, str, str], object] = {}


def _once(s, d: str, name: str, build: Callable[[], object]):
    """An index over a folder's tables, built (and written) once an application: searches don't pay for it."""
    key = s.sparkContext.applicationId, d, name
    if key not in _indexes:
        _indexes[key] = build()
    return _indexes[key]


def _ivfpq(s, d) -> cluster.IvfIndex:
    path = f"{tables.shared_dir(s)}/skerry-ivfpq-{uuid.uuid4().hex}"
    return _once(s, d, "ivfpq", lambda: cluster.build_ivf(vectors(s, d), 16, "l2", parts=8, codewords=64, path=path))


def _graphs(s, d) -> DataFrame:
    return _once(s, d, "hnsw", lambda: tables.written(graph_index.build_graphs(vectors(s, d))))


def _asked(s, d) -> DataFrame:
    return vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))


@query("kmeans_trained", "SELECT vec_id AS id, true AS nearest FROM embeddings")
def kmeans_trained(s, d):
    """A law of trained cells: every row is in the cell of its nearest centroid."""
    v = vectors(s, d)
    c = cluster.kmeans(v, 16)
    distances = F.array(*(D.l2_squared(F.col("vector"), D.vector(x.tolist())) for x in c))
    return cluster.assign(v, c).select("id", (F.array_position(distances, F.array_min(distances)) == F.col("cid") + 1).alias("nearest"))


@query("ivfpq_search")
def ivfpq_search(s, d):
    return _ivfpq(s, d).search(vector_of(vectors(s, d), 40), 10, 8)


@query("hnsw_search")
def hnsw_search(s, d):
    return graph_index.search_graphs(_graphs(s, d), _asked(s, d), 10)


S_RECALL = "SELECT count(*) AS queries, true AS recall_is_enough FROM embeddings WHERE vec_id % 50 = 0"


@query("hnsw_recall", S_RECALL)
def hnsw_recall(s, d):
    """Mean recall at 10 of the graph search against the exact one is 0.9 or more."""
    found = knn.recall_at_k(knn.batch_knn(vectors(s, d), _asked(s, d)), graph_index.search_graphs(_graphs(s, d), _asked(s, d), 10))
    return found.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_is_enough"))


@query("ivfpq_recall", "SELECT 5::BIGINT AS queries, true AS recall_is_enough")
def ivfpq_recall(s, d):
    """Mean recall at 10 of the coded search of all cells, for five queries, is 0.9 or more."""
    v, index, found = vectors(s, d), _ivfpq(s, d), None
    ids = [0, 40, 80, 120, 160]
    for i in ids:
        one = index.search(vector_of(v, i), 10, 16).select(F.lit(i).cast("long").alias("qid"), "id")
        found = one if found is None else found.unionAll(one)
    truth = knn.batch_knn(v, v.where(F.col("id").isin(ids)).select(F.col("id").alias("qid"), F.col("vector").alias("q")))
    return knn.recall_at_k(truth, found).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_is_enough"))


# --- operation log ---

S_OPS = "o AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op, user_id AS id, value FROM events WHERE event_type <> 'purchase'), ld AS (SELECT id, max(seq) AS last FROM o WHERE op = 'D' GROUP BY id)"
S_FOLD = f"WITH {S_OPS} SELECT id, min(seq) AS seq, arg_min(value, seq) AS value FROM o LEFT JOIN ld USING (id) WHERE op = 'I' AND (last IS NULL OR seq > last) GROUP BY id"
query("oplog_fold", S_FOLD)(lambda s, d: oplog.fold(ops(s, d)))
query("oplog_since", f"WITH {S_OPS} SELECT * FROM o WHERE seq > 500")(lambda s, d: oplog.since(ops(s, d), 500))
query("oplog_max_seq", f"WITH {S_OPS} SELECT coalesce(max(seq), 0) AS max_seq FROM o")(lambda s, d: oplog.max_seq(ops(s, d)))
query("live_count", f"SELECT count(*) AS n FROM ({S_FOLD})")(lambda s, d: oplog.fold(ops(s, d)).agg(F.count("*").alias("n")))


@query("oplog_snapshot_tail", S_FOLD)
def oplog_snapshot_tail(s, d):
    o = ops(s, d)
    return oplog.fold_on_snapshot(oplog.fold(o.where("seq <= 400")), o, 400)


@query("commit_log", S_FOLD)
def commit_log(s, d):
    """The log in three batches with a snapshot after the first, truncated to it, and folded."""
    o = ops(s, d)
    log = CommitLog(s, f"{tables.shared_dir(s)}/skerry-log-{uuid.uuid4().hex}", "at long, op_ string, id long, value double")
    n = o.agg(F.max("seq")).first()[0]
    rows = o.select(F.col("seq").alias("at"), F.col("op").alias("op_"), "id", "value")
    log.append(rows.where(f"at <= {n // 3}"), "B")
    plain = lambda df: df.select(F.col("at").alias("seq"), F.col("op_").alias("op"), "id", "value")
    log.write_snapshot(oplog.fold(plain(log.read())), log.head())
    log.append(rows.where(f"at > {n // 3} and at <= {n // 2}"), "B")
    log.append(rows.where(f"at > {n // 2}"), "B")
    log.truncate(1)
    seq, snapshot = log.read_snapshot()
    return oplog.fold_on_snapshot(snapshot, plain(log.read(seq)), n // 3)


@query("tombstone_antijoin", f"WITH {E} SELECT id, label FROM e WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def tombstone_antijoin(s, d):
    dead = s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return knn.delete(vectors(s, d), dead).select("id", "label")


@query("log_buckets", "SELECT (event_id // 4096) * 4096 AS bucket, count(*) AS n FROM events GROUP BY 1")
def log_buckets(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy(oplog.bucket(F.col("event_id")).alias("bucket")).agg(F.count("*").alias("n"))


@query("stream_fold", S_FOLD)
def stream_fold(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern may name a file or a folder
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type").isin("signup", "click", "view"), "I")
    return stream.run_available(e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), "value").where("op is not null"))


# --- catalogue ---


def tenants(s, d) -> DataFrame:
    return documents(s, d).select(F.col("doc_id").alias("id"), F.col("source").alias("tenant"), F.col("lang").alias("database"), "n_chars")


query("catalog_counts", "SELECT source AS tenant, lang AS \"database\", count(*) AS n FROM documents GROUP BY ALL")(lambda s, d: catalog.counts(tenants(s, d), "tenant", "database"))
query("tenant_scope", "SELECT doc_id AS id, source AS tenant, lang AS \"database\", n_chars FROM documents WHERE source = 'src3' AND lang = 'en'")(lambda s, d: catalog.scope(tenants(s, d), "src3", "en"))


@query("collections_per_tenant", "SELECT t.tenant, count(d.doc_id) AS n FROM (SELECT DISTINCT source AS tenant FROM documents) t LEFT JOIN documents d ON d.source = t.tenant AND d.lang = 'fr' GROUP BY t.tenant")
def collections_per_tenant(s, d):
    t = tenants(s, d)
    return catalog.collections_per_tenant(t.where(F.col("database") == "fr"), t.select("tenant").distinct())


@query("eav_rows", f"WITH {M} SELECT id, k AS meta_key, v AS meta_value FROM (SELECT id, unnest(['lang', 'quality', 'toxic']) AS k, unnest([lang, quality::VARCHAR, toxic::VARCHAR]) AS v FROM m) WHERE v IS NOT NULL")
def eav_rows(s, d):
    return catalog.to_eav(marked(s, d), "lang", "quality", "toxic")


@query("eav_pivot", f"WITH {M} SELECT id, lang, quality::VARCHAR AS quality FROM m WHERE lang IS NOT NULL OR quality IS NOT NULL")
def eav_pivot(s, d):
    m = catalog.from_eav(catalog.to_eav(marked(s, d), "lang", "quality"))
    return m.select("id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["quality"].alias("quality"))


@query("eav_upsert", f"WITH {M} SELECT id, k AS meta_key, v AS meta_value FROM (SELECT id, unnest(['lang', 'quality', 'seen']) AS k, unnest([CASE WHEN id % 3 = 0 THEN 'xx' ELSE lang END, quality::VARCHAR, CASE WHEN id % 3 = 0 THEN 'yes' END]) AS v FROM m) WHERE v IS NOT NULL")
def eav_upsert(s, d):
    m = marked(s, d)
    return catalog.upsert_eav(catalog.to_eav(m, "lang", "quality"), catalog.to_eav(m.where("id % 3 = 0").select("id", F.lit("xx").alias("lang"), F.lit("yes").alias("seen")), "lang", "seen"))


@query("eav_delete", f"WITH {M} SELECT id, 'lang' AS meta_key, lang AS meta_value FROM m WHERE lang IS NOT NULL AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def eav_delete(s, d):
    dead = s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return catalog.delete_eav(catalog.to_eav(marked(s, d), "lang"), dead)


@query("tenant_usage", "SELECT source AS tenant, count(*) AS vectors, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY source")
def tenant_usage(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), (4 * F.size("embedding")).alias("bytes"))
    return v.join(tenants(s, d), "id").groupBy("tenant").agg(F.count("*").alias("vectors"), F.sum("bytes").alias("bytes"))


# --- placement and monitoring ---

NODES = ("1", "2", "3")
S_RING = "rg AS (SELECT ('0x' || substr(sha256(n || '#' || i), 1, 8))::BIGINT AS pos, n AS node FROM (SELECT unnest(['1', '2', '3']) AS n), (SELECT unnest(range(0, 150)) AS i)), k AS (SELECT vec_id AS id, ('0x' || substr(sha256('col-1#' || vec_id), 1, 8))::BIGINT AS h FROM embeddings)"
S_PLACED = f"WITH {S_RING}, pl AS (SELECT k.id, h, coalesce((SELECT arg_min(node, (pos, node)) FROM rg WHERE pos >= h), (SELECT arg_min(node, (pos, node)) FROM rg)) AS node FROM k)"


def _key() -> Column:
    return F.concat(F.lit("col-1#"), F.col("id").cast("string"))


@query("hash_ring", f"{S_PLACED} SELECT id, h AS hash, node FROM pl")
def hash_ring(s, d):
    return vectors(s, d).select("id", P.hash_key(_key()).alias("hash"), P.ring_node(_key(), NODES).alias("node"))


@query("ring_balance", f"{S_PLACED} SELECT node, count(*) AS n FROM pl GROUP BY node")
def ring_balance(s, d):
    return vectors(s, d).groupBy(P.ring_node(_key(), NODES).alias("node")).agg(F.count("*").alias("n"))


@query("ring_migration", S_PLACED + ", r2 AS (SELECT * FROM rg WHERE node <> '3'), p2 AS (SELECT id, node, coalesce((SELECT arg_min(node, (pos, node)) FROM r2 WHERE pos >= h), (SELECT arg_min(node, (pos, node)) FROM r2)) AS new_node FROM pl) SELECT node, new_node, count(*) AS n, ceil(count(*) / 1000)::BIGINT AS batches FROM p2 WHERE node <> new_node GROUP BY ALL")
def ring_migration(s, d):
    x = vectors(s, d).select(P.ring_node(_key(), NODES).alias("node"), P.ring_node(_key(), NODES[:2]).alias("new_node")).where("node <> new_node")
    return x.groupBy("node", "new_node").agg(F.count("*").alias("n")).withColumn("batches", P.migration_batches(F.col("n")))


@query("ring_replicas", f"WITH {S_RING}, o AS (SELECT id, node, min(pos + CASE WHEN pos >= h THEN 0 ELSE 4294967296 END) AS away FROM k, rg GROUP BY id, node) SELECT id, array_to_string((list(node ORDER BY away))[1:2], ',') AS nodes FROM o GROUP BY id")
def ring_replicas(s, d):
    return vectors(s, d).select("id", F.array_join(P.ring_nodes(_key(), NODES, 2), ",").alias("nodes"))


@query("rendezvous_route", "SELECT vec_id AS id, arg_max(n, (substr(sha256(n::BLOB || '\\x00'::BLOB || vec_id::VARCHAR::BLOB), 1, 16), n)) AS node FROM embeddings, (SELECT unnest(['1', '2', '3']) AS n) GROUP BY vec_id")
def rendezvous_route(s, d):
    return vectors(s, d).select("id", P.rendezvous(F.col("id").cast("string"), NODES)[0].alias("node"))


@query("quorum_table", "SELECT l AS level, rf, CASE l WHEN 'one' THEN 1 WHEN 'quorum' THEN greatest(rf, 1) // 2 + 1 ELSE greatest(rf, 1) END AS acks FROM (SELECT unnest(['one', 'quorum', 'all']) AS l), (SELECT unnest(range(0, 6)) AS rf)")
def quorum_table(s, d):
    t = s.range(6).select(F.col("id").alias("rf"), F.explode(F.array(F.lit("one"), F.lit("quorum"), F.lit("all"))).alias("level"))
    return t.select("level", "rf", P.acks(F.col("level"), F.col("rf")).alias("acks"))


S_BEATS = "b AS (SELECT user_id AS node, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events), nw AS (SELECT max(t) AS now FROM b)"


def _beats(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("node"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))


@query(
    "phi_accrual",
    f"WITH {S_BEATS}, g AS (SELECT node, t, t - lag(t) OVER (PARTITION BY node ORDER BY t) AS gap FROM b), r AS (SELECT * FROM g WHERE gap > 0 AND gap < 100000 QUALIFY row_number() OVER (PARTITION BY node ORDER BY t DESC) <= 100), m AS (SELECT node, count(*) AS n, avg(gap) AS mean FROM r GROUP BY node), l AS (SELECT node, (SELECT now FROM nw) - max(t) AS elapsed FROM b GROUP BY node), a AS (SELECT node, coalesce(n, 0) AS n, mean, elapsed FROM l LEFT JOIN m USING (node)), p AS (SELECT *, CASE WHEN n >= 10 THEN elapsed / mean / ln(10.0::DOUBLE) END AS phi FROM a) SELECT node, n, round(mean, 3) AS mean, round(elapsed, 3) AS elapsed, round(phi, 6) AS phi, CASE WHEN phi IS NULL THEN CASE WHEN elapsed >= 15 THEN 'dead' WHEN elapsed >= 5 THEN 'suspect' ELSE 'alive' END WHEN phi >= 8 THEN 'dead' WHEN phi >= 3 THEN 'suspect' ELSE 'alive' END AS state FROM p",
)
def phi_accrual(s, d):
    b = _beats(s, d)
    out = monitor.phi_accrual(b, b.agg(F.max("t")).first()[0], pause=100000.0)
    return out.select("node", "n", F.round("mean", 3).alias("mean"), F.round("elapsed", 3).alias("elapsed"), F.round("phi", 6).alias("phi"), "state")


@query("dedupe_ttl", f"WITH RECURSIVE {S_BEATS}, k AS (SELECT node, min(t) AS t FROM b GROUP BY node UNION ALL SELECT b.node, min(b.t) AS t FROM k JOIN b ON b.node = k.node AND b.t > k.t + 3000.0::DOUBLE GROUP BY b.node) SELECT node, t FROM k")
def dedupe_ttl(s, d):
    return monitor.dedupe_ttl(_beats(s, d), ["node"], ttl=3000.0)


@query("membership_health", f"WITH {S_BEATS}, a AS (SELECT node, (SELECT now FROM nw) - max(t) AS elapsed FROM b GROUP BY node) SELECT node, CASE WHEN elapsed >= 15000 THEN 'dead' WHEN elapsed >= 5000 THEN 'suspect' ELSE 'alive' END AS state FROM a")
def membership_health(s, d):
    b = _beats(s, d)
    now = b.agg(F.max("t")).first()[0]
    return b.groupBy("node").agg((F.lit(now) - F.max("t")).alias("elapsed")).select("node", P.health(F.col("elapsed"), 5000, 15000).alias("state"))




# --- formats and limits ---


@query("blob_roundtrip", "SELECT vec_id AS id, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings")
def blob_roundtrip(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet")
    back = v.select(F.col("vec_id").alias("id"), tables.decode_blob(tables.encode_blob(F.col("embedding"))).alias("v"))
    return back.select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query("fragment_keys", "SELECT event_id AS seq, printf('Bucket=%d/Seq=%016x.bin', (event_id // 4096) * 4096, event_id) AS key FROM events")
def fragment_keys(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"))
    return e.select("seq", tables.fragment_key(F.col("seq")).alias("key"))


@query("metadata_limits", "SELECT doc_id AS id, 'value too long' AS error FROM documents WHERE strlen(text) > 1024")
def metadata_limits(s, d):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"))
    return catalog.metadata_errors(documents(s, d).select(F.col("doc_id").alias("id"), m.alias("metadata")))


@query("api_keys", "SELECT event_id AS id FROM events WHERE event_type = 'view' OR ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
def api_keys(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    now = e.agg((F.min("ts") + F.expr("interval 1 day")).alias("now")).first()[0]
    keys = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("ts")).alias("expires_at"))
    return catalog.valid_keys(keys, F.lit(now)).select("id")


@query("migration_batches", "SELECT event_type AS node, count(*) AS n, ceil(count(*) / 1000.0)::BIGINT AS batches FROM events GROUP BY event_type")
def migration_batches(s, d):
    n = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("n"))
    return n.withColumn("batches", P.migration_batches(F.col("n")))
