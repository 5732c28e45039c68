"""Operators against brute force on small tables, and their defined edge cases."""

import hashlib
import itertools
import json
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import balanced_shards, byte_cnn, graph, language_id, line_templates, minmax_dedup, one_bit_ann, piece_codec, pieces, preference_chat, registry, secret_crf, spaced_seeds
from skerry.llm import textnum as tn
from skerry.llm.sampling import low_rows
from skerry.llm.workspace import Workspace, shared_dir
from tests.oracle import same

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 40_000  # 720 KB
#: Null and blank texts, repeated rows, a null id, a very long text, equal texts.
EDGES = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (1, "a b c d e f g"), (None, "a b c d e f g"), (6, LONG), (7, "A b C d e f g"), (8, "x" * 100_000), (9, "été ▁ 数 😀  ")]
DOCS = "doc_id long, text string"


def edges(spark, extra=True):
    df = spark.createDataFrame(EDGES, DOCS)
    # Columns whose names operators use themselves.
    return df.selectExpr("*", "1 as n", "'z' as rep", "2 as component_id", "3 as leaf", "4 as score", "'q' as shard", "0 as n_dropped") if extra else df


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(text, k):
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def clusters(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# --- shared ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b数", max_size=12), max_size=6))
def test_words(texts):
    data, offsets = tn.buffers(pa.array(texts, pa.large_string()))
    w = tn.words(data, offsets)
    found = [(int(r), bytes(data[s:e]).decode()) for r, s, e in zip(w.row, w.start, w.end)]
    assert found == [(i, x) for i, t in enumerate(texts) for x in WORDS.findall(t)]
    hashes = {}
    for (_, x), h in zip(found, w.hash.tolist()):
        assert hashes.setdefault(x, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_words_of_a_text_over_a_block():
    text = ("word " * 5 + "x" * 3000 + " ") * 900  # 2.7 MB
    data, offsets = tn.buffers(pa.array([text], pa.large_string()))
    w = tn.words(data, offsets)
    assert len(w.hash) == 5400 and len(set(w.hash.tolist())) == 2


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(9, 9)]
    got = {r.node: r.component for r in graph.components(Workspace(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {frozenset(p) for p in pairs}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == clusters(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert graph.components(Workspace(spark), spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_low_rows_hold_the_lowest(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53))
    for by, n in (((), 1), (("lang",), 2)):
        got = low_rows(rows, 100, *by)
        assert got.count() < 350 * n and got.columns == (["lang", "doc_id"] if by else rows.columns)
        for lang in ("a", "b") if by else (None,):
            pick = lambda df: {r.doc_id for r in (df if lang is None else df.where(F.col("lang") == lang)).orderBy(h).limit(100).collect()}  # noqa: B023, E731
            assert pick(got) == pick(rows)
    assert low_rows(rows.limit(50), 100).count() == 50 and low_rows(rows.limit(0), 100, "lang").count() == 0


# --- 1 ---


def test_preference_pairs(spark):
    turns = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "hi"), ("assistant", "yö"), ("assistant", "no")
    rows = [(1, [a, b], [a, c], 0), (2, [a], [a], 0), (3, None, [a], 0), (4, [], None, 0), (5, [a, b, a], [a, b], 0), (1, [a, b], [a, c], 0)]
    rows += [(6, [a, (None, "x"), ("assistant", None), b], [a, ("", "x"), None, b], 0)]
    out = preference_chat.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {turns}, rejected {turns}, n_prefix int"))
    got = {r.pair_id: r for r in out.collect()}
    assert out.count() == 7
    r = got[1]
    assert (r.n_prefix, r.prompt, r.chosen) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyö<|end|>\n")
    assert [r.chosen[s.start : s.stop] for s in r.chosen_mask] == ["yö<|end|>\n"]
    assert (got[2].n_prefix, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", [])
    assert (got[3].n_prefix, got[3].prompt, got[3].rejected) == (0, "", "<|user|>\nhi<|end|>\n")
    assert got[4].chosen == got[4].rejected == "" and got[5].n_prefix == 2 and got[5].rejected == ""
    # a null role, text or turn counts as empty: no turn is lost, and the masks stay right
    r = got[6]
    assert (r.n_prefix, r.prompt) == (2, "<|user|>\nhi<|end|>\n<||>\nx<|end|>\n")
    assert r.chosen == "<|assistant|>\n<|end|>\n<|assistant|>\nyö<|end|>\n" and r.rejected == "<||>\n<|end|>\n<|assistant|>\nyö<|end|>\n"
    assert [r.chosen[s.start : s.stop] for s in r.chosen_mask] == ["<|end|>\n", "yö<|end|>\n"] and [r.rejected[s.start : s.stop] for s in r.rejected_mask] == ["yö<|end|>\n"]
    assert preference_chat.format_pairs(spark.createDataFrame([], f"pair_id long, chosen {turns}, rejected {turns}")).count() == 0


def test_conversation_edges(spark):
    rows = [(1, 0, "user", "q", 7), (1, 1, "assistant", None, 7), (None, 0, "user", "x", 7), (2, None, None, "t", 7), (2, 0, "assistant", "r", 7), (2, 0, "assistant", "r", 7), (3, 0, "user", LONG, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.pair_id: r for r in preference_chat.format_pairs(preference_chat.mismatched_pairs(df)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].rejected == "<|assistant|>\nr<|end|>\n" and got[2].rejected == "" and got[3].prompt.endswith("<|end|>\n")
    assert preference_chat.mismatched_pairs(df.limit(0)).count() == 0


# --- 2 and 10 ---


def brute_paths(v, word):
    """All segmentations of a short word into pieces."""
    if not word:
        yield ()
        return
    for i in range(1, len(word) + 1):
        p = v.trie.get(word[:i])
        if p >= 0:
            for rest in brute_paths(v, word[i:]):
                yield (p, *rest)


@pytest.mark.parametrize("word", ["international", "ouble", "Straße", "añosque"])
def test_lattice_is_all_segmentations(word):
    v = pieces.load()
    raw = bytes([pieces.MARK]) + word.encode()
    paths = list(brute_paths(v, raw))
    prob = np.append(np.exp(v.log_score), 0)[:, None]
    lattice = pieces.Lattice(v.trie, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    total = sum(float(np.prod(prob[list(p)])) for p in paths)
    assert np.isclose(lattice.forward(prob, 1.0)[-1, 0], total) and np.isclose(lattice.backward(prob, 1.0)[0, 0], total)
    assert np.isclose(language_id.word_scores(v, prob + 1e-300, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0, 0], np.log(total))
    best = piece_codec.encode([word])[0]
    assert np.isclose(v.log_score[best].sum(), max(v.log_score[list(p)].sum() for p in paths))


def test_long_words():
    """The sum and the best path of a long word are those of its lattice, whichever way they are found."""
    v = pieces.load()
    rng = np.random.default_rng(4)
    prob = np.append(np.where(np.isfinite(v.log_score), np.exp(v.log_score), 0), 1e-9)[:, None] * [[1.0, 0.5]] + 1e-12
    score = np.append(v.log_score, v.unknown)
    texts = [b"international" * 40, b"x" * 900, bytes(rng.choice(list(b"acgt"), 700).tolist()), "Straße数学é".encode() * 60, bytes(rng.choice(list(b"abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), 2000).tolist())]
    for text in texts:
        word = np.frombuffer(bytes([pieces.MARK]) + text, dtype=np.uint8)
        bounds = np.array([0, len(word)])
        lattice = pieces.Lattice(v.trie, word, bounds)
        whole = lattice.forward_log(prob, language_id.GAIN)
        assert np.allclose(language_id.word_scores(v, prob, word, bounds), whole) and np.allclose(pieces.walk_sum(v.trie, prob, word), whole[0])
        small = pieces.Lattice(v.trie, word[:60], np.array([0, 60]))
        assert np.allclose(np.log(small.forward(prob, 1.0)[small.last]), small.forward_log(prob, 1.0))
        size, piece = pieces.walk_best(v, word)
        _, ids, _ = piece_codec._encode_chunks(v, word, bounds)
        cut = pieces.take_apart(v.trie, word, bounds)[0]
        parts = np.concatenate([pieces.walk_best(v, word[a:b])[1] for a, b in itertools.pairwise(cut)])
        back, at, best = lattice.best(v.log_score, v.unknown), int(lattice.last[0]), 0.0
        while at > 0:
            best += score[lattice.piece[back[at]]]
            at = int(lattice.src[back[at]])
        assert size.sum() == len(word) and np.isclose(score[piece].sum(), best) and np.isclose(score[parts].sum(), best)
        assert piece_codec.decode([ids.tolist()]) == [text.decode()]


def test_free_cuts_are_crossed_by_no_piece():
    v = pieces.load()
    rng = np.random.default_rng(5)
    raw = "".join(rng.choice(list("abcdé数 zXQ"), 400)).encode()
    buf = np.where(np.frombuffer(raw, dtype=np.uint8) == 32, np.uint8(pieces.MARK), np.frombuffer(raw, dtype=np.uint8))
    crossed = np.zeros(len(buf), dtype=bool)
    for i in range(len(buf)):
        for size in range(1, v.trie.longest + 1):
            if i + size <= len(buf) and v.trie.get(buf[i : i + size].tobytes()) >= 0:
                crossed[i + 1 : i + size] = True
    crossed |= pieces.char_lengths(buf) == 0
    block, pieces.BLOCK = pieces.BLOCK, 50
    try:
        assert (pieces.free_cuts(v.trie, buf) == ~crossed).all()
    finally:
        pieces.BLOCK = block


def doubled(n):
    """Two different words of 2**n letters by the rule a to ab, b to ba."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = doubled(10)
    data, offsets = tn.buffers(pa.array([a + " " + b], pa.large_string()))
    assert len(set(tn.words(data, offsets).hash.tolist())) == 2
    assert piece_codec.decode(piece_codec.encode([a + " " + b])) == [a + " " + b]
    got = minmax_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b)], DOCS)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2)}


def test_equal_hashes_are_compared():
    """Spans that share a hash stay apart where their bytes differ."""
    data = np.frombuffer(b"catdogcatdoverat", dtype=np.uint8)
    start, end = np.array([0, 3, 6, 9, 13, 14]), np.array([3, 6, 9, 13, 16, 16])
    first, inverse = tn.distinct(data, start, end, np.zeros(6, dtype=np.uint64))
    spans = [data[s:e].tobytes() for s, e in zip(start, end, strict=True)]
    assert [spans[i] for i in first[inverse]] == spans


def test_very_long_texts_are_taken_in_parts():
    """The ids of the parts are those of the whole, and scores those of a text without the detour."""
    v = pieces.load()
    rng = np.random.default_rng(6)
    vocabulary = ["the", "house", "Straße", "of", "数学", "x9", "walking"]
    block, tn.BLOCK = tn.BLOCK, 1 << 12
    try:
        for joint in (" ", "", "  \n"):
            text = joint.join(rng.choice(vocabulary, 6000))
            data, offsets = tn.buffers(pa.array([text], pa.large_string()))
            got = piece_codec.encode_block(v, data, offsets)[1]
            assert piece_codec.decode([got.tolist()]) == [text]
            tn.BLOCK = 1 << 30
            want = piece_codec.encode_block(v, data, offsets)[1]
            prob = rng.random((v.size + 1, 2)) / v.size
            whole = language_id.predict_block(v, language_id.Model(["a", "b"], prob), data, offsets)
            tn.BLOCK = 1 << 12
            assert np.isclose(v.log_score[got].sum(), v.log_score[want].sum()) and len(got) == len(want)
            assert np.allclose(language_id.predict_block(v, language_id.Model(["a", "b"], prob), data, offsets), whole)
    finally:
        tn.BLOCK = block


def test_language_of_huge_word():
    v = pieces.load()
    prob = np.append(np.where(np.isfinite(v.log_score), np.exp(v.log_score), 0), 1e-9)[:, None] + 1e-12
    huge = np.frombuffer(bytes([pieces.MARK]) + b"ab" * 5000, dtype=np.uint8)
    assert np.isfinite(language_id.word_scores(v, prob, huge, np.array([0, len(huge)]))).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_codec_round_trip(texts):
    assert piece_codec.decode(piece_codec.encode(texts)) == texts


def test_codec_against_library():
    from tokenizers import Tokenizer, models

    v = pieces.load()
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    t = Tokenizer(models.Unigram([(m.id_to_piece(i), float(v.log_score[i]) if np.isfinite(v.log_score[i]) else -1e6) for i in range(v.size)], unk_id=0, byte_fallback=True))
    value = lambda ids: sum(v.log_score[i] for i in ids if np.isfinite(v.log_score[i]))
    for x in ["Hello world", "  two  spaces ", "naïve café – “quote”", "The ouble, thnd!!", "a\nb\n", "数学 😀"]:
        ours, theirs = piece_codec.encode([x])[0], t.encode("▁" + x.replace(" ", "▁")).ids
        assert len(ours) == len(theirs) and np.isclose(value(ours), value(theirs))  # equal scores may cut differently


def test_codec_documents(spark):
    out = {(r.doc_id, r.n_tokens): r for r in piece_codec.encode_documents(edges(spark)).collect()}
    rows = piece_codec.encode_documents(edges(spark))
    assert rows.count() == len(EDGES) and rows.where("not round_trip").count() == 0
    assert out[2, 0].token_ids == [] and (3, 0) in out
    back = piece_codec.decode_documents(rows.where("doc_id in (6, 7, 9)"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t in EDGES if i in (6, 7, 9)}
    assert piece_codec.encode_documents(edges(spark).limit(0)).count() == 0
    assert piece_codec.decode([[-5, 10**7, 1, 2], [3 + 0xC3]]) == ["", "�"]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    both = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out("doc_id"))
    right = both.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.limit(50).select("doc_id", language_id.held_out("doc_id").alias("h")).collect())


def test_language_edges(spark):
    model = language_id.train(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([("the of and", "en"), ("der die und", "de"), (None, "en"), ("x", None)])], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = [(1, "the and"), (2, None), (3, ""), (4, "123 !?"), (5, "DIE UND"), (1, "the and"), (None, "数"), (6, LONG)]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("zz"))
    got = language_id.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "und", "und", "und", "de"] and by[2].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 1, 5, 6]
    none = language_id.train(df.limit(0).withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert sorted(str(r.doc_id) for r in language_id.keep_identified(df, none).collect()) == ["1", "1", "5", "6", "None"]  # without labels only texts without a letter go
    assert language_id.identify(df.limit(0), model).count() == 0


# --- 3 ---


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 48))
    x[700] = x[701] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 48), (5002, [float("nan")] + [1.0] * 47), (None, x[3].tolist()), (100, x[100].tolist()), (5100, [1.0, 2.0]), (5003, [float("inf")] * 48)]
    df = one_bit_ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)))
    out = one_bit_ann.search(df, df.where("vec_id % 100 = 0"), 10)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))  # 5100 has no other vector of its length
    hits = 0
    for q, found in got.items():
        d = [one_bit_ann.distances(x[i][None], x[q][None])[0] for i in range(1500)]
        best = sorted((e, i) for i, e in enumerate(d) if i != q)[:10]
        hits += len({i for _, i in best} & {i for i, _ in found})
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and all(d[i] == s for i, s in found)
    assert hits / (10 * len(got)) >= 0.95
    assert [i for i, _ in got[0][:2]] == [700, 701]
    assert one_bit_ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 100, 200)")
    assert one_bit_ann.search(few, few, 10).count() == 6


@pytest.mark.parametrize("kind", ["even", "clustered", "copies"])
def test_ann_cells(spark, monkeypatch, kind):
    """Many cells: recall against brute force, whole rows in the index, and fewer vectors looked at than there are."""
    rng = np.random.default_rng(6)
    n, dim = 6000, 32
    x = rng.standard_normal((n, dim))
    if kind != "even":
        x = x * 0.4 + rng.standard_normal((30, dim))[rng.integers(0, 30, n)] * 2
    if kind == "copies":
        x[: n // 3] = x[0]  # one vector is a third of all rows
    monkeypatch.setattr(one_bit_ann, "CELL_ROWS", 150)
    monkeypatch.setattr(one_bit_ann, "PASS", 25)
    df = one_bit_ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {}
    for r in one_bit_ann.search(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, n, 100):
        d = one_bit_ann.distances(x, np.broadcast_to(x[q], x.shape))
        best = [i for i in np.lexsort((np.arange(n), d)) if i != q][:10]
        assert len(got[q]) == 10 and all(np.isclose(d[i], s, rtol=0, atol=0) for i, s in got[q])
        hits += sum(d[i] <= d[best[-1]] for i, _ in got[q])
    assert hits / (n / 10) >= 0.95, hits / (n / 10)


def test_cell_bounds():
    """Bounds of cells hold but for rare errors, and leave cells out."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 32)) * 0.4 + rng.standard_normal((40, 32))[rng.integers(0, 40, 4000)] * 2
    cells = one_bit_ann.Cells.fit(x, 40)
    near = cells.nearest(x, 1)[:, 0]
    radius = np.sqrt(((x - cells.centres[near]) ** 2).sum(axis=1))
    full = np.unique(near)
    cells = one_bit_ann.Cells(cells.centres[full], cells.spread)
    near = np.searchsorted(full, near)
    low, high = (np.array([f(radius[near == c]) for c in range(len(full))]) for f in (np.min, np.max))
    q = x[::50]
    bound = cells.bounds(q, low, high)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    true = np.stack([d[:, near == c].min(axis=1) for c in range(len(full))], axis=1)
    kth = np.sort(d, axis=1)[:, 10]
    other = np.ones(bound.shape, dtype=bool)  # the nearest are searched anyway
    np.put_along_axis(other, cells.nearest(q, one_bit_ann.PROBED), False, axis=1)
    assert (bound <= true + 1e-9)[other].mean() >= 0.99 and (bound > kth[:, None])[other].mean() >= 0.5


def test_ann_bounds():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((800, 64)), rng.standard_normal((20, 64))
    r = one_bit_ann.Rotation.fit(x)
    guess, low = one_bit_ann.lower_bounds(r, one_bit_ann.encode(r, x), q)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert (low <= true).mean() > 0.95 and abs((guess - true).mean()) < 2


# --- 4 ---


def test_line_templates(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    rows = [(i, f"Posted by user{i} at {i}:30\nAll rights reserved here now {n}\n{n} {n}a {n}b alone") for i, n in enumerate(names)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, "All rights reserved here now zed"), (23, "Posted by user9 at 1:30\n" * 3)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as leaf", "2 as n_dropped", "'k' as key")
    out = line_templates.drop_recurring_lines(df)
    assert set(out.columns) == {"doc_id", "text", "leaf", "key", "n_dropped"}
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0  # the first document keeps its lines
    for i in range(1, 6):
        assert got[i].text == rows[i][1].split("\n")[2] and got[i].n_dropped == 2
    assert got[20].text is None and got[21].text == "" and got[22].text == "\n\n" and got[None].text == rows[9][1]
    assert got[23].text == "" and got[23].n_dropped == 3
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


def test_lines_exact_repeats(spark):
    """Lines without variable parts: against counting equal lines."""
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}" for a in "bcdfgl" for b in "aeiou"]
    lines = [" ".join(rng.choice(vocabulary, 30)) for _ in range(60)]
    docs = [(i, [lines[int(j)] for j in rng.integers(0, 60, 4)]) for i in range(40)]
    seen = {}
    for i, own in docs:
        for x in own:
            seen.setdefault(x, set()).add(i)
    want = {i: "\n".join(x for x in own if len(seen[x]) < line_templates.MIN_DOCS or min(seen[x]) == i) for i, own in docs}
    got = line_templates.drop_recurring_lines(spark.createDataFrame([(i, "\n".join(o)) for i, o in docs], DOCS))
    assert {r.doc_id: r.text for r in got.collect()} == want


def spelt(stem, i):
    """A word without digits for every number."""
    return stem + "".join("abcdefghij"[int(c)] for c in str(i))


@pytest.mark.parametrize("n_templates,n_names", [(2, 20), (12, 20), (40, 20), (1000, 20), (60, 5)])
def test_lines_of_many_templates_in_a_leaf(spark, n_templates, n_names):
    """Every line beyond its template's first goes, however many templates the leaf holds and names they share."""
    lines = [(t, f"1{t} 2:{n} 3 " + " ".join(spelt(w, t) for w in ("takes", "gives", "holds", "ends")) + " " + spelt("name", n)) for n in range(n_names) for t in range(n_templates)]
    docs = [(i, x) for i, (_, x) in enumerate(lines)]
    first = {}
    for i, (t, _) in enumerate(lines):
        first.setdefault(t, i)
    got = line_templates.drop_recurring_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id for r in got if r.n_dropped == 0} == set(first.values())


def random_lines(rng, n_docs, stems):
    """Documents of lines with few different words, so that leaves are full and templates overlap."""
    line = lambda: " ".join(["it", "was", str(rng.choice(["a", "the", "7"]))] + [str(rng.choice(stems)) for _ in range(int(rng.integers(0, 8)))])
    return [(i, "\n".join(line() for _ in range(int(rng.integers(0, 6))))) for i in range(n_docs)]


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_sql(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    docs = random_lines(rng, 150, ["red", "blue", "x1", "green"]) + [(200, None), (201, ""), (202, "\n \n"), (203, "it was\nit")]
    passage = " ".join(spelt("w", i) for i in range(60))
    docs += [(210 + i, passage + f" {spelt('end', i)}\nown {spelt('line', i)}") for i in range(2)]
    df = spark.createDataFrame(docs, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(line_templates.OP4_SQL).fetchall()}
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(df).collect()}
    assert got == want and sum(n for _, n in got.values()) > 50 and got[211][1] == 1


def test_lines_do_not_depend_on_others_of_the_leaf(spark):
    """Unrelated lines in the same leaf change nothing."""
    own = [(i, f"it was a {a} in the {b} of old town") for i, (a, b) in enumerate(itertools.product(["fair", "feast", "wake"], ["north", "south"]))]
    rng = np.random.default_rng(2)
    others = [(100 + i, "it was a " + " ".join(spelt("z", int(x)) for x in rng.integers(0, 10**6, 7))) for i in range(300)]
    run = lambda rows: {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    alone, among = run(own), run(own + others)
    assert alone == {i: among[i] for i, _ in own} and [t for t in alone.values() if t] == [own[0][1]]


def test_long_passages_recur_in_two_documents(spark):
    """A passage of 60 words in two otherwise different documents leaves the second; a short line stays in both."""
    passage, short = " ".join(spelt("w", i) for i in range(60)), "a short line of words"
    fifty, more = (" ".join(spelt(s, i) for i in range(n)) for s, n in (("x", 50), ("y", 51)))
    docs = [(1, f"one alone\n{passage}\n{short}\n{fifty}\n{more}"), (2, f"{short}\n{passage}\n{fifty}\n{more}\nand two alone")]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(df).collect()}
    assert got == {1: docs[0][1], 2: f"{short}\n{fifty}\nand two alone"}


# --- 5 ---


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


SECRET = st.lists(st.sampled_from(["password", "PassWd", "token", "api_key", "APIKEY", "secret", "ſecret", "=", ":", " ", '"', "'", "abc", "hunter2x", "AKIA", "Q7" * 9, "deadbeef" * 3, "é", "\n"]), max_size=14).map("".join)


@settings(max_examples=200, deadline=None)
@given(SECRET)
def test_base_spans(text):
    assert secret_crf.base_spans(text) == brute_secrets(text)


def test_secrets(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8))))
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(i, " ".join(word() for _ in range(40)) + (f' token = "{key(32)}" ' if i % 2 else " ") + " ".join(word() for _ in range(9))) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    field = secret_crf.train(df)
    hidden = spark.createDataFrame([(1, f'some words é token is "{key(12)}-{key(9)}" and more'), (2, "plain words only, nothing else"), (3, None), (4, ""), (None, f"é passwd: {key(30)}"), (1, "again"), (6, LONG)], DOCS).withColumn("spans", F.lit(1))
    got = secret_crf.scan(hidden, field).collect()
    assert len(got) == 7
    by = {(r.doc_id, r.n_assign): r for r in got}
    added = [r for r in got if r.n_added]
    assert [r.doc_id for r in added] == [1] and "crf:" in added[0].spans  # the patterns miss it, the field doesn't
    empty = hashlib.sha256(b"").hexdigest()
    assert by[3, 0].base_sha256 == by[4, 0].base_sha256 == empty and by[3, 0].spans == ""
    assert by[None, 1].spans == "assign:2:40,hex:10:40"
    assert by[None, 1].base_sha256 == hashlib.sha256(b"assign:2:40,hex:10:40").hexdigest()
    assert secret_crf.scan(hidden.limit(0), field).count() == 0
    assert len(secret_crf.train(df.limit(0)).weight)


def test_field_finds_what_the_patterns_miss():
    """On documents and secrets that the fit has not seen."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY hash(doc_id)").fetchall()]
    field = secret_crf.fit_texts([t[: secret_crf.CHARACTERS] for t in texts[:600]])
    seed, secret_crf.SEED = secret_crf.SEED, 99
    try:
        marked, marks = secret_crf._marked(texts[600:], 600)
    finally:
        secret_crf.SEED = seed
    n, found, false = 0, 0, 0
    for text, own in zip(marked, marks, strict=True):
        data, offsets = tn.buffers(pa.array([text], pa.large_string()))
        w, f = secret_crf.features(data, offsets)
        a, z = secret_crf._spans(secret_crf.decode(field, field.emissions(f), w.row), w.row)
        at = secret_crf._points(data, 0, int(offsets[-1]))
        spans, base = [(int(at[w.start[i]]), int(at[w.end[j]])) for i, j in zip(a, z)], secret_crf.base_spans(text)
        meet = lambda s, other: any(s[0] < o[1] and o[0] < s[1] for o in other)
        missed = [s for s in own if not meet(s, base)]
        n, found = n + len(missed), found + sum(meet(s, spans) for s in missed)
        false += sum(not meet(s, own) and not meet(s, base) for s in spans)
    assert n > 150 and found >= 0.9 * n and false <= 0.02 * n, (n, found, false)


def test_field_gradient():
    rng = np.random.default_rng(3)
    first, size = secret_crf._FIRST, int(secret_crf._FIRST[-1])
    field = secret_crf.Field(rng.normal(0, 0.3, (size, 3)), rng.normal(0, 0.5, (3, 3)))
    x = np.stack([rng.integers(a, a + 4, (5, 7)) for a in first[:-1]], axis=2)
    x[2, 4:] = -1
    y = rng.integers(0, 3, (5, 7))
    y[2, 4:] = 0
    value, grad, grad_t = secret_crf.likelihood(field, x, y)
    brute = 0.0
    for i in range(5):
        e = field.emissions(x[i][x[i][:, 0] >= 0]).astype(float)
        score = lambda t: sum(e[k, c] for k, c in enumerate(t)) + sum(field.change[p, q] for p, q in itertools.pairwise(t))  # noqa: B023, E731
        brute += score(y[i][: len(e)]) - np.log(sum(np.exp(score(t)) for t in itertools.product(range(3), repeat=len(e))))
    assert np.isclose(value, brute, rtol=1e-5)
    step = 1e-3
    for k, c in [(0, 0), (1, 2), (int(first[3]) + 2, 1)]:
        up, down = (secret_crf.Field(field.weight.copy(), field.change) for _ in range(2))
        up.weight[k, c] += step
        down.weight[k, c] -= step
        assert np.isclose((secret_crf.likelihood(up, x, y)[0] - secret_crf.likelihood(down, x, y)[0]) / (2 * step), grad[k, c], atol=5e-3)
    for p, q in itertools.product(range(3), repeat=2):
        move = np.zeros((3, 3))
        move[p, q] = step
        more, less = (secret_crf.likelihood(secret_crf.Field(field.weight, field.change + s * move), x, y)[0] for s in (1, -1))
        assert np.isclose((more - less) / (2 * step), grad_t[p, q], atol=5e-3)


def test_crf_decoding_is_exact():
    rng = np.random.default_rng(9)
    field = secret_crf.Field(np.zeros((1, 3), np.float32), rng.normal(0, 2, (3, 3)).astype(np.float32), 1.0)
    e = rng.normal(0, 4, (600, 3)).astype(np.float32)
    row = np.sort(rng.integers(0, 40, 600))
    tags = secret_crf.decode(field, e, row)
    for r in np.unique(row):
        own = e[row == r] + np.array([field.margin, 0, 0], np.float32)
        assert (secret_crf.viterbi(own[None].astype(float), field.change)[0] == tags[row == r]).all()
    small = e[:6].astype(float)
    value = lambda y: sum(small[i, t] for i, t in enumerate(y)) + sum(field.change[a, b] for a, b in zip(y, y[1:]))
    best = max(itertools.product(range(3), repeat=6), key=value)
    assert tuple(secret_crf.viterbi(small[None], field.change)[0]) == best


# --- 6 ---


def test_shards(spark):
    rows = EDGES + [(100 + i, "copy") for i in range(30)] + [(200 + i, f"own {i}") for i in range(37)]
    df = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit(1)).withColumn("group", F.lit(1))
    got = balanced_shards.shard_documents(df).collect()
    assert len(got) == len(rows)
    sizes = [0] * 8
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
        sizes[s] = len(slots)
    assert max(sizes) - min(sizes) <= 1
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    # 30 copies need three shards of nine or ten rows; scattered they would be in eight
    assert len({r.shard for r in got if r.doc_id and 100 <= r.doc_id < 130}) <= 5
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert balanced_shards.shard_documents(df.limit(0)).count() == 0


def test_shards_cut_no_link_where_groups_fit(spark):
    """On a whole table: rows, sizes and checksums are those of the table, counts at most one apart, and no link is cut."""
    folder = "/root/testdata/sf0.1"
    got = balanced_shards.op6_balanced_shards(spark, folder).toPandas()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()]
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == sorted(want)
    counts = got.shard.value_counts()
    assert sorted(counts.index) == list(range(8)) and counts.max() - counts.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    groups = got.groupby(["size", "text_crc32"]).shard
    linked = groups.count() > 1
    assert linked.sum() > 500 and groups.nunique()[linked].max() == 1


def test_shards_are_native(spark):
    plan = balanced_shards.op6_balanced_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 7 ---


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 120))))
        for _ in range(14):  # copies with up to a few words changed
            own = list(base)
            for j in rng.integers(0, len(base), int(rng.integers(0, 5))):
                own[int(j)] = vocabulary[int(rng.integers(0, 400))]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one", "ONE", "two words", "two  words", "", None, "  "])]
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), k, percent)
    got = {r.doc_id: r for r in got.collect()}
    sets = {i: shingles(t, k) for i, t in rows}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = clusters(sets, linked)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert len(set(want.values())) < len(rows) - 20


def test_across_finds_every_link(spark):
    """The prefix filter alone, on sets that banding has put together in no way."""
    rng = np.random.default_rng(3)
    sets = {}
    for i in range(60):
        core = set(range(100 * (i % 4), 100 * (i % 4) + 40))
        sets[i] = sorted((core - set(rng.choice(sorted(core), int(rng.integers(0, 5)), replace=False).tolist())) | {1000 * i + int(j) for j in range(int(rng.integers(1, 5)))})
    table = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "rep long, shingles array<long>")
    apart = table.select("rep", F.col("rep").alias("label"))
    ws = Workspace(spark)
    found = minmax_dedup._linked(ws, minmax_dedup._across(ws, apart, table, 85), table, 85)
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert {(r.a, r.b) for r in found.collect()} == want and want


def test_pages_of_a_template_do_not_meet(spark):
    """Hundreds of pages that share nine tenths of their shingles but do not link: no pair is looked at; those that link are found."""
    sets = [(i, [*range(90), *range(1000 * i + 1000, 1000 * i + 1010)]) for i in range(400)]
    sets += [(1000 + i, [*range(90), *range(900_000, 900_006), *range(1000 * i + 950_000, 1000 * i + 950_002)]) for i in range(3)]
    table = spark.createDataFrame(sets, "rep long, shingles array<long>")
    pairs = {(r.a, r.b) for r in minmax_dedup._across(Workspace(spark), table.select("rep", F.col("rep").alias("label")), table, 85).collect()}
    linked = lambda x, y: 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))
    own = dict(sets)
    assert {(1000, 1001), (1000, 1002), (1001, 1002)} <= pairs and all(linked(own[a], own[b]) for a, b in pairs)


def test_common_shingle_makes_few_pairs(spark):
    """Two thousand documents that share a shingle and nothing else, though all were put into one bucket: few pairs are looked at."""
    sets = [(i, [0, *range(10 * i + 10, 10 * i + 18)]) for i in range(2000)]
    table = spark.createDataFrame(sets, "rep long, shingles array<long>")
    assert minmax_dedup._across(Workspace(spark), table.select("rep", F.col("rep").alias("label")), table, 85).count() == 0


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = {}

    Context._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_near_duplicate_edges(spark):
    got = minmax_dedup.near_duplicates(edges(spark), 3, 85)
    rows = got.collect()
    assert len(rows) == len(EDGES) and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    by = {r.doc_id: r for r in rows}
    assert by[7].component_id == 1 and not by[7].kept
    assert by[None].component_id is None and by[None].kept
    assert [by[i].kept for i in (2, 3, 4)] == [True] * 3 and by[6].n_shingles == 3
    kept = minmax_dedup.drop_near_duplicates(edges(spark), 3, 85)
    assert kept.columns == edges(spark).columns and kept.count() == len(EDGES) - 1
    assert minmax_dedup.near_duplicates(edges(spark).limit(0)).count() == 0


# --- 8 ---


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = byte_cnn.op8_byte_cnn(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert (out.predicted == out.quality).mean() >= 0.93


def test_quality_edges(spark):
    docs = edges(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (1, 0), (None, 1), (8, None)], "doc_id long, quality int")
    net = byte_cnn.train(docs, labels)
    got = byte_cnn.score(docs, net)
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3]
    assert byte_cnn.score(docs.limit(0), byte_cnn.train(docs.limit(0), labels.limit(0))).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        row, start = byte_cnn.chunks(np.array([0, n, n + 3]))
        own = start[row == 0]
        assert own[0] == 0 and own[-1] + byte_cnn.CHUNK >= n and (np.diff(own) == byte_cnn.HOP).all() and (row == 1).sum() == 1


def test_network_gradient():
    """Against differences in double precision."""
    rng = np.random.default_rng(2)
    net = byte_cnn.fit([], np.zeros(0))
    net = byte_cnn.Network(net.embed.astype(float), net.filters.astype(float), rng.normal(0.2, 0.1, byte_cnn.FILTERS), net.out.astype(float), 0.1)
    x, sizes, labels = rng.integers(0, 256, (7, byte_cnn.CHUNK)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    _, g = byte_cnn.gradients(net, x, sizes, labels)
    for name, places in {"out": [(3,), (9,)], "bias": [(3,), (30,)], "filters": [(0, 3), (20, 11)], "embed": [(7, 2), (200, 0)]}.items():
        for at in places:
            loss = []
            for step in (1e-5, -1e-5):
                moved = byte_cnn.Network(*(getattr(net, k).copy() for k in ("embed", "filters", "bias", "out")), net.shift)
                getattr(moved, name)[at] += step
                loss.append(byte_cnn.gradients(moved, x, sizes, labels)[0])
            assert np.isclose((loss[0] - loss[1]) / 2e-5, g[name][at], rtol=1e-2, atol=1e-5), (name, at)


def test_gradient_free_forward_is_the_definition():
    net = byte_cnn.fit([], np.zeros(0))
    text = b"The quick brown fox " * 30
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    vectors = []
    for s in byte_cnn.chunks(offsets)[1]:
        x = net.embed[np.frombuffer(text[s : s + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0"), dtype=np.uint8)]
        y = np.array([x[p : p + byte_cnn.WIDTH].reshape(-1) @ net.filters for p in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)])
        vectors.append(np.maximum(y.max(axis=0) + net.bias, 0))
    want = byte_cnn.probability(net, np.mean(vectors, axis=0))
    assert np.allclose(byte_cnn.score_block(net, data, offsets)[0], want, atol=1e-5)


# --- 9 ---


def test_seeds_cover_three_substitutions():
    for gone in itertools.combinations(range(spaced_seeds.WINDOW), 3):
        same_ = [i not in gone for i in range(spaced_seeds.WINDOW)]
        assert any(all(same_[o + j] for j, c in enumerate(m) if c == "1") for m in spaced_seeds.MASKS for o in range(spaced_seeds.WINDOW - len(m) + 1))


def brute_overlaps(docs, items):
    out = set()
    split = re.compile(r"[0-9a-z\x80-\U0010FFFF]+").findall
    for (i, t), (j, b) in itertools.product(docs, items):
        x, y = split((t or "").lower()), split((b or "").lower())
        width = min(spaced_seeds.WINDOW, len(y))
        known, least = set(x), -(-spaced_seeds.PERCENT * width // 100)
        within = np.concatenate([[0], np.cumsum([w in known for w in y])])
        if not y or (within[width:] - within[: len(within) - width]).max() < least:
            continue  # no window has enough words of the document, wherever they stand
        if (len(y) >= spaced_seeds.LEAST or len(x) == len(y)) and any(100 * sum(x[a + k] == y[c + k] for k in range(width)) >= spaced_seeds.PERCENT * width for a in range(len(x) - width + 1) for c in range(len(y) - width + 1)):
            out.add((i, j))
    return out


def test_contamination(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(500)]
    words = lambda n: list(rng.choice(vocabulary, n))
    items = [(j, words(int(rng.integers(1, 41)))) for j in range(12)]
    docs = []
    for i in range(40):
        own = words(80)
        if i % 2:
            passage = list(items[int(rng.integers(0, 12))][1])[: int(rng.integers(13, 20))]
            for k in rng.choice(len(passage), min(len(passage), int(rng.integers(0, 5))), replace=False):
                passage[k] = "changed"
            own[20:20] = passage
        docs.append((i, " ".join(own).upper() if i % 3 else " ".join(own)))
    items = [(j, " ".join(x)) for j, x in items]
    got = spaced_seeds.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_overlaps(docs, items)


def test_short_items_substituted(spark):
    """Items of 1 to 13 words, with every set of substitutions that 75 per cent allow and some more, against the brute force."""
    items, docs = [], []
    for n in range(1, 14):
        own = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        allowed = n - -(-spaced_seeds.PERCENT * n // 100)
        sets = [g for e in range(allowed + 1) for g in itertools.combinations(range(n), e)] + [tuple(range(allowed + 1))]
        docs += [(len(docs) + i, " ".join(["before", *("changed" if k in gone else w for k, w in enumerate(own)), "after"])) for i, gone in enumerate(sets)]
        docs.append((len(docs), " ".join(own)))
    items += [(20, "the the the the"), (21, "the cat the dog the")]
    docs += [(len(docs), "the the cat the the"), (len(docs) + 1, "cat the dog the"), (len(docs) + 2, "the the the")]
    want = brute_overlaps(docs, items)
    assert len(want) > len(docs) - 20 and {j for _, j in want} >= set(range(1, 14))
    got = spaced_seeds.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_frequent_seeds_are_listed_in_parts(spark):
    """Many items that share a phrase: the same pairs and places as by the brute force, a few hits at a time."""
    rng = np.random.default_rng(7)
    phrase = "which of the following is true about the given set of words".split()
    items = [(j, " ".join([*phrase, *(f"q{int(x)}" for x in rng.integers(0, 30, 8))])) for j in range(40)]
    docs = [(i, " ".join([*(f"q{int(x)}" for x in rng.integers(0, 30, 5)), *phrase[: int(rng.integers(6, 13))], *(f"q{int(x)}" for x in rng.integers(0, 30, 9))])) for i in range(20)]
    hashes = lambda texts: [spaced_seeds._words(pa.array([t], pa.large_string())).hash for t in texts]
    index = spaced_seeds.Index(np.arange(40), hashes([t for _, t in items]))
    w = spaced_seeds._words(pa.array([t for _, t in docs], pa.large_string()))
    whole = index.overlaps(w.hash, w.row, tn.row_starts(w.row, 20))
    assert {(int(r), int(i)) for r, i in whole[:2].T} == brute_overlaps(docs, items)
    hits, spaced_seeds.HITS = spaced_seeds.HITS, 7
    try:
        assert (index.overlaps(w.hash, w.row, tn.row_starts(w.row, 20)) == whole).all()
    finally:
        spaced_seeds.HITS = hits


def test_contamination_in_disguise(spark):
    """Case (accented letters too) and ASCII punctuation do not hide a passage; the positions count words."""
    passage = "L'été où les élèves ont déjà reçu ça à Genève, près du château fort"
    docs = [(1, "before it: " + "!! ".join(passage.upper().split()) + "!!"), (2, passage.replace(" ", " - ")), (3, passage.replace("é", "e").replace("è", "e")), (4, "(" + passage.upper().replace(" ", "...") + ")")]
    items = [(7, passage)]
    got = spaced_seeds.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_overlaps(docs, items) == {(1, 7), (2, 7), (4, 7)}
    assert {(r.doc_id, r.n_equal, r.doc_word, r.item_word) for r in got} == {(1, 13, 2, 0), (2, 13, 0, 0), (4, 13, 0, 0)}


def test_contamination_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (1, "a b c d e f g"), (5, "single")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = spaced_seeds.contaminated_pairs(edges(spark), items)
    assert sorted((str(r.doc_id), r.item_id, r.n_equal) for r in got.collect()) == [("1", 1, 7)] * 2 + [("7", 1, 7), ("None", 1, 7)]
    clean = spaced_seeds.decontaminate(edges(spark), items)
    assert clean.columns == edges(spark).columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4", "6", "8", "9", "None"]
    assert spaced_seeds.contaminated_pairs(edges(spark).limit(0), items).count() == 0
    assert spaced_seeds.contaminated_pairs(edges(spark), items.limit(0)).count() == 0


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    vocabulary = ["the", "and", "house", "river", "green", "walk", "under", "stone", "light", "garden", "over", "winter"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n)) + f" end{int(rng.integers(0, 10**9))}"
    item = " ".join(f"bench{i}" for i in range(30))
    base = prose(80)
    rows = [(i, prose(60)) for i in range(8)]
    rows += [(20, base), (21, base), (22, base + " more"), (30, prose(40) + " " + item + " " + prose(40)), (40, "12345 !!!"), (41, None), (42, "")]
    rows += [(50 + i, f"Copyright notice of the site, page {i}\n" + prose(60)) for i in range(4)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    # rejected: no letters; near copies: the first stays; benchmark passage: gone
    assert set(out) == {*range(8), 20, 50, 51, 52, 53}
    texts = {i: t for i, t in rows}
    assert all(piece_codec.decode([list(out[i].token_ids)]) == [texts[i]] for i in [*range(8), 20, 50])
    assert piece_codec.decode([list(out[51].token_ids)]) == [texts[51].split("\n")[1]]
    one = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, one, f"file://{tmp_path}").columns == one.columns, name
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_keeps_one_of_five_copies(spark, tmp_path):
    """Copies that line dedup empties leave no row; a document that was blank before does, in that stage."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = ["the", "and", "house", "river", "green", "walk", "under", "stone", "light", "garden", "over", "winter"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n)) + " end"
    copy = prose(30) + "\n\n" + prose(70)
    rows = [(i, prose(60)) for i in range(4)] + [(20 + i, copy) for i in range(5)] + [(40, " \n\t"), (41, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert set(out) == {*range(4), 20} and piece_codec.decode([list(out[20].token_ids)]) == [copy]
    assert {r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == {*range(4), 20, 40, 41}


def test_pipeline_stages_on_edge_cases(spark, tmp_path):
    """Empty table, null and repeated ids, null and blank texts, a very long text, columns that operators use themselves."""
    import corpus_pipeline

    spark.createDataFrame([(1, "the"), (2, "a b c d e f g h i j k l m n o"), (None, "x y z w"), (3, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = ["n_dropped", "n_dropped1", "rep", "component_id", "n_shingles", "leaf", "key", "parts", "template", "first", "score", "lang_pred", "item_id", "line", "kept"]
    rows = [(*r, "en", "s", len(r[1] or "")) for r in [*EDGES, (11, "the"), (12, "so the house of the river"), (13, "über a b c d e f g h i j k l m n o")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'{n}' as {n}" for n in names))
    want = {
        "language": [1, 1, 6, 7, 8, 9, 11, 12, 13, None],
        "line_dedup": [1, 1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, None],  # the template of doc 1 is in it and in 7 only
        "near_dedup": [1, 1, 2, 3, 4, 6, 8, 9, 11, 12, 13, None],
        "decontamination": [1, 1, 2, 3, 4, 6, 7, 8, 9, 12, None],
    }
    order = lambda x: sorted(x, key=lambda i: (i is None, i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and order(r.doc_id for r in out.select("doc_id").collect()) == order(want[name]), name
        none = stage(spark, docs.limit(0), f"file://{tmp_path}")
        assert none.columns == docs.columns and none.count() == 0
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, "").count() == len(rows) and last(spark, docs.limit(0), "").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert order(r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, "").select("doc_id").collect()) == order(want["language"])


def brute_pipeline(docs, items):
    """The stages from line dedup to decontamination on (doc_id, text) rows with distinct ids, as the contracts say it."""
    split = lambda x: tuple("" if re.search("[0-9]", w) else w for w in WORDS.findall(x))

    def templates(k):
        n, r = len(k), max(len(k) - 3, 0)
        part = lambda j: k[3 + j * r // 5 : 3 + (j + 1) * r // 5]
        for free in [(), *itertools.combinations(range(5), 2)]:
            yield n, free, k[:3], tuple(part(j) for j in range(5) if j not in free)

    seen = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if k := split(x):
                for m in templates(k):
                    seen.setdefault(m, set()).add(i)
    gone = lambda i, x: bool(k := split(x)) and any(len(seen[m]) >= (2 if m[0] > 50 else 3) and min(seen[m]) < i for m in templates(k))
    cut = []
    for i, t in docs:
        left = None if t is None else [x for x in t.split("\n") if not gone(i, x)]
        if t is None or len(left) == len(t.split("\n")) or WORDS.search("\n".join(left)):
            cut.append((i, t if t is None else "\n".join(left)))
    sets = {i: shingles(t, 5) for i, t in cut}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    group = clusters(sets, linked)
    cut = [(i, t) for i, t in cut if group[i] == i]
    bad = {i for i, _ in brute_overlaps(cut, items)}
    return {i: t for i, t in cut if i not in bad}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    table = duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    kept = language_id.keep_identified(spark.read.parquet(f"{SF}/documents.parquet"), language_id.train(spark.read.parquet(f"{SF}/documents.parquet")))
    known = {r.doc_id for r in kept.collect()}
    want = brute_pipeline([r[:2] for r in table if r[0] in known], items)
    out = corpus_pipeline.run(spark, SF)
    back = {r.doc_id: r.text for r in piece_codec.decode_documents(out).collect()}
    assert back == {i: t for i, t in want.items()} and len(back) < len(table) and out.where("not round_trip").count() == 0
