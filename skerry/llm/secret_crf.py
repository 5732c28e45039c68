"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags words as secret-begin (B), secret-inside (I) or outside (O) from
their shape, the words and characters around them and features of the whole
document, and is decoded by Viterbi.  It is fitted on a bounded sample of
documents in which the fixed patterns mark secrets, and in which secrets of other
forms are planted: other keywords and separators or none, keys in groups, in mixed
case or behind a prefix, beside decoys that are none.  So it finds what the
patterns miss; how sure it must be is chosen on documents held out of the fit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import textnum as tn
from skerry.llm.sampling import low_rows, window

#: Kinds of the base patterns in their order, pattern, group that is measured, its least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 20),
    ("hex", r"[0-9a-f]+", re.A, 0, 24),
)
_BASE = tuple((kind, re.compile(p if kind != "hex" else r"[0-9a-f]{24,}", flags), group, least) for kind, p, flags, group, least in BASE)
KINDS = ("assign", "access", "hex", "crf")

#: Documents that the fit reads at most, characters of each, words of a training sequence, rounds and seed.
SAMPLE, CHARACTERS, SEQUENCE, ROUNDS, SEED = 3000, 20_000, 48, 10, 7
#: Sequences without a secret in the fit; those with digits or joined words come first.
PLAIN = 2500
#: Secrets and decoys that are planted in the sample.
PLANTS = 1500
#: Scores that a word must gain over outside before it is tagged, of which the lowest is taken that gives this share of right spans on documents held out.
MARGINS, PRECISION = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0), 0.995
#: What stands before planted secrets, and between.
KEYWORDS = ("password", "passwd", "pwd", "passphrase", "secret", "client secret", "token", "bearer token", "api key", "apikey", "access key", "private key", "credential", "credentials", "auth", "auth key", "key", "login")
JOINTS = (" is ", " was ", " -> ", " => ", " := ", ": ", " = ", "=", ":", " | ", "\t", " ", ", ", " (", " <")
#: Letters, digits and + - . / _ and all bytes of other characters make words.
SEPARATORS = tuple(b for b in range(128) if not (chr(b).isalnum() or chr(b) in "+-./_"))
O, B, I = 0, 1, 2

_CLASS = np.full(256, 3, dtype=np.int8)  # upper, lower, digit, symbol, other
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
WORD_BUCKETS = 1 << 13
#: Feature groups and their sizes: own shape, length, digits, shape with changes; shapes of both neighbours; words before (two) and after; characters before and after; document.
SIZES = (32, 5, 8, 256, 33, 33, WORD_BUCKETS + 1, WORD_BUCKETS + 1, WORD_BUCKETS + 1, 257, 257, 27)
_FIRST = np.concatenate([[0], np.cumsum(SIZES)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[tn.Words, np.ndarray]:
    """Words of a block of texts, and their (words, groups) indices into the weights."""
    w = tn.words(data, offsets, SEPARATORS)
    n, lo = len(w.hash), int(offsets[0])
    if not n:
        return w, np.zeros((0, len(SIZES)), np.int64)
    d = data[lo : int(offsets[-1])]
    s, e = w.start - lo, w.end - lo
    cls = _CLASS[d]
    count = np.stack([np.concatenate([[0], np.cumsum(cls == c, dtype=np.int32)]) for c in range(5)])
    own = count[:, e] - count[:, s]
    size = e - s
    shape = ((own > 0) * np.array([1, 2, 4, 8, 16])[:, None]).sum(axis=0)
    change = np.concatenate([[0], np.cumsum(np.diff(cls, prepend=cls[:1]) != 0, dtype=np.int32)])
    changes = change[e] - change[s + 1]
    length = np.searchsorted((4, 8, 12, 16), size, side="right")
    digits = np.where(own[2] == 0, 0, 1 + np.minimum(own[2] * 6 // size, 6))
    changes = shape * 8 + np.minimum(np.ceil(np.log2(changes + 1)).astype(np.int64), 7)
    word = np.where((size <= 16) & (own[2] == 0), (w.hash % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS)

    def near(x: np.ndarray, by: int, none: int) -> np.ndarray:
        out = np.full(n, none)
        a, b = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
        out[a] = np.where(w.row[a] == w.row[b], x[b], none)
        return out

    rel = offsets - lo
    head, tail = rel[w.row], rel[w.row + 1]
    before = np.where(s > head, d[np.maximum(s - 1, 0)].astype(np.int64), 256)
    after = np.where(e < tail, d[np.minimum(e, len(d) - 1)].astype(np.int64), 256)
    row = np.arange(len(offsets) - 1)
    share = lambda c: (count[c][rel[row + 1]] - count[c][rel[row]]) / np.maximum(1, np.diff(rel))
    level = lambda x, cuts: np.searchsorted(cuts, x)
    document = level(share(2), (0.01, 0.05)) * 9 + level(share(3), (0.2, 0.3)) * 3 + level(np.diff(rel), (300, 3000))
    groups = (shape, length, digits, changes, near(shape, 1, 32), near(shape, -1, 32), near(word, 1, WORD_BUCKETS), near(word, 2, WORD_BUCKETS), near(word, -1, WORD_BUCKETS), before, after, document[w.row])
    return w, np.stack([g + f for g, f in zip(groups, _FIRST, strict=False)], axis=1)


@dataclass
class Field:
    weight: np.ndarray  # (features, 3)
    change: np.ndarray  # (3, 3), from and to
    margin: float = 0.0

    def emissions(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(index), 3), dtype=np.float32)
        for g in range(index.shape[1]):
            out += self.weight[index[:, g]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(field: Field, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of the sequences' log likelihoods, its gradients by weight and change); ``x`` is (sequences, words, groups), -1 past the end."""
    real = x[:, :, 0] >= 0
    m, length = real.shape
    e = np.zeros((m, length, 3))
    e[real] = field.emissions(x[real])
    t = field.change.astype(float)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for i in range(1, length):
        step = e[:, i] + _log_sum(a[:, i - 1, :, None] + t, 1)
        a[:, i] = np.where(real[:, i, None], step, a[:, i - 1])
    for i in range(length - 2, -1, -1):
        step = _log_sum(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        b[:, i] = np.where(real[:, i + 1, None], step, 0.0)
    z = _log_sum(a[:, -1], 1)
    miss = (np.eye(3)[y] - np.exp(a + b - z[:, None, None]))[real]
    grad = np.zeros(field.weight.shape)
    index = x[real]
    for g in range(x.shape[2]):
        for tag in range(3):
            grad[_FIRST[g] : _FIRST[g + 1], tag] = np.bincount(index[:, g] - _FIRST[g], miss[:, tag], minlength=SIZES[g])
    pair = np.exp(a[:, :-1, :, None] + t + (e + b)[:, 1:, None, :] - z[:, None, None, None])
    both = real[:, 1:]
    told = np.bincount(3 * y[:, :-1][both].astype(np.int64) + y[:, 1:][both], minlength=9).reshape(3, 3)
    own = np.take_along_axis(e, y[:, :, None].astype(np.int64), axis=2)[:, :, 0][real].sum() + (told * t).sum()
    return float(own - z.sum()), grad, told - pair[both].sum(axis=0)


def fit(index: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood by AdaGrad; ``index`` is (sequences, words, groups), -1 past the end, ``tags`` (sequences, words)."""
    field = Field(np.zeros((int(_FIRST[-1]), 3), dtype=np.float32), np.zeros((3, 3), dtype=np.float32))
    g_w, g_t = np.full_like(field.weight, 1e-3), np.full_like(field.change, 1e-3)
    rng, n = np.random.default_rng(SEED), len(index)
    for _ in range(rounds if n else 0):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            _, grad, grad_t = likelihood(field, index[part], tags[part])
            grad, grad_t = grad / len(part) - 1e-3 * field.weight, grad_t / len(part)
            g_w += grad**2
            g_t += grad_t**2
            field.weight += 0.3 * grad / np.sqrt(g_w)
            field.change += 0.3 * grad_t / np.sqrt(g_t)
    np.clip(field.change, -12, 12, out=field.change)
    return field


def viterbi(e: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Best tags of sequences of one length: (sequences, words, 3) to (sequences, words)."""
    n, length, _ = e.shape
    back = np.zeros((n, length, 3), dtype=np.int8)
    value = e[:, 0]
    for i in range(1, length):
        to = value[:, :, None] + change
        back[:, i] = to.argmax(axis=1)
        value = to.max(axis=1) + e[:, i]
    out = np.empty((n, length), dtype=np.int8)
    out[:, -1] = value.argmax(axis=1)
    for i in range(length - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


def decode(field: Field, e: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Viterbi tags of the words of a block, each row one sequence.

    A word whose outside score leads by more than its neighbours' changes could
    ever give back is outside on the best path, so the chain falls apart there and
    only the stretches between are searched; the result is that of the whole chain.
    """
    n = len(e)
    tags = np.zeros(n, dtype=np.int8)
    e = e + np.array([field.margin, 0, 0], dtype=e.dtype)
    t = np.vstack([field.change, np.zeros((1, 3))])  # before the first word nothing is scored
    t = np.hstack([t, np.zeros((4, 1))])  # nor after the last
    gain = [max(t[p, x] + t[x, q] - t[p, O] - t[O, q] for p in range(4) for q in range(4)) for x in (B, I)]
    open_ = (e[:, O] - e[:, B] <= gain[0]) | (e[:, O] - e[:, I] <= gain[1])
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
    first, last = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1]
    # A closed word beside a stretch in the same row is outside: its change is scored.
    left = (first > 0) & (row[first - 1] == row[first])
    right = (last + 1 < n) & (row[np.minimum(last + 1, n - 1)] == row[last])
    size = last - first + 1
    for length in np.unique(size):
        for own in np.array_split(np.flatnonzero(size == length), max(1, int((size == length).sum() * length) // 200_000)):
            x = e[first[own][:, None] + np.arange(length)].astype(np.float64)
            x[left[own], 0] += field.change[O]
            x[right[own], -1] += field.change[:, O]
            tags[first[own][:, None] + np.arange(length)] = viterbi(x, field.change)
    return tags


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    for order, (kind, pattern, group, least) in enumerate(_BASE):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def _points(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Code point number of each byte of lo:hi, and of its end."""
    return np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)]) - np.append((data[lo:hi] & 0xC0) == 0x80, False)


def plant(rng: np.random.Generator) -> tuple[str, int, int]:
    """A phrase with a secret that may fit no pattern, and the secret's bounds; a decoy has the bounds 0, 0."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda letters, low, high: "".join(pick(letters) for _ in range(int(rng.integers(low, high + 1))))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if rng.random() < 0.35:
        word = lambda: some(lower, 2, 9)
        number = lambda n: some(digits, n, n)
        decoys = (
            lambda: f"{pick(KEYWORDS)}{pick(JOINTS)}{word()} {word()}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{word()}.{number(2)}@{word()}.{word()}.com",
            lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"https://www.{word()}.org/{word()}/{word()}-{word()}-{number(4)}", lambda: f"v{number(1)}.{number(2)}.{number(1)}",
            lambda: f"{number(int(rng.integers(1, 4)))}.{number(2)}.{number(3)}.{number(2)}", lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: f"/{word()}/{word()}_{word()}.txt", lambda: number(int(rng.integers(5, 13))),
        )
        return pick(decoys)(), 0, 0
    mixed = lower + upper + digits
    forms = (
        lambda: some("0123456789abcdef", 16, 40), lambda: some("0123456789ABCDEF", 16, 40), lambda: some(mixed, 18, 44), lambda: some(mixed + "+/", 24, 48),
        lambda: pick("-._").join(some(pick((mixed, "0123456789abcdef", upper + digits)), 4, 8) for _ in range(int(rng.integers(3, 6)))), lambda: f"{some(lower, 2, 4)}_{some(mixed, 16, 36)}",
    )
    secret = pick(forms)()
    quote = pick(("", "", '"', "'"))
    before = "" if rng.random() < 0.2 else pick(KEYWORDS) + pick(JOINTS)
    before = (before.upper() if rng.random() < 0.15 else before) + quote
    return before + secret + quote, len(before), len(before) + len(secret)


def _marked(texts: list[str], n_plants: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts with plants between words, and the bounds of each text's secrets, planted or found by the patterns."""
    rng = np.random.default_rng(SEED)
    each = np.bincount(rng.integers(0, len(texts), n_plants), minlength=len(texts)) if texts else []
    out, marks = [], []
    for text, n in zip(texts, each, strict=True):
        planted = []
        for _ in range(n):
            phrase, a, z = plant(rng)
            at = text.find(" ", int(rng.integers(0, len(text) + 1))) + 1 or len(text)
            if any(x <= at <= y for x, y in planted):
                continue
            planted = [(x + len(phrase) + 2, y + len(phrase) + 2) if x >= at else (x, y) for x, y in planted]
            text = f"{text[:at]} {phrase} {text[at:]}"
            if z:
                planted.append((at + 1 + a, at + 1 + z))
        for x, z, kind in base_spans(text):
            planted.append((z - len(re.search(r"[A-Za-z0-9+/_.=-]*$", text[x:z])[0]) if kind == "assign" else x, z))
        out.append(text)
        marks.append(planted)
    return out, marks


def _training(texts: list[str], marks: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of the documents' words: all that hold a secret, and ``PLAIN`` that hold none."""
    data, offsets = tn.buffers(pa.array(texts, pa.large_string()))
    index, tags, plain, hard, n_hard = [], [], [], [], 0
    rng = np.random.default_rng(SEED)
    for lo, hi in tn.blocks(offsets):
        w, f = features(data, offsets[lo : hi + 1])
        f = f.astype(np.int32)
        bounds = tn.row_starts(w.row, hi - lo)
        for r in range(hi - lo):
            a, b = int(bounds[r]), int(bounds[r + 1])
            y = np.zeros(b - a, dtype=np.int8)
            if marks[lo + r]:
                at = _points(data, int(offsets[lo + r]), int(offsets[lo + r + 1]))
                s, e = at[w.start[a:b] - offsets[lo + r]], at[w.end[a:b] - offsets[lo + r]]
                for x, z in sorted(marks[lo + r]):
                    hit = np.flatnonzero((s < z) & (e > x))
                    if len(hit):
                        y[hit[1:]] = I
                        y[hit[0]] = B
            for i in range(0, b - a, SEQUENCE):
                j = min(i + SEQUENCE, b - a)
                fx, yx = np.full((SEQUENCE, len(SIZES)), -1, dtype=np.int32), np.zeros(SEQUENCE, dtype=np.int8)
                fx[: j - i], yx[: j - i] = f[a + i : a + j], y[i:j]
                if yx.any():
                    index.append(fx)
                    tags.append(yx)
                elif ((f[a + i : a + j, 0] & 12) > 0).any():
                    n_hard += 1
                    if len(hard) < PLAIN:
                        hard.append(fx)
                    elif (at := int(rng.integers(n_hard))) < PLAIN:  # each hard sequence stays with equal chance
                        hard[at] = fx
                elif len(plain) < PLAIN:
                    plain.append(fx)
    plain = (hard + plain)[:PLAIN]
    return np.array(index + plain, dtype=np.int32).reshape(-1, SEQUENCE, len(SIZES)), np.array(tags + [np.zeros(SEQUENCE, np.int8)] * len(plain), dtype=np.int8).reshape(-1, SEQUENCE)


def _spans(tags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) word of every tagged span."""
    before = np.concatenate([[O], tags[:-1]])
    begin = np.flatnonzero((tags == B) | ((tags == I) & ((before == O) | (np.diff(row, prepend=-1) != 0))))
    tagged = np.flatnonzero(tags != O)
    return begin, tagged[np.append(np.searchsorted(tagged, begin[1:]), len(tagged)) - 1] if len(begin) else begin


def quality(field: Field, index: np.ndarray, tags: np.ndarray) -> tuple[float, float]:
    """(precision, recall): share of found spans that touch a secret, and of secrets that a found span touches."""
    real = index[:, :, 0] >= 0
    row = np.repeat(np.arange(len(index)), real.sum(axis=1))
    want = tags[real]
    got = decode(field, field.emissions(index[real]), row)
    touched = lambda spans, other: [bool((other[a : b + 1] != O).any()) for a, b in zip(*spans, strict=True)]
    right, found = touched(_spans(got, row), want), touched(_spans(want, row), got)
    return (sum(right) / len(right) if right else 1.0), (sum(found) / len(found) if found else 1.0)


def fit_texts(texts: list[str]) -> Field:
    """A field fitted on four fifths of the texts, its margin chosen on the others."""
    marked, marks = _marked(texts, PLANTS * min(len(texts), SAMPLE) // SAMPLE + 1 if texts else 0)
    part = lambda keep: _training([t for i, t in enumerate(marked) if keep(i)], [m for i, m in enumerate(marks) if keep(i)])
    field = fit(*part(lambda i: i % 5))
    rest = part(lambda i: i % 5 == 0)
    for field.margin in MARGINS:
        if quality(field, *rest)[0] >= PRECISION:
            break
    return field


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on a window of at most CHARACTERS of each of the ``sample`` documents lowest by a hash of doc_id."""
    ids = low_rows(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id")), sample).distinct()
    ids = ids.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").where("text is not null")
    rows = rows.select("doc_id", window("text", "doc_id", CHARACTERS).alias("text"))
    return fit_texts([r.text for r in sorted(rows.toLocalIterator())][:sample])


_EMPTY = hashlib.sha256(b"").hexdigest()


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            data, offsets = tn.buffers(batch.column(1))
            for lo, hi in tn.blocks(offsets):
                w, f = features(data, offsets[lo : hi + 1])
                begin, stop = _spans(decode(field, field.emissions(f), w.row), w.row)
                added: dict[int, list] = {}
                for a, z in zip(begin.tolist(), stop.tolist(), strict=True):
                    added.setdefault(int(w.row[a]), []).append((int(w.start[a]), int(w.end[z])))
                n = hi - lo
                counts, digest, joined_spans = np.zeros((4, n), dtype=np.int64), [_EMPTY] * n, [""] * n
                for r, text in enumerate(batch.column(1).slice(lo, n).to_pylist()):
                    base = base_spans(text) if text else []
                    if not base and r not in added:
                        continue
                    for _, _, kind in base:
                        counts[KINDS.index(kind), r] += 1
                    more = []
                    if r in added:
                        p, q = int(offsets[lo + r]), int(offsets[lo + r + 1])
                        at = _points(data, p, q)
                        spans = [(int(at[a - p]), int(at[z - p]), "crf") for a, z in added[r]]
                        more = [s for s in spans if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]
                        counts[3, r] = len(more)
                    digest[r] = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
                    joined_spans[r] = ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), *(pa.array(c) for c in counts[:3]), pa.array(digest, pa.string()), pa.array(joined_spans, pa.string()), pa.array(counts[3])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
                )

    return run


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    ``docs`` has doc_id (long, may be null) and text; other columns are not read.  A
    null text counts as empty and has no spans.  Positions count code points, end
    exclusive, of the whole match.  ``spans`` lists the base patterns' spans and the
    field's (kind ``crf``) that touch none of them, by start, then kind.  Repeated
    rows are each returned; an empty table gives an empty result.  Very long texts
    are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _run(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
    )


def op5_secret_crf(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
