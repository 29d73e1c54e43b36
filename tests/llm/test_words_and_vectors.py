"""Spelling variants, nearest neighbours and whitening against brute force, and their odd rows."""

import collections
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivia.llm import neighbours, queries, spelling, whitening

# --- spelling ---------------------------------------------------------------


def _words(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling._UPPER, spelling._LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _variants(words):
    near = {a: [b for b in words if _one_edit(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 10 * words[a]:
            form[a] = best

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {(a, form.get(a), root(a), words[a], len(near[a]), words[form[a]] if a in form else None) for a in words}


def _told(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _spelled(spark, docs):
    found = spelling.noisy_runs(spelling.runs(docs, least_length=7))
    words = spark.createDataFrame(spelling.vocabulary(found).collect(), "word string, n long")
    return spelling.variants(words)


def test_spelling_against_brute_force(spark):
    rng = np.random.default_rng(2)
    letters = list("abcdéüßzoÿ")
    stems = ["".join(rng.choice(letters, size=rng.integers(7, 12))) for _ in range(60)]
    texts = []
    for s in stems:
        for _ in range(int(rng.choice([2, 3, 40]))):
            texts.append(s)
        for _ in range(6):
            at, how = rng.integers(0, len(s)), rng.integers(0, 3)
            other = s[:at] + (rng.choice(letters) if how else "") + s[at + (how != 2) :]
            texts += [other] * int(rng.integers(2, 4))
    # two-letter words share all their bigrams; a long family of near words around one hub
    texts += ["".join(rng.choice(["a", "b"], size=9)) for _ in range(400)]
    texts += [f"variante{c}" for c in "abcdefghijklmnopq" for _ in range(2)] + ["variante"] * 500
    rng.shuffle(texts)
    rows = [(int(i), " ".join(texts[i * 5 : i * 5 + 5])) for i in range(len(texts) // 5 + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = _words(rows)
    assert len(words) > 300
    assert _told(_spelled(spark, docs)) == _variants(words)


def test_spelling_odd_rows(spark):
    long_run = "ab" * 3000
    rows = [
        (None, "Straßennamen STRAßENNAMEN straßennamen ÉCOLIERS écoliers"), (None, None), (3, ""), (4, "\n 12 %"),
        (5, f"{long_run} {long_run}c"), (5, f"{long_run} {long_run}c"), (6, "kilometre×kilometre kilometre×kilometre, kilometer"),
    ]
    ddl = "doc_id long, text string, word string, n int, `len` int, gram string, `a.b` int, run string"
    docs = spark.createDataFrame([(i, t, "w", 1, 2, "g", 3, "r") for i, t in rows], ddl)
    got = _told(_spelled(spark, docs))
    assert got == _variants(_words(rows))
    assert any(w == long_run for w, *_ in got) and any("×" in w for w, *_ in got)
    assert _spelled(spark, docs.limit(0)).count() == 0
    # ids of any type
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert _told(_spelled(spark, named)) == _variants(_words([(None if i is None else f"d{i}", t) for i, t in rows]))


def test_roots_follow_long_chains(spark):
    words = [("a" * 7 + "bcdefghi"[:i], 2 * 10 ** (8 - i)) for i in range(9)]
    got = spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.root for r in got} == {"a" * 7} and sum(r.form is None for r in got) == 1


# --- neighbours -------------------------------------------------------------


def _search(spark, rows, k, every=20, segment_rows=64, query_rows=16):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, row string, q int, `a.b` int, node int")
    usable = neighbours.usable(docs)
    index = neighbours.build_index(usable, k, segment_rows)
    found = neighbours.nearest(index, usable.where(F.col("vec_id") % every == 0), k, query_rows)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def _pad(rows):
    return [(i, v, 0.5, "x", 1, 2, 3) for i, v in rows]


def _exact(vectors, k, every=20):
    """(query_id, rank) -> (vec_id, score) over distinct ids."""
    ids = np.array([i for i, _ in vectors])
    m = np.array([v for _, v in vectors])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = m @ m[q]
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if j != q][:k]
        out |= {(int(ids[q]), r + 1): (int(ids[j]), scores[j]) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms"])
def test_neighbours_recall(spark, kind):
    rng = np.random.default_rng(4)
    n, d = 1500, 24
    v = rng.standard_normal((n, d))
    if kind == "clusters":
        v = rng.standard_normal((30, d))[rng.integers(0, 30, n)] + 0.1 * v
    if kind == "norms":
        v *= np.exp(rng.standard_normal(n) * 2)[:, None]
    else:
        v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    want = _exact(rows, 10)
    got = {(q, r): (i, s) for q, r, i, s in _search(spark, _pad(rows), 10)}
    assert got.keys() == want.keys()
    pairs = lambda x: {(q, i) for (q, _), (i, _) in x.items()}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(want)
    m = dict(rows)
    assert all(abs(s - np.dot(m[q], m[i])) <= 1e-9 * max(1, abs(s)) for (q, _), (i, s) in got.items())


def test_neighbours_odd_rows(spark):
    v = [1.0, 2.0, -1.0]
    rows = [(0, v), (1, v), (2, v), (2, v), (None, v), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [1.0, float("inf"), 2.0])]
    rows += [(8, []), (9, [-1.0, -2.0, 1.0]), (10, [1e-170, 0.0, 0.0]), (20, [3.0, 4.0]), (40, [4.0, 3.0]), (60, v)]
    got = _search(spark, _pad(rows), 5)
    of = lambda q: [(i, round(s, 9)) for a, _, i, s in got if a == q]
    # its own row is left out, rows of equal vectors are not; the null id comes last of a tie
    assert of(0) == [(1, 6.0), (2, 6.0), (2, 6.0), (60, 6.0), (None, 6.0)]
    assert of(60) == [(0, 6.0), (1, 6.0), (2, 6.0), (2, 6.0), (None, 6.0)]
    # vectors of another length are searched among their own
    assert of(20) == [(40, 24.0)] and of(40) == [(20, 24.0)]
    assert {q for q, *_ in got} == {0, 20, 40, 60}
    assert _search(spark, [], 5) == []


def test_neighbours_of_a_very_common_vector(spark):
    rng = np.random.default_rng(5)
    common = [0.6, 0.8, 0.0, 0.0]
    rows = [(i, common if i % 3 else [float(x) for x in rng.standard_normal(4)]) for i in range(900)]
    got = _search(spark, _pad(rows), 20)
    for q in (20, 40, 100):
        mine = [(r, i) for a, r, i, _ in got if a == q]
        scores = {i: float(np.dot(rows[i][1], common)) for i in range(900) if i != q}
        assert [i for _, i in mine] == sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:20]


# --- whitening --------------------------------------------------------------


def _whiten_exactly(x):
    """Deviations of rows and the covariance of distinct rows, in fractions."""
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n for j in range(d)] for i in range(d)]
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], np.array([float(m) for m in mean]), np.array(cov, dtype=float)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_against_exact_fractions(spark, scale):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((150, 6)) * [5, 3, 2, 1, 0.5, 0.1] * scale
    v = np.concatenate([v, v[:40]])
    docs = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(docs).collect()
    x = np.floor(256 * v)
    n, deviation, mean, cov = _whiten_exactly([[int(c) for c in r] for r in x])
    values, axes = np.linalg.eigh(cov)
    assert len(got) == 4 * len(v) and {r.n for r in got} == {n}
    for k in range(4):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        want = (x - mean) @ axes[:, -1 - k] / np.sqrt(values[-1 - k])
        w = np.array([mine[i].whitened for i in range(len(v))])
        assert min(abs(w - want).max(), abs(w + want).max()) < 1e-9
        assert all(abs(r.explained / (values[-1 - k] / np.trace(cov)) - 1) < 1e-9 for r in mine.values())
        assert [mine[i].deviation for i in range(len(v))] == [e if e < 1 << 63 else None for e in deviation]
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_odd_rows(spark):
    ddl = "vec_id string, embedding array<float>, x string, n int, `a.b` int, v int"
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 2.0]), ("b", [2.0, 2.0]), ("a", [1.0, 2.0]), (None, [4.0, 2.0]), ("c", None), ("d", [1.0, None]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", []), ("h", [1.0, 2.0, 3.0]), ("i", [3e38, 1.0])]
    docs = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], ddl)
    got = whitening.whiten(docs).collect()
    # two components of two entries; the second has no variance
    assert sorted(((r.vec_id or "", r.component) for r in got)) == sorted((i, c) for i in ("a", "a", "b", "") for c in (1, 2))
    assert {r.n for r in got} == {3} and all((r.whitened is None) == (r.component == 2) for r in got)
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 for r in got)
    one = whitening.whiten(docs.where("vec_id = 'b'")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, None)] * 2
    assert whitening.whiten(docs.limit(0)).count() == 0


def test_residues_are_put_together():
    moduli = whitening.primes(10**30)
    assert np.prod([float(p) for p in moduli]) > 1e30 and all(p < 1 << 22 for p in moduli)
    for value in (0, 1, -1, 10**29, -(10**29) + 7):
        assert whitening.reconstructed([(value % p, p) for p in moduli]) == value


def test_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op12_neighbours"](spark, sf)
    assert rows.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    v = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(q, i) for (q, _), (i, _) in _exact(v, 20).items()}
    assert len({(r.query_id, r.vec_id) for r in rows.collect()} & want) >= 0.9 * len(want)
    white = queries.QUERIES["op13_whitening"](spark, sf)
    assert [t for _, t in white.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"] and white.count() == 4 * len(v)
