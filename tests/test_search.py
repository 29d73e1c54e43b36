"""Searches that read only what may matter, against reading everything."""

import random
import sqlite3
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.functions.stemming import stem
from scrivia.operators import catalog, content, early_stop, evals, vectors
from scrivia.plans.built import index_of
from scrivia.storage import materialise

SF = "/root/testdata/sf0.001"


# --- vectors ----------------------------------------------------------------


@pytest.mark.parametrize("cap", [None, 2])
def test_vector_search_skips_blocks_and_loses_nothing(spark, cap):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    x = centres[np.arange(3000) % 30] + 0.1 * rng.standard_normal((3000, 16))
    groups = [f"g{i % 600}" for i in range(3000)]
    rows = spark.createDataFrame([(f"v{i:04d}", [float(c) for c in v], g, "p") for i, (v, g) in enumerate(zip(x, groups))], "id string, embedding array<double>, `group` string, part string")
    index = vectors.build(rows, pivots=30, block_rows=40)
    asked = list(range(0, 3000, 50))
    queries = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in asked], "q long, embedding array<double>")
    counted: dict = {}
    got: dict = {}
    for r in vectors.search(index, queries, 10, cap, part="p", counted=counted, query_rows=8).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.id
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i in asked:
        seen: dict = {}
        want = []
        for j in np.argsort(-(unit @ unit[i]), kind="stable"):
            seen[groups[j]] = seen.get(groups[j], 0) + 1
            if cap is None or seen[groups[j]] <= cap:
                want.append(f"v{j:04d}")
        assert [got[i][r + 1] for r in range(10)] == want[:10]
    assert counted["multiplied"] < counted["pairs"] / 2
    assert vectors.search(index, queries, 10, part="none").count() == 0


def test_vector_search_odd_rows(spark):
    ddl = "id long, embedding array<double>"
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0])]
    index = vectors.build(spark.createDataFrame(rows, ddl))
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "q long, embedding array<double>")
    got = vectors.search(index, queries, 50).collect()
    # equal directions tie by id; all that can be compared are given
    assert sorted((r.q, r["rank"], r.id, round(r.score, 9)) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, -1.0)]
    none = vectors.build(spark.createDataFrame([], ddl))
    assert vectors.search(none, queries, 5).count() == 0


# --- keywords ---------------------------------------------------------------


def _collection(spark, docs=400):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(docs):
        for p in range(3):
            text = rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(5, 60))
            # a few chunks where a word is far denser than anywhere else
            rows.append((f"d{d:03d}@A#{p}", f"d{d:03d}", "A" if d % 4 else "B", p, " ".join(text + ["w30"] * (20 if d in (17, 250) else 0) + ["rare"] * (d == 99))))
    return materialise(spark.createDataFrame(rows, "chunk_id string, doc_id string, revision string, position int, text string"), "collection")


def test_early_stop_reads_few_blocks_and_finds_the_same(spark):
    chunks = _collection(spark)
    post = materialise(content.postings(chunks), "post")
    figures = content.corpus_figures(post, chunks)
    directory = materialise(early_stop.numbered(chunks), "directory")
    index = early_stop.Blocks(directory, materialise(early_stop.blocked(post, directory, window=8), "blocks"))
    eligible = chunks.where("revision = 'A'").select("doc_id", "revision").distinct()
    asks = [["w30"], ["W30", "w1"], ["w30", "w30", "w5"], ["rare", "w2"], ["rare", "zzz"], ["zzz"], ["w0", "w1", "w2"], ["rare", "w59", "w58"]]
    queries = spark.createDataFrame(list(enumerate(asks)), "q long, terms array<string>")
    got: dict = {}
    counted: dict = {}
    for r in early_stop.top_k(index, figures, queries, 5, eligible, counted).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.chunk_id, round(r.score, 6))
    shown = {(r.doc_id, r.revision) for r in eligible.collect()}
    place = {r.chunk_id: (r.doc_id, r.revision) for r in chunks.collect()}
    for q, terms in enumerate(asks):
        want, seen = [], {}
        scores = content.keyword_scores(post, figures, terms).collect()
        for r in sorted(scores, key=lambda r: (round(r.score, 9), r.chunk_id)):
            doc = place[r.chunk_id]
            if doc in shown and seen.setdefault(doc[0], 0) < 2 and len(want) < 5:
                seen[doc[0]] += 1
                want.append((r.chunk_id, round(r.score, 6)))
        assert [got.get(q, {}).get(i + 1) for i in range(len(want))] == want and len(got.get(q, {})) == len(want), terms
    # one word with two dense places: the bounds rule out nearly all of its blocks
    few: dict = {}
    assert early_stop.top_k(index, figures, queries.where("q = 0"), 4, None, few).count() == 4
    assert few["read"] < few["held"] / 4
    assert early_stop.top_k(index, figures, queries.limit(0), 5).count() == 0


def test_blocks_of_later_chunks_stand_beside_earlier_ones(spark):
    chunks = _collection(spark, 60)
    early, late = chunks.where("doc_id < 'd030'"), chunks.where("doc_id >= 'd030'")
    directory = materialise(early_stop.numbered(early), "directory")
    more = materialise(early_stop.numbered(late, early_stop.next_number(directory, 8)), "directory")
    assert directory.join(more, "number").count() == 0
    post = content.postings(chunks)
    figures = content.corpus_figures(post, chunks)
    parts = [early_stop.blocked(content.postings(c), d, window=8) for c, d in ((early, directory), (late, more))]
    assert parts[0].join(parts[1], ["term", "window"]).count() == 0
    grown = early_stop.Blocks(directory.unionAll(more), materialise(parts[0].unionAll(parts[1]), "blocks"))
    whole = materialise(early_stop.numbered(chunks), "directory")
    rebuilt = early_stop.Blocks(whole, materialise(early_stop.blocked(post, whole, window=8), "blocks"))
    queries = spark.createDataFrame([(0, ["w30", "w3"]), (1, ["w7"])], "q long, terms array<string>")
    found = [sorted((r.q, r["rank"], r.chunk_id, round(r.score, 9)) for r in early_stop.top_k(i, figures, queries, 6).collect()) for i in (grown, rebuilt)]
    assert found[0] == found[1] and len(found[0]) == 12


# --- similarity -------------------------------------------------------------


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio_by_bits(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdeéß0") for _ in range(n))
    pairs = [(word(rng.randint(0, 12)), word(rng.randint(0, 14))) for _ in range(300)]
    # at and beyond what a long holds, and odd ends
    pairs += [(word(62), word(70)), (word(62), word(62)), (word(63), word(64)), (word(90), word(5)), ("", ""), ("a", ""), ("", "b"), ("materails", "materials")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio("a", "b").alias("r")).collect()
    for r in got:
        assert abs(r.r - (200 * _lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 100)) < 1e-9


def test_filters_lose_no_near_token(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgpqr0149") for _ in range(rng.randint(2, 15)))
    held, asked = sorted({word() for _ in range(400)} | {"x" * 70}), sorted({word() for _ in range(30)} | {"x" * 66})
    found = catalog.near_tokens(spark.createDataFrame([(t,) for t in held], "t string"), spark.createDataFrame([(t,) for t in asked], "token string"))
    want = {(a, b): 200 * _lcs(a, b) / (len(a) + len(b)) for a in asked for b in held}
    got = {(r.token, r.t): r.r for r in found.collect()}
    assert got.keys() == {k for k, v in want.items() if v >= 55} and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_many_catalog_queries_at_once(spark):
    c = catalog.chains(index_of(spark, SF)["documents"])
    first = c.orderBy("doc_id").first()
    asks = ["bill of materails", first.doc_id, f"{first.type.lower()} {int(first.doc_id.split('-')[-1])}", "quixotic zebra", "the of", first.title]
    together = catalog.matches(c, spark.createDataFrame(list(enumerate(asks)), "q long, query string")).collect()
    for q, ask in enumerate(asks):
        # one by one, every chain held against the query
        alone = {r.doc_id: r.score for r in catalog.scored(c, ask).collect() if r.score > 0}
        by_id = {r.doc_id for r in c.where(catalog.id_score(F.lit(ask), F.col("doc_id"), F.col("type")) == 100).collect()}
        mine = {r.doc_id: r.score for r in together if r.q == q}
        assert mine == pytest.approx(alone) and all(mine[i] == 100 for i in by_id)
    assert {r.q for r in together} >= {0, 1, 2} and not any(r.q == 4 for r in together)


# --- tokens -----------------------------------------------------------------


def _fts5(texts):
    """The tokens of each text by SQLite's own tokeniser."""
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    c.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    out: dict = {i: [] for i in range(len(texts))}
    for term, doc, offset in c.execute("SELECT term, doc, offset FROM v"):
        out[doc].append((offset, term))
    return [[t for _, t in sorted(out[i])] for i in range(len(texts))]


def test_tokens_against_fts5(spark):
    blocks = [*range(0x21, 0x250), *range(0x1E00, 0x1F00), *range(0x2C60, 0x2C80), *range(0xA722, 0xA790), *range(0xAB30, 0xAB5B), *range(0xFF21, 0xFF5B)]
    texts = [f"a{chr(i)}b {chr(i)}" for i in blocks if unicodedata.category(chr(i)) != "Cn"]
    texts += [f"s{chr(i)}koda o{chr(i)}" for i in range(0x300, 0x370)] + ["škoda ő łodź Prüfung İstanbul", "ſtraße ÆØÅ ế ǽ", "", "́ a ́b", "x1²ⅷ y"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(T.word_tokens("x").alias("t")).collect()]
    assert got == _fts5(texts)


def test_stems_of_any_word_against_fts5():
    rng = random.Random(3)
    ends = "sses ies ss s eed ed ing ational ization fulness ousness icate ment ion e ll y 2s 10 ée éing".split()
    words = sorted({"".join(rng.choice("abcdeiouyst") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(3000)} | {"łoding", "naïveness", "a" * 63 + "s", "a" * 64 + "s", "ab"})
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 0')")
    c.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = {words[doc]: term for term, doc in c.execute("SELECT term, doc FROM v")}
    assert {w: stem(w) for w in words} == want


def test_problems_of_answers(spark):
    rows = [
        (1, "All of it [A-1 Rev A]", ["ALL", "none"], True, ["A-1", "B-2"]), (2, "no source", None, True, None), (3, "no source", [], False, []),
        (4, "[A-1 Rev Z] and [A-1 Rev A]", None, None, None), (5, None, ["x"], True, ["A-1"]),
    ]
    answers = spark.createDataFrame(rows, "id long, answer string, contains array<string>, require_citations boolean, must_cite array<string>")
    documents = spark.createDataFrame([("A-1", "A")], "doc_id string, revision string")
    got = {r.id: (r.missing, r.no_citations, r.uncited, r.invalid) for r in evals.problems(answers, documents, ["id"]).collect()}
    assert got == {1: (1, False, 1, 0), 2: (0, True, 0, 0), 3: (0, False, 0, 0), 4: (0, False, 0, 1), 5: (1, True, 1, 0)}
