import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivia.operators import batches, catalog, content, early_stop
from scrivia.storage import materialise

K = 10


def test_nearest_titles_are_those_of_scoring_every_pair(spark, monkeypatch):
    monkeypatch.setattr(batches, "SETS", 60)
    monkeypatch.setattr(batches, "ASKED", 7)
    r = random.Random(5)
    words = ["".join(r.choice("abcdef12") for _ in range(r.randint(2, 9))) for _ in range(40)] + ["x" * 70 + "ab" * 10, "materials", "plan"]
    docs = []
    for i in range(300):
        for rev in "AB"[: 1 + i % 2]:
            docs.append((f"{r.choice(['BOM', 'ECR', 'PLN'])}-P01-{i:03d}" if rev == "A" else docs[-1][0], rev, " ".join(r.choice(words) for _ in range(1 if i % 5 else 3)) if i % 9 else "same title", "", False, False, False, None))
    docs = [(d, rev, t, d.split("-")[0], s, o, e, v) for d, rev, t, _, s, o, e, v in docs]
    documents = spark.createDataFrame(docs, "doc_id string, revision string, title string, type_prefix string, is_signed boolean, is_obsolete boolean, is_empty boolean, sw_version string")
    asks = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(25)] + ["same titel", "ecr p01 001", "", "x" * 65 + "ab" * 12, "of the"]
    queries = spark.createDataFrame(list(enumerate(asks)), "q long, query string")
    c = catalog.chains(documents)

    def top(found):
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "doc_id"))
        return [tuple(x) for x in found.withColumn("rank", rank).where(F.col("rank") <= K).select("q", "rank", "doc_id", F.round("score", 6)).orderBy("q", "rank").collect()]

    every, few = catalog.matches(c, queries), batches.nearest(c, queries, K)
    assert top(few) == top(every) and top(few)
    # scores of all pairs never become rows: k a question and block of titles, k a question and type, identifiers
    blocks = 300 // 60 + 1
    assert few.count() <= len(asks) * K * (blocks + 3 + 1)
    assert few.groupBy("q").count().agg(F.max("count")).first()[0] <= K * (blocks + 3 + 1)


def test_best_chunks_are_those_of_the_block_search(spark, monkeypatch):
    monkeypatch.setattr(batches, "CHUNKS", 2 * early_stop.WINDOW)
    monkeypatch.setattr(batches, "ASKED", 28)
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(words, weights=range(30, 0, -1), k=r.randint(1, 25))) for _ in range(900)]
    texts = [texts[0] if i % 7 == 0 else t for i, t in enumerate(texts)] + ["rare w29 pair", ""]
    rows = [(f"D-{i // 6:03d}@{'AB'[i // 3 % 2]}#{i % 3}", f"D-{i // 6:03d}", "AB"[i // 3 % 2], i % 3, t) for i, t in enumerate(texts)]
    chunks = materialise(spark.createDataFrame(rows, "chunk_id string, doc_id string, revision string, position int, text string").coalesce(2), "chunks")
    eligible = chunks.where("revision = 'A'").select("doc_id", "revision").distinct()
    directory = materialise(early_stop.numbered(chunks), "directory")
    post = content.postings(chunks)
    index = early_stop.Blocks(directory, materialise(early_stop.blocked(post, directory), "blocks"))
    figures = materialise(content.corpus_figures(post, chunks), "figures")
    asks = [r.choices(words, k=r.randint(1, 4)) for _ in range(20)] + [["rare", "pair"], ["w1", "rare"], ["w1", "none"], ["none"], [], ["W1", "w1"], texts[0].split()]
    queries = spark.createDataFrame(list(enumerate(asks)), "q long, terms array<string>")
    # all terms only in the last chunks, which are not shown
    assert rows[900][2] == "A" and rows[-1][4] == ""
    for shown in (eligible, eligible.where("doc_id < 'D-150'")):
        got, want = ([tuple(x) for x in f.select("q", "rank", "chunk_id", "doc_id", "revision", F.round("score", 6)).orderBy("q", "rank").collect()] for f in (
            batches.best_chunks(index, figures, queries, 5, shown), early_stop.top_k(index, figures, queries, 5, shown)))
        assert got == want and got
        assert any(x[0] == 20 for x in got) == (shown is eligible)


def test_similar_words_are_those_of_plain_subsequences(monkeypatch):
    monkeypatch.setattr(batches, "CELLS", 3000)
    r = random.Random(3)
    some = lambda n, sizes: {"".join(r.choice("abcde12zz") for _ in range(r.choice(sizes))) for _ in range(n)}
    words = sorted(some(150, [2, 3, 5, 8, 12, 30, 70]) | {"x" * 70 + "ab" * 10, "x" * 9, "xxxx"}, key=len)
    tokens = sorted(some(60, [2, 3, 5, 8, 12, 31, 32, 62, 63]) | {"x" * 65 + "ab" * 12, "xxxxxx"})

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[-1]))
            row = now
        return row[-1]

    found = batches._Words(words).near(tokens, 55.0)
    for t in tokens:
        want = {i: common(t, w) * 200.0 / (len(t) + len(w)) for i, w in enumerate(words)}
        assert dict(zip(*(x.tolist() for x in found[t]))) == {i: x for i, x in want.items() if x >= 55.0}


def test_few_titles_are_scored_to_find_the_nearest():
    import numpy as np

    r = random.Random(4)
    word = lambda: "".join(r.choice(["er", "on", "th", "an", "st", "ou", "ed"]) for _ in range(r.randint(1, 5)))
    pool = sorted({word() for _ in range(3000)}, key=lambda w: (len(w), w))
    sets = [r.sample(range(len(pool)), r.randint(1, 4)) for _ in range(6000)] + [[5]] * 30
    first = [f"D-{i // 2:05d}" for i in range(len(sets))]
    words = batches._Words(pool)
    block = batches._Sets(words, np.array([w for s in sets for w in s]), np.array([len(s) for s in sets]), first)
    asks = [[word() for _ in range(n)] for n in (1, 2, 5, 12, 30, 30)] + [[pool[5]], ["qq"]]
    near = words.near(sorted({t for ask in asks for t in ask}), 55.0)
    for ask in asks:
        at, scores = block.best(ask, near, 10)
        cells = [dict(zip(*(x.tolist() for x in near[t]))) for t in ask]
        every = np.array([sum(len(t) * max(c.get(w, 0.0) for w in s) for t, c in zip(ask, cells)) / sum(map(len, ask)) for s in sets])
        pick = batches._ahead(scores, [first[i] for i in at], 10)
        want = batches._ahead(every, first, 10)
        assert [int(at[i]) for i in pick] == [int(i) for i in want]
        assert np.allclose(scores[pick], every[want], atol=1e-9)
        if len(ask) == 30:
            assert len(at) < len(sets) / 4


def test_questions_are_dealt_whole(monkeypatch):
    asks = [(i, [f"t{j}" for j in range(i % 5)]) for i in range(40)] + [(40, [f"u{j}" for j in range(30)])]
    parts = list(batches._batched(asks, 6))
    assert [x for p in parts for x in p] == asks and len(parts) > 1
    assert all(len(p) == 1 or len({t for _, tokens in p for t in tokens}) <= 6 for p in parts)
