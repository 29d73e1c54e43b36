"""Each operator against a brute-force version of its method."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrivia.llm import decontamination, mixing, near_dedup, pii, quality, queries, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"


def _texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- op1 --------------------------------------------------------------------


def _statistics(text):
    """A few of the statistics, counted one by one."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda chars: sum(1 for c in raw if c in chars) / len(raw)
    p = [n / len(raw) for n in Counter(raw).values()]
    return {
        "log_bytes": math.log(1 + len(raw)), "log_words": math.log(1 + len(words)), "word_mean": sum(map(len, words)) / len(words), "unique_words": len(set(words)) / len(words),
        "top_word": max(words.count(w) for w in set(words)) / len(words), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share(b"0123456789"), "commas": share(b",;:"),
        "high_bytes": sum(1 for c in raw if c > 127) / len(raw), "entropy": -sum(x * math.log2(x) for x in p), "log_lines": math.log(1 + len(lines)),
        "unique_lines": len(set(lines)) / len(lines), "repeats": sum(1 for a, b in zip(words, words[1:]) if a == b) / len(words),
    }


def test_quality_statistics_and_tree_walk(spark):
    for text in [t for t in _texts(spark).values() if t.strip()][:40]:
        got = dict(zip(quality.FEATURES, quality.statistics(text.encode())))
        for k, v in _statistics(text).items():
            assert abs(got[k] - v) < 1e-9, k
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.FEATURES)))
    f = quality.grow(x, (x[:, 2] + x[:, 5] > 1).astype(float), trees=12)
    for row, margin in zip(x[:50], f.margin(x[:50])):
        total = f.base
        for t in range(len(f.feature)):
            node = 0
            while node < len(f.feature[t]):
                node = 2 * node + (2 if row[f.feature[t][node]] > f.split[t][node] else 1)
            total += f.leaf[t][node - len(f.feature[t])]
        assert abs(total - margin) < 1e-9


def test_label_sample_keeps_the_class_mix(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 5 > 0 as int) AS quality")
    got = quality.label_sample(labels, "quality", F.lit(True), 4_000).groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in got}
    assert sum(n.values()) <= 4_000 and abs(n[1] / sum(n.values()) - 0.8) < 0.03
    got = quality.label_sample(labels, "quality", F.lit(True), 4_000, balanced=True).groupBy("y").count().collect()
    assert abs(got[0]["count"] - got[1]["count"]) < 200


# --- op2 --------------------------------------------------------------------


def test_warc_query(spark):
    got = {r.page_id: r for r in queries.QUERIES["op2_warc"](spark, SF).collect()}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    top = {}
    for i, p in pages.items():
        top[p] = max(i, top.get(p, i))
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        first = top[p] == i
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top[p])
        assert tuple(got[i])[1:] == want


def test_warc_salvages_inside_members():
    recs = [warc.write_record(i, "u", b"payload %d" % i * 50, None) + b"\r\n\r\n" for i in range(6)]
    bad = recs[1].replace(b"payload 1", b"PAYLOAD 1", 1)
    found = list(warc.salvage(gzip.compress(recs[0] + bad + recs[2] + recs[3])))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 2, 3]
    assert [(r["inner"], r["inner_length"]) for r in found if r["kind"] == "gap"] == [(len(recs[0]), len(bad))]
    # a member cut off in its last record, one with a wrong checksum, and a whole one
    noise = random.Random(1).randbytes(3000)
    last = warc.write_record(9, "u", noise, None) + b"\r\n\r\n"
    cut = gzip.compress(recs[0] + recs[1] + last)[:-1500]
    wrong = bytearray(gzip.compress(recs[2] + recs[3]))
    wrong[-6] ^= 255
    found = list(warc.salvage(cut + bytes(wrong) + gzip.compress(recs[4]) + b"WARC/0.18\r\n" + recs[5]))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 1, 2, 3, 4, 5]
    assert any(r["kind"] == "gap" and r["reason"].startswith("in a member") for r in found)


def test_warc_archives_are_bounded_and_gaps_logged(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, "x" * (40_000 if i % 10 == 0 else 10) + str(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "w"
    warc.write_archives(pages, str(path), per_archive=30, most_bytes=100_000)
    files = list(path.glob("part-*"))
    assert max(f.stat().st_size for f in files) < 140_000
    found = warc.read_archives(spark, str(path))
    assert sorted(r.page_id for r in found.collect()) == list(range(60)) and warc.quarantine(found).count() == 0
    one = sorted(files)[0]
    (path / f".{one.name}.crc").unlink()  # Hadoop's own checksum would refuse the file
    one.write_bytes(one.read_bytes().replace(b"WARC/1.1", b"WARX/1.1", 1))
    assert warc.quarantine(warc.read_archives(spark, str(path))).count() == 1


# --- op3 --------------------------------------------------------------------


def test_composed_grammar_equals_the_transducers_in_sequence():
    rng = random.Random(4)
    for _ in range(300):
        symbols = [rng.randrange(toxicity.INSULT) for _ in range(rng.randrange(1, 25))]
        want, factor = symbols, [1.0] * len(symbols)
        for t in toxicity.TRANSDUCERS:
            want, own = t.run(want)
            factor = [a * b for a, b in zip(factor, own)]
        state = 0
        for s, out, f in zip(symbols, want, factor):
            state, to, weight = toxicity.GRAMMAR[state][s]
            assert to == out and abs(weight - f) < 1e-12


def test_grammar_rewrites():
    lex = toxicity.Lexicon({"idiot": 2.0, "kill": 1.0}, {})
    became = lambda t: toxicity.clause_scores(t, lex)[0][0][2]
    assert became("an idiot") == [toxicity.INSULT] and became("you idiot") == [toxicity.AIMED_INSULT]
    assert became("you i will kill") == [toxicity.AIMED_THREAT] and became("the frost did kill") == [toxicity.MENTION]
    assert became("you are not an idiot") == [toxicity.DENIED] and became("he said idiot") == [toxicity.QUOTED]
    assert became("kill them all") == [toxicity.THREAT]


def test_toxicity_score_against_a_plain_version(spark):
    """The score of whole texts, clause by clause with the transducers in sequence."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in queries.QUERIES["op3_toxicity"](spark, SF).collect()}
    for i, text in _texts(spark).items():
        scores, n = [], 0
        for clause in re.split(r"([.!?;\n])", text.lower()):
            if clause in set(".!?;\n") and clause:
                n += 1
                continue
            tokens = re.findall(r"[^\W\d_]+", clause)
            n += len(tokens)
            weights = [model.lexicon.weight(t) for t in tokens]
            out, factors = [toxicity.symbol(t, w) for t, w in zip(tokens, weights)], [1.0] * len(tokens)
            for t in toxicity.TRANSDUCERS:
                out, own = t.run(out)
                factors = [a * b for a, b in zip(factors, own)]
            if any(weights):
                scores.append(sum(w * f for w, f in zip(weights, factors)))
        x = [max(scores), math.log1p(sum(scores)), 100 * sum(scores) / max(1, n)] if scores else [0, 0, 0]
        z = model.coef[0] + sum(a * b for a, b in zip(model.coef[1:], x))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


# --- op5, op7, op8 ----------------------------------------------------------


def test_mixing_cut_removes_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    served, budget = mixing.line(mixing.queues(docs))
    before = served.agg(F.count("*"), F.sum("words")).first()
    after = mixing.cut(served, budget).agg(F.count("*"), F.sum("words")).first()
    assert after[1] == budget < before[1] and after[0] < before[0]
    got = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 2 for r in got)


def test_simhash_fingerprints(spark):
    got = {r.doc_id: r.fingerprint for r in queries.QUERIES["op7_simhash"](spark, SF).collect()}
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, text in _texts(spark).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        shingles = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] == f"{bits:016x}"
    assert simhash.simhash(b" \n") == 0


def test_sketches_choose_candidates(spark):
    rng = random.Random(8)
    common = "which of the following is the best answer to this"
    items = [(i, common + " " + " ".join(rng.choices("abcdefghij", k=rng.randint(3, 60)))) for i in range(60)]
    docs = []
    for i in range(300):
        words = rng.choices("abcdefghij", k=200)
        if i % 3 == 0:
            item = items[rng.randrange(60)][1].split()
            cut = int(len(item) * rng.choice([0.5, 0.85, 0.95, 1.0]))
            words[50:50] = item[:cut]
        docs.append((i, " ".join(words) + " " + common))
    sets = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    held = {(d, i): len(sets(b) & sets(a)) / len(sets(a)) for d, b in docs for i, a in items}
    want = {k for k, v in held.items() if v >= 0.8}
    texts = spark.createDataFrame(docs, "text_hash long, text string")
    sketches = decontamination.item_sketches(spark.createDataFrame(items, "item_id long, text string")).cache()
    for limit in (10**6, 0):
        pairs = {(r.text_hash, r.item.item_id) for r in decontamination.candidates(texts, sketches, limit).collect()}
        assert want <= pairs and len(pairs) < 0.5 * sum(v > 0 for v in held.values())
    got = decontamination.contained(texts.withColumnRenamed("text_hash", "doc_id"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(abs(r.containment - held[r.doc_id, r.item_id]) < 1e-5 for r in got)


# --- op9 --------------------------------------------------------------------


def test_disclosure_against_counts(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    docs = []
    for i in range(200):
        text = " ".join(rng.choices(words, k=12))
        if i % 10 < 3:
            text += f" mail p{i % 10}@x.org by " + rng.choice([f"Name{i % 10}", "someone"])
        docs.append((i, text))
    docs += [(300, "p0@x.org p9@x.org Name0"), (301, "q9@x.org p9@x.org q8@x.org other Name9"), (302, "q9@x.org p9@x.org q8@x.org more Name9")]
    got = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    holds = {i: set(re.findall(r"[\w.]+@[\w.]+\w", t)) for i, t in docs}
    terms = {i: {w.lower() for w in re.findall(r"[^\W_]{3,}", t)} for i, t in docs}
    n_e, n_t, n_te = Counter(e for s in holds.values() for e in s), Counter(t for s in terms.values() for t in s), Counter((e, t) for i in holds for e in holds[i] for t in terms[i])
    disclosure = lambda e, t: math.log(n_te[e, t] * len(docs) / (n_t[t] * n_e[e])) / math.log(len(docs) / n_e[e])
    seen = 0
    for r in got:
        covered = {w.lower() for e in holds[r.doc_id] for w in re.findall(r"[^\W_]{3,}", e)}
        best = {t: max((disclosure(e, t) for e in holds[r.doc_id] if n_e[e] >= 2 and n_te[e, t] >= 2), default=0) for t in terms[r.doc_id] - covered}
        assert {(x.v.lower(), x.action) for x in r.terms} == {(t, "remove" if d >= 0.95 else "generalise") for t, d in best.items() if d >= 0.8}
        seen += len(r.terms)
    assert seen > 20


def test_pii_query_hashes(spark):
    rows = queries.QUERIES["op9_pii"](spark, SF).collect()
    found = {r.doc_id: r for r in pii.find_pii(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in rows:
        base = [f"{k}:{x.s}:{x.e}" for k in pii.KINDS for x in found[r.doc_id][k]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans == ",".join(base + [f"term:{x.s}:{x.e}" for x in found[r.doc_id].terms])


@pytest.mark.parametrize("text", ["." + "7" * 80_000, "1.2.3." * 20_000, "a@b.cd " * 20_000, "+1(" * 30_000])
def test_pii_is_linear_in_the_text(spark, text):
    began = time.time()
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(got.email) == text.count("@") and time.time() - began < 60


# --- pipeline ---------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out=None).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    kept = stages["toxicity"](spark, docs, SF)
    want = sorted(i for i in rows if scores[i].toxicity_score < toxicity.CUT)
    assert ids(kept) == want and kept.columns == docs.columns

    sets = {i: {tuple(rows[i].text.lower().split()[j : j + 5]) for j in range(max(1, len(rows[i].text.split()) - 4))} for i in want}
    first, left = [], list(want)
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            more = {y for y in left if y not in group and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            group |= more
            todo += more
        first.append(left[0])
        left = [y for y in left if y not in group]
    kept = stages["near_dedup"](spark, kept, SF)
    assert ids(kept) == first and kept.columns == docs.columns

    leaks = {r.doc_id for r in decontamination.contained(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = stages["decontamination"](spark, kept, SF)
    assert ids(kept) == [i for i in first if i not in leaks]

    served = {r.doc_id: r for r in mixing.mix(kept).collect()}
    kept = stages["mixing"](spark, kept, SF)
    times = Counter(r.doc_id for r in kept.collect())
    assert all(times[i] == (1 if r["size"] == 0 else math.floor(r.taken / r["size"] + 0.5)) for i, r in served.items())

    out = stages["sharding"](spark, kept, SF)
    assert out.columns == [*docs.columns, "bytes", "shard", "depth", "shard_bytes"] and out.count() == sum(times.values())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == ids(out)


def test_marks_bound_differences():
    rng = np.random.default_rng(3)
    for n in (5, 100, 1000):
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        b[: n // 2] = a[: n // 2]
        differ = len(np.setxor1d(a, b))
        x, y = near_dedup.marks(a), near_dedup.marks(b)
        assert sum(bin(int(p) & (2**64 - 1)).count("1") for p in x ^ y) <= differ


def test_parities_bound_differences():
    rng = np.random.default_rng(4)
    for n, m in ((0, 0), (5, 5), (120, 130), (1000, 1000), (1000, 1100)):
        a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (n, m))
        b[: n // 2] = a[: n // 2]
        x, y = sorted((near_dedup.parities(a), near_dedup.parities(b)), key=len)
        if len(y) > len(x):
            y = y[: len(x)] ^ y[len(x) :]
        differ, bits = len(np.setxor1d(a, b)), sum(bin(int(p) & (2**64 - 1)).count("1") for p in x ^ y)
        assert bits <= differ and bits >= 0.6 * differ


def _rows_of(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_hash long, text string")


def test_near_copies_come_from_ball_hashing(spark, monkeypatch):
    """Texts whose fingerprints are near, and in no half equal, are linked by op7's search."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for f in range(40):
        base = list(rng.choice(words, 400))
        texts.append(" ".join(base))
        base[int(rng.integers(0, 400))] = f"new{f}"
        texts.append(" ".join(base))
    prints = [simhash.simhash(t.encode()) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (prints[a] ^ prints[b]).bit_count() <= near_dedup.RADIUS}
    assert any((prints[a] ^ prints[b]) & 0xFFFFFFFF and (prints[a] ^ prints[b]) >> 32 for a, b in want)
    asked = []
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest, do=near_dedup._verified: (asked.append({(r.a, r.b) for r in pairs.collect()}), do(pairs, *rest))[1])
    _, roots = near_dedup.near_groups(_rows_of(spark, texts))
    assert asked[0] == want
    assert {(r.root, r.node) for r in roots.collect()} >= want


def _asked(monkeypatch):
    """How many texts and pairs meet at the keys of the last step, each time it is run."""
    out = []

    def counted(*args, do=near_dedup._questions):
        asking, asked = do(*args)
        out.append((asking.count() + asked.count(), asking.join(asked, ["key", "rest", "size"]).count()))
        return asking, asked

    monkeypatch.setattr(near_dedup, "_questions", counted)
    return out


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_form_letters_do_not_meet(spark, monkeypatch, n):
    """Letters of one shape with one own word: 25 of 35 shingles are common, below the threshold."""
    asked = _asked(monkeypatch)
    shape = [f"w{j}" for j in range(34)]
    texts = [" ".join([*shape[:17], f"own{i}", *shape[18:]]) for i in range(n)]
    _, roots = near_dedup.near_groups(_rows_of(spark, texts))
    assert roots.isEmpty() and len(asked) == 1 and asked[0][0] <= 8 * n and asked[0][1] <= n


def test_letters_of_two_lengths_meet_by_length(spark, monkeypatch):
    """Letters with few own words are one group; those with many are at the same shingles, but too long for them."""
    asked = _asked(monkeypatch)
    shape = [f"w{j}" for j in range(40)]
    own = [3 if i % 2 else 8 for i in range(400)]
    own += [6, 6, 5]  # those of 6 own words are near to those of 3, but not to each other
    texts = [" ".join([*(f"own{i}-{j}" for j in range(k)), *shape]) for i, k in enumerate(own)]
    sets = [set(simhash.shingle_hashes(t.encode(), near_dedup.WIDTH).tolist()) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    _, roots = near_dedup.near_groups(_rows_of(spark, texts))
    got = {r.node for r in roots.collect()} | {r.root for r in roots.collect()}
    assert got == {i for i, a in enumerate(sets) if any(near(a, b) for j, b in enumerate(sets) if j != i)}
    assert len({r.root for r in roots.collect()}) == 1
    assert asked[-1][1] < 20 * len(texts)


def test_rows_without_a_shared_key_stay_in_their_task(spark, monkeypatch):
    """Only what may share a shingle is shuffled: the filter of the keys comes before their join."""
    plans = []

    def written(df, label, *a, do=near_dedup.materialise, **k):
        if label == "near-shared":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return do(df, label, *a, **k)

    monkeypatch.setattr(near_dedup, "materialise", written)
    texts = [" ".join(f"w{(i // 2) * 50 + j}" for j in range(40)) + f" end{i}" for i in range(6)]
    near_dedup.near_groups(_rows_of(spark, texts))
    (plan,) = plans
    assert plan.index("SortMergeJoin") < plan.index("Exchange") < plan.index("BroadcastHashJoin")
