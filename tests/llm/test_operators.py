import gzip
import random
import re

import numpy as np
import pytest

from oracle import same
from scrivia.llm import decontamination, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, queries, sharding, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, h string, score double"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "x", "x", 0.5) for i, t, s in rows], DDL)


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, "a b c", "s1"), (2, None, None), (3, "", "s2"), (4, "a b c", "s1"), (4, "a b c", "s1"), (None, "a  b c", "s3"), (5, LONG, "s1"), (6, LONG + " x", "s2")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_exact_dedup_odd_rows(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(_docs(spark, ODD)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    want = [(1, None, 4, False), (2, 2, 2, True), (3, 2, 2, False), (4, None, 4, False), (4, None, 4, False), (5, 5, 1, True), (6, 6, 1, True), (None, None, 4, True)]
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(_docs(spark, [])).count() == 0


def _brute(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("blocks", [1, 2])
def test_simhash_links_against_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    fps, n = {}, 0
    for _ in range(6):
        centre = int(rng.integers(0, 2**63))
        for _ in range(90 if n == 0 else 8):
            flips = rng.choice(64, size=rng.integers(0, 5), replace=False)
            fps[n] = centre ^ sum(1 << int(f) for f in flips)
            n += 1
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    got = simhash.near_classes(spark.createDataFrame(signed, "doc_id long, fp long"), 4, blocks).collect()
    assert {r.doc_id: r.component_id for r in got} == _brute(fps, 4)


def test_simhash_odd_rows(spark):
    got = simhash.near_classes(simhash.fingerprints(_docs(spark, ODD))).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: (r.fp, r.component_id) for r in got}
    assert by[2] == by[3] == (0, 2) and by[5][1] == by[6][1] == 5 and by[4][1] == 1


def _jaccard(a, b):
    s = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_near_dedup(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i * 100, t, "s"))
        for k in range(40 if i == 0 else 3):
            w = t.split()
            w[int(rng.integers(0, 200))] = f"new{i}-{k}"
            rows.append((i * 100 + 1 + k, " ".join(w), "s"))
    rows += [(9000, None, "s"), (9001, "", "s"), (100, base[1], "s")]
    assert _jaccard(rows[0][1], rows[1][1]) >= 0.8
    got = near_dedup.near_dedup(_docs(spark, rows))
    assert got.columns == [c.split()[0] for c in DDL.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == [*[i * 100 for i in range(12)], 9000]
    assert near_dedup.near_dedup(_docs(spark, [])).count() == 0


def test_near_dedup_reaches_texts_through_folded_ones(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for f in range(3):
        # copies that are similar to the original, but often not to each other
        base = list(rng.choice(words, 300, replace=False))
        rows.append((f * 1000, " ".join(base), "s"))
        for k in range(60):
            w = list(base)
            for at in rng.choice(300, size=int(rng.integers(1, 9)), replace=False):
                w[at] = f"new{f}-{k}-{at}"
            rows.append((f * 1000 + 1 + k, " ".join(w), "s"))
    assert any(_jaccard(rows[1][1], t) < 0.8 for _, t, _ in rows[2:61])
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(296)} for i, t, _ in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want, left = [], sorted(sets)
    while left:
        want.append(left[0])
        seen, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            more = {y for y in left if y not in seen and near(x, y)}
            seen |= more
            todo += more
        left = [y for y in left if y not in seen]
    assert sorted(r.doc_id for r in near_dedup.near_dedup(_docs(spark, rows)).collect()) == want


def test_near_dedup_loses_no_pair(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    rows, want = [], []
    # words, of how many distinct ones, and new words: in one run at the end or in the middle, or dealt out singly
    shapes = [(20, 5000, 3, "end"), (20, 5000, 4, "end"), (100, 5000, 20, "middle"), (50, 5000, 11, "end"), (100, 5000, 24, "end"), (300, 5000, 70, "end"), (3000, 400, 64, "single")]
    for shape, (n, of, new, where) in enumerate(shapes):
        for k in range(6):
            at = len(rows) * 10
            base, fresh = list(rng.choice(words[:of], n)), [f"new{at}-{i}" for i in range(new)]
            copy = base + fresh if where == "end" else base[: n // 2] + fresh + base[n // 2 :]
            if where == "single":
                copy = list(base)
                for i, x in zip(rng.choice(n, new, replace=False), fresh):
                    copy[i] = x
            rows += [(at, " ".join(base), "s"), (at + 1, " ".join(copy), "s")]
            want += [at] if _jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else [at, at + 1]
    assert len(want) < 1.2 * len(rows) / 2
    assert sorted(r.doc_id for r in near_dedup.near_dedup(_docs(spark, rows)).collect()) == want


@pytest.mark.parametrize("n", [2, 6, 20])
def test_near_dedup_blank_texts(spark, n):
    blank = [None, "", *(c * k for k in range(1, 5) for c in " \n\t\r\x0b\x0c")][:n]
    rows = [(i, t, "s") for i, t in enumerate([*blank, "one word"])]
    assert sorted(r.doc_id for r in near_dedup.near_dedup(_docs(spark, rows)).collect()) == [0, n]


def test_mixing_targets_by_iteration(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 11 else None) for i in range(300)] + [(None, None, "s0"), (7, "", "s9")]
    got = mixing.mix(_docs(spark, rows)).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free = set(order)
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in order if s not in free)
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * size[s]}
        if not over:
            break
        free -= over
    for s in order:
        want = left * w[s] / sum(w[x] for x in free) if s in free else 2 * size[s]
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want) < 1e-5 for r in own)
        assert abs(sum(r.taken for r in own) - want) <= 1
    assert all(r.taken <= 2 * r["size"] for r in got) and len(got) == len(rows)
    assert mixing.mixed(_docs(spark, rows)).columns == [c.split()[0] for c in DDL.split(", ")]
    assert mixing.mix(_docs(spark, [])).count() == 0


def test_sharding_splits_and_overflows(spark):
    rows = [(i, "x" * (i % 50), "s") for i in range(400)] + [(7, "y" * 90, "s")] * 5 + [(8, "z" * 500, "s"), (None, None, None)]
    got = sharding.shard(_docs(spark, rows), limit=200).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert all(sum(r.bytes for r in v) <= 200 or len(v) == 1 for v in shards.values())
    assert all(sum(r.bytes for r in v) == v[0].shard_bytes for v in shards.values())
    assert sharding.shard(_docs(spark, [])).count() == 0


def test_decontamination_finds_contained_items(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, "a " * 500 + item.upper() + " b" * 500, "s"), (2, item.replace("q15", "zz"), "s"), (3, " ".join(item.split()[:20]), "s"), (4, None, "s"), (5, "one two", "s"), (1, "clean", "s")]
    items = spark.createDataFrame([(10, item), (11, "one two"), (12, ""), (13, None)], "item_id long, text string")
    for limit in (10**6, 0):
        got = decontamination.contained(_docs(spark, docs), items, broadcast_shingles=limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (2, 10), (5, 11)]
    assert sorted((r.doc_id, r.text) for r in decontamination.clean(_docs(spark, docs), items).select("doc_id", "text").collect() if r.text) == [(1, "clean"), (3, docs[2][1])]
    assert decontamination.contained(_docs(spark, docs), items.limit(0)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def _holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_pii_spans_against_brute_force(spark):
    texts = [
        "mail a.b+c@d-e.co.uk,x@y.z_d@e.ff é@x @y.z a@b", "ip 1.2.3.4.5 999.1.1.1 001.002.003.004 1.2.3 10.0.0.256", "card 4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
        "+1 (017) 555-7713 +123 + 12345678 +1..........2 +49 30 1234567 1234", "1 " * 20_000, "7" * 30_000, "", None, "𝔘nicode 😀 q@r.st +1 234 567 89",
    ]
    got = {r.doc_id: r for r in pii.find_pii(_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        for kind, shape in PATTERNS.items():
            want = [(m.start(), m.end()) for m in re.finditer(shape, t or "") if _holds(kind, m[0])]
            assert [(x.s, x.e) for x in got[i][kind]] == want, (i, kind)


def test_pii_terms_that_give_away(spark):
    rows = [(i, f"Dr Zyx{'q' if i < 4 else ''} saw the patient number {i} at p@q.org today" if i < 4 else f"the patient number {i} at home today", "s") for i in range(40)]
    got = {r.doc_id: [x.v for x in r.terms] for r in pii.find_pii(_docs(spark, rows)).collect()}
    assert all("Zyxq" in got[i] and "patient" not in got[i] for i in range(4)) and not got[10]
    clean = {r.doc_id: r.text for r in pii.sanitise(_docs(spark, rows)).collect()}
    assert "Zyxq" not in clean[0] and "<email>" in clean[0] and clean[10] == rows[10][1]
    assert pii.find_pii(_docs(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/ b", "x\r\n\r\nWARC/1.1\r\n"), (2, None, "same é"), (3, "u", "same é"), (4, "u", None), (5, "u", ""), (5, "u", ""), (None, "u", "same é")],
        "page_id long, url string, html string",
    )
    warc.write_archives(pages, str(tmp_path / "w"), per_archive=2)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.kind == "record" for r in got)
    seen = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr)
    want = [(1, "response", None, 15), (2, "revisit", 3, 7), (3, "response", None, 7), (4, "revisit", 5, 0), (5, "response", None, 0), (5, "response", None, 0), (None, "revisit", 3, 7)]
    assert seen == sorted(want, key=repr)


def test_warc_salvage():
    recs = [warc.write_record(i, "u", b"payload %d" % i, None) + b"\r\n\r\n" for i in range(5)]
    out = list(warc.salvage(b"junk" + recs[0] + recs[1].replace(b"payload", b"PAYLOAD") + recs[2] + recs[3][:-9] + recs[4]))
    assert [r["page_id"] for r in out if r["kind"] == "record"] == [0, 2, 4]
    assert [r["kind"] for r in out] == ["gap", "record", "gap", "record", "gap", "record"]
    assert sum(r["length"] for r in out) == 4 + sum(map(len, recs)) - 9
    members = [gzip.compress(r) for r in recs]
    out = list(warc.salvage(members[0] + members[1][:20] + b"\0" * 9 + members[2]))
    assert [r.get("page_id") for r in out] == [0, None, 2] and list(warc.salvage(b"")) == []


def test_warc_members_of_any_length():
    pages = [bytes(random.Random(n).randbytes(n)) for n in (0, 70_000, 1, 200_000)]
    members = [gzip.compress(warc.write_record(i, None, p, None) + b"\r\n\r\n") for i, p in enumerate(pages)]
    members[1] = members[1][:-9]  # a cut member is a gap, the next ones are whole
    found = list(warc.salvage(b"".join(members)))
    assert [r.get("page_id") for r in found if r["kind"] == "record"] == [0, 2, 3]
    assert [r["payload"] for r in found if r["kind"] == "record"] == [pages[0], pages[2], pages[3]]
    assert sum(r["length"] for r in found) == sum(map(len, members))


def test_line_dedup_odd_rows(spark):
    line = "this boilerplate line is on every site"
    rows = [(i, f"own text number {i} is here\n{line}\nend", f"s{i}") for i in range(10)] + [(90, None, "s1"), (91, "", None), (1, f"own text number 1 is here\n{line}\nend", "s1")]
    got = line_dedup.line_dedup(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(line not in (r.text or "") for r in got)
    assert sum(r.n_removed for r in got) == 11 and [r.n_lines for r in got if r.doc_id == 90] == [0]
    assert line_dedup.line_dedup(_docs(spark, [])).count() == 0


def test_quality_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.grow(x[:2000], y[:2000], trees=30)
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert np.isfinite(quality.grow(x[:5], np.ones(5)).score(x[:5])).all()


@pytest.mark.parametrize("name", ["op1_quality", "op3_toxicity"])
def test_classifiers_held_out(spark, name):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got["quality" if name == "op1_quality" else "toxic"]).mean() > 0.97


def test_lexicon_keeps_every_term_that_qualifies(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = sorted({"".join(rng.choice(letters, 9)) for _ in range(3000)})
    rows = [(i, " ".join(rng.permutation(words)), 1) for i in range(40)]
    rows += [(100 + i, f"plain text number {i} about nothing much " + " ".join(rng.choice(["tea", "rain", "book", "road"], 30)), 0) for i in range(40)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert set(words) <= set(got.words)


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = _docs(spark, ODD)
    assert quality.score_quality(docs, none).count() == len(ODD)
    assert toxicity.score_toxicity(docs, none).where("toxicity_score < 0.5").count() == len(ODD)


def test_grammar_weighs_context():
    lex = toxicity.Lexicon({"idiot": 2.0, "kill": 1.0}, {})
    score = lambda t: sum(s for *_, s in toxicity.clause_scores(t, lex)[0])
    assert score("you idiot") > score("an idiot") > score("not an idiot") > 0
    assert score("they said idiot") < score("idiot") and score("i will kill time") < score("you i kill")
    assert score("said hello. idiot") == score("idiot") and score(None or "") == 0
