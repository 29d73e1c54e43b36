"""Odd columns, ids and texts for every operator."""

import pytest

from scrivia.llm import decontamination, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, sharding, simhash, toxicity

NAMES = "__t __h __p __id __d __s t h p d s n row bytes shard depth shard_bytes toxicity_score key digest slot words gone of".split()
DDL = "doc_id {}, text string, source string, `a.b` int, " + ", ".join(f"`{n}` string" for n in NAMES)
HUGE = " ".join(f"huge{i % 9973}" for i in range(120_000))  # over 1 MB
ROWS = [
    ("1", "one two three four five six seven eight", "s1"), ("2", None, None), (None, "one two three four five six seven eight", "s1"), (None, None, None), ("3", "", "s2"),
    ("4", "tie tie tie", "s1"), ("4", "tie tie tie", "s1"), ("4", "tie  tie tie", "s2"), ("5", HUGE, "s1"), ("6", "\n \t", "s2"),
]


def _docs(spark, kind, rows=ROWS):
    cast = (lambda i: i) if kind == "string" else (lambda i: None if i is None else int(i))
    return spark.createDataFrame([(cast(i), t, s, 1, *["x"] * len(NAMES)) for i, t, s in rows], DDL.format(kind))


def _labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def _items(spark):
    return spark.createDataFrame([("i1", "two three four five six seven"), ("i2", None), (None, "zz yy xx ww vv uu")], "item_id string, text string")


KEEPING = {  # operators that give rows of documents back, and which ids stay
    # "tie tie tie" and "tie  tie tie" have equal sets of shingles, so they are near copies, and one row of the three stays
    "near_dedup": (lambda spark, d: near_dedup.near_dedup(d), ["1", "2", "4", "5"]),
    "mixed": (lambda spark, d: mixing.mixed(d, percent=200), sorted([*(str(i) for i, *_ in ROWS), "1", "4", "4", "4", "5", "None"])),  # twice, but those without words
    "clean": (lambda spark, d: decontamination.clean(d, _items(spark)), ["2", "3", "4", "4", "4", "5", "6", "None"]),
    "shard": (lambda spark, d: sharding.shard(d, limit=1 << 16, keep=d.columns), sorted(str(i) for i, *_ in ROWS)),
    "toxicity": (lambda spark, d: toxicity.score_toxicity(d, _labels(spark), keep=d.columns), sorted(str(i) for i, *_ in ROWS)),
}


@pytest.mark.parametrize("name, kind", [(n, "string") for n in sorted(KEEPING)] + [("shard", "long"), ("mixed", "long")])
def test_any_columns_and_ids(spark, name, kind):
    run, ids = KEEPING[name]
    docs = _docs(spark, kind)
    got = run(spark, docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.dtypes[: len(docs.columns)] == docs.dtypes
    rows = got.collect()
    assert sorted(str(r[0]) for r in rows) == ids
    assert all(r["a.b"] == 1 and all(r[n] == "x" for n in NAMES) for r in rows)
    assert run(spark, docs.limit(0)).count() == 0


REPORTING = {  # operators that report on every row
    "quality": lambda spark, d: quality.score_quality(d, _labels(spark)),
    "exact_dedup": lambda spark, d: exact_dedup.exact_dedup(d),
    "mix": lambda spark, d: mixing.mix(d),
    "simhash": lambda spark, d: simhash.near_classes(simhash.fingerprints(d)),
    "pii": lambda spark, d: pii.find_pii(d),
    "line_dedup": lambda spark, d: line_dedup.line_dedup(d),
}


@pytest.mark.parametrize("name", sorted(REPORTING))
def test_reports_on_every_row(spark, name):
    docs = _docs(spark, "string")
    got = REPORTING[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in ROWS)
    assert REPORTING[name](spark, docs.limit(0)).count() == 0


def test_contained_with_string_ids(spark):
    got = decontamination.contained(_docs(spark, "string"), _items(spark)).collect()
    assert sorted((str(r.doc_id), r.item_id, r.containment) for r in got) == [("1", "i1", 1.0), ("None", "i1", 1.0)]


def test_one_row_of_a_group_is_kept(spark):
    docs = spark.createDataFrame([(5, "a b"), (5, "ab"), (5, "ab"), (7, "a b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(5, False), (5, False), (5, True), (7, False)]
    assert {(r.keep_id, r.group_size) for r in got} == {(5, 4)}


def test_many_null_ids_are_mixed_and_sharded(spark):
    docs = spark.range(100_000).selectExpr("cast(null as long) AS doc_id", "'two words' AS text", "'s' AS source")
    got = mixing.mix(docs).groupBy("taken").count().collect()
    assert sum(r["taken"] * r["count"] for r in got) == 300_000 and {r["taken"] for r in got} <= {2, 3, 4}
    shards = sharding.shard(docs, limit=10_000).groupBy("shard", "shard_bytes").count().collect()
    assert all(r["shard_bytes"] <= 10_000 and r["shard_bytes"] == 9 * r["count"] for r in shards)
