import sqlite3
import time
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import same
from scrivia.functions.stemming import stem_of
from scrivia.operators import chunking, content, early_stop
from scrivia.plans import registry
from scrivia.plans.built import index_of
from scrivia.sources import fixtures as fx
from scrivia.storage import materialise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_queries_without_sql_are_tested_here():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"extract_sections_html"}


def test_porter_search_against_fts5(spark):
    index = index_of(spark, SF)
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(chunk_id UNINDEXED, x, tokenize='porter unicode61')")
    c.executemany("INSERT INTO t VALUES (?, ?)", [(r.chunk_id, r.text) for r in index["chunks"].select("chunk_id", "text").collect()])
    defaults = {(r.doc_id, r.revision) for r in index["defaults"].collect()}
    ranked = c.execute("SELECT chunk_id, bm25(t) FROM t WHERE t MATCH 'licensed AND the'").fetchall()
    want, seen = [], {}
    for chunk_id, score in sorted(((i, s) for i, s in ranked), key=lambda x: (round(x[1], 9), x[0])):
        doc_id, revision = chunk_id.split("#")[0].split("@")
        if (doc_id, revision) in defaults and seen.setdefault(doc_id, 0) < 2:
            seen[doc_id] += 1
            want.append((chunk_id, score))
    got = registry.QUERIES["content_keyword_porter"](spark, SF).collect()
    assert sorted(r.chunk_id for r in got) == sorted(i for i, _ in want[:10]) and got
    assert all(abs(r.score - dict(want)[r.chunk_id]) < 1e-5 for r in got)


class _Page(HTMLParser):
    """(tag, text) of h1..h9, p and li elements in order of their end; scripts and styles have no text."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.open, self.out, self.mute = None, [], 0
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")
        if self.open is None and (tag in ("p", "li") or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
            self.open = (tag, [])
        elif self.open:
            self.open[1].append(" ")

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style")
        if self.open and tag == self.open[0]:
            self.out.append((tag, " ".join("".join(self.open[1]).split())))
            self.open = None
        elif self.open:
            self.open[1].append(" ")

    def handle_data(self, data):
        if self.open and not self.mute:
            self.open[1].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_html_sections(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        path, section, order = [], 0, 0
        for tag, text in _Page(r.html or "").out:
            if text and tag[0] == "h":
                path, section = path[: int(tag[1]) - 1] + [text], section + 1
            elif text:
                want.append((r.page_id, order, " > ".join(path), section, "text", f"- {text}" if tag == "li" else text))
                order += 1
    got = [tuple(r) for r in registry.QUERIES["extract_sections_html"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_folds_are_linear_in_a_document(spark):
    def seconds(lines):
        line = F.struct("id", F.when(F.col("id") % 500 == 0, 1).alias("level"), F.lit("text").alias("kind"), F.concat(F.lit("line of text "), F.col("id").cast("string")).alias("text"))
        row = F.struct("id", F.array(F.col("id").cast("string"), F.lit("some cell of the table")).alias("cells"))
        gathered = spark.range(lines).agg(F.array_sort(F.collect_list(line)).alias("items"), F.array_sort(F.collect_list(row)).alias("rows"))
        df = materialise(gathered.select("items", F.transform("rows", lambda r: r["cells"]).alias("rows")), "fold-test")
        began = time.time()
        got = df.select(F.size(chunking.chunk_pack(chunking.section_fold("items"))).alias("n"), F.size(chunking.table_blocks(F.col("rows"))).alias("t")).first()
        assert got.n >= lines // 120 and got.t >= lines // 150
        return time.time() - began

    seconds(100)
    short = seconds(3_000)
    assert seconds(12_000) < 8 * short + 10  # four times as long; a quadratic fold takes sixteen times


def test_a_query_builds_only_the_tables_it_reads(spark, tmp_path):
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    built = index_of(spark, str(tmp_path))
    registry.QUERIES["catalog_by_type"](spark, str(tmp_path)).collect()
    assert set(built) == {"staged", "documents"} and "body" not in built["staged"].columns
    registry.QUERIES["outline"](spark, str(tmp_path)).collect()
    assert set(built) == {"staged", "documents", "chunks"}
    registry.QUERIES["content_keyword"](spark, str(tmp_path)).collect()
    assert "blocks" in built and not [t for t in built if t.startswith("stem_")]


def test_titles_are_read_without_folding_files(spark, tmp_path):
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    built = index_of(spark, str(tmp_path))
    found = lambda: sorted(tuple(x) for x in registry.QUERIES["catalog_batch"](spark, str(tmp_path)).collect())
    got = found()
    assert set(built) == {"titled"} and got
    # chains made of folded documents say the same
    del built["titled"]
    built["documents"]
    assert found() == got


def _moved(df):
    """Exchanges of rows by key in a plan; broadcasts and single rows not counted."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bodies_are_not_shuffled_to_choose_the_file_that_stays(spark):
    assert _moved(fx.kept(spark, SF)) == 0


@pytest.mark.parametrize("most", [0, 100])
def test_one_file_of_a_shared_name_stays(spark, most):
    # (doc_id, revision) of A are shared by 40 rows and those without any by two; each other name has one row
    rows = [("A", "1", i % 3 > 0, f"f{i:02d}", f"body {i}") for i in range(40)] + [(None, None, False, "n1", "x"), (None, None, False, "n0", "y")]
    rows += [("A", None, True, "a", ""), (None, "1", True, "b", "z")] + [(f"D{i}", "B", i % 2 == 0, f"d{i}", f"own {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, revision string, is_duplicate boolean, filename string, body string")
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        want.setdefault(r[:2], r)
    got = chunking.first_copies(docs, most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.values(), key=str)
    assert got.columns == docs.columns


def test_the_same_row_twice_stays_once(spark, tmp_path):
    spark.range(60).selectExpr("id % 50 AS doc_id", "concat('Some words of text ', id % 50) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["outline"](spark, str(tmp_path)).collect()
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(want.sql(registry.ORACLE_SQL["outline"]).fetchall()) and got


@pytest.mark.parametrize("most", [1_000, 0])
def test_semantic_search_looks_texts_up_where_they_are(spark, monkeypatch, most):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    monkeypatch.setattr(content, "FOUND_MOST", most)
    spark.conf.set(threshold, "-1")
    try:
        found = registry.QUERIES["content_semantic"](spark, SF)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin [chunk_id" in plan) == (most > 0)
        assert same(found, registry.ORACLE_SQL["content_semantic"], SF)
    finally:
        spark.conf.set(threshold, before)


def test_stemmed_blocks_are_built_without_plain_ones(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    registry.QUERIES["content_keyword_porter"](spark, str(tmp_path)).collect()
    built = index_of(spark, str(tmp_path))
    assert "stem_blocks" in built and "blocks" not in built


@pytest.mark.parametrize("stems", [False, True])
def test_blocks_shuffle_texts_and_not_their_postings(spark, stems):
    texts = ["the licenses, licensed: License", "", "a the THE", "élan 東京 licensing x2", "... !"] * 60
    chunks = materialise(spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "number long, text string"), "texts")
    made = early_stop.windowed(chunks, 3, stems)
    # texts go by window; nothing is shuffled once they are words
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    post = content.postings(chunks, "number")
    if stems:
        post = post.withColumn("term", stem_of("term")).groupBy("term", "number", "dl").agg(F.sum("tf").alias("tf"))
    want = early_stop.gathered(post)
    key = lambda df: sorted((r.term, r.window, r.n, r.tf_most, r.dl_least, [tuple(e) for e in r.entries]) for r in df.select("term", "window", "n", "tf_most", "dl_least", "entries").collect())
    assert key(made) == key(want) and key(made)


def test_reading_by_exact_identifiers_where_numbers_are_longer(spark, tmp_path):
    """From 1,000 chains on identifiers have four digits, and ``BOM-P01-010`` is a fragment of ``BOM-P01-0010`` only."""
    path = str(tmp_path)
    spark.range(3000).selectExpr("id AS doc_id", "concat('Some words of text ', id) AS text").write.parquet(f"{path}/documents.parquet")
    got = {(r.ask, r.outcome, r.doc_id, r.wanted) for r in registry.QUERIES["read_outcomes"](spark, path).collect()}
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert got == set(want.sql(registry.ORACLE_SQL["read_outcomes"]).fetchall())
    assert ("bom_p01/010", "unknown", None, "A") in got
