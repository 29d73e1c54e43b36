"""Keyword top-k for many queries without reading all postings: block bounds and windows.

Chunks are numbered so that a document's chunks are neighbours, and ``WINDOW`` numbers are a
window.  A term's postings in one window are a block: a row with its entries, their count, the
greatest term frequency and the least chunk length.  The last two bound the score that any entry
of the block can reach, whatever the collection's mean length has become meanwhile.

A search first reads the blocks' bounds only.  The sum of its terms' bounds is what a chunk
of a window can score at most.  Windows are then scored in waves, the most promising first; after
each wave the k-th best score found so far, counted after the filter of revisions and the cap of
chunks a document, rules out every window that cannot reach it.  A chunk that is left out can
neither be among the k nor push one out of its document's cap, so the answer is that of scoring
everything.  Queries are rows, and all of them advance together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions.stemming import stemmed_text
from scrivia.functions.text import word_tokens
from scrivia.operators.content import IDF_FLOOR, K1, PER_DOC, B, postings
from scrivia.storage import materialise, release

#: Chunk numbers of a window; windows a query has scored when a wave ends (the last takes all that are left).
WINDOW, WAVES = 128, (4, 32, 1 << 62)
#: Scores are ranked to nine places, as sums of doubles depend on their order: a window is ruled out only beyond this.
SLACK = 1e-8


class Blocks(NamedTuple):
    directory: DataFrame  # (chunk_id, doc_id, revision, number)
    blocks: DataFrame  # (term, window, n, tf_most, dl_least, entries)


def numbered(chunks: DataFrame, first: int = 0) -> DataFrame:
    """(chunk_id, doc_id, revision, number): neighbours in a document have neighbouring numbers, from ``first`` on; numbers may have gaps."""
    order = ("doc_id", "revision", "position")
    ranged = chunks.select("chunk_id", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("chunk_id", "doc_id", "revision", (F.monotonically_increasing_id() + first).alias("number"))


def next_number(directory: DataFrame, window: int = WINDOW) -> int:
    """The first number of a window beyond all that are taken: later chunks share no block with earlier ones."""
    most = directory.agg(F.max("number")).first()[0]
    return 0 if most is None else (most // window + 1) * window


def blocked(postings: DataFrame, directory: DataFrame, window: int = WINDOW) -> DataFrame:
    """Blocks of ``postings`` (term, chunk_id, tf, dl); ``directory`` is a written table."""
    return gathered(postings.join(directory.select("chunk_id", "number"), "chunk_id"), window)


def gathered(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Blocks of ``rows`` (term, number, tf, dl), which are shuffled once; each task's are sorted, so a term filter reads few pages."""
    return _blocks(rows.withColumn("window", F.expr(f"number div {window}")).repartition("term", "window")).sortWithinPartitions("term", "window")


def windowed(chunks: DataFrame, tasks: int, stems: bool = False, window: int = WINDOW) -> DataFrame:
    """What ``gathered`` has of the postings of ``chunks`` (number, text), plain or by stems: texts, shorter than their
    postings, are shuffled once, by window, and a window's terms then are all in one task."""
    rows = chunks.select("number", stemmed_text(word_tokens("text")).alias("text") if stems else "text")
    by_window = rows.withColumn("window", F.expr(f"number div {window}")).repartition(tasks, "window")
    tokens = F.array_remove(F.split("text", " "), "") if stems else None
    return _blocks(postings(by_window, "number", "window", tokens=tokens)).sortWithinPartitions("term", "window")


def _blocks(rows: DataFrame) -> DataFrame:
    entry = F.struct("number", F.col("tf").cast("int").alias("tf"), "dl")
    return rows.groupBy("term", "window").agg(F.count("*").alias("n"), F.max("tf").cast("int").alias("tf_most"), F.min("dl").alias("dl_least"), F.sort_array(F.collect_list(entry)).alias("entries"))


def _gain(tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def weights(queries: DataFrame, heads: DataFrame, figures: DataFrame) -> DataFrame:
    """(q, term, w, need, avgdl) of ``queries`` (q, terms: array of string); a repeated term counts again, an unknown one weighs nothing."""
    terms = queries.select("q", F.explode("terms").alias("term")).withColumn("term", F.lower("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    held = heads.groupBy("term").agg(F.sum("n").alias("n"))
    of = terms.join(held, "term", "left").crossJoin(F.broadcast(figures))  # one row of figures
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(F.col("n").isNull(), 0.0).when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))
    need = F.count("*").over(Window.partitionBy("q"))
    return of.select("q", "term", (F.col("times") * idf).alias("w"), need.alias("need"), "avgdl")


def _scored(chosen: DataFrame, asked: DataFrame, index: Blocks) -> DataFrame:
    """(q, number, score, matched) of the chosen (q, window)."""
    wanted = chosen.join(asked, "q").join(index.blocks.select("term", "window", "entries"), ["term", "window"])
    rows = wanted.select("q", "w", "avgdl", F.inline("entries"))
    return rows.groupBy("q", "number").agg(F.sum(F.col("w") * _gain(F.col("tf"), F.col("dl"))).alias("score"), F.count("*").alias("matched"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = (F.desc(F.round("score", 9)), F.asc("chunk_id"))
    few = rows.withColumn("of", F.row_number().over(Window.partitionBy("q", "doc_id").orderBy(*order))).where(F.col("of") <= PER_DOC).drop("of")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def _round(asked: DataFrame, bounds: DataFrame, index: Blocks, eligible: DataFrame | None, k: int, every: bool, counted: dict | None) -> tuple[DataFrame, DataFrame]:
    """(best rows, queries that had any match at all), scoring windows in waves by their bounds."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "window"))
    ordered = materialise(bounds.withColumn("place", place), "stop-bounds")
    best, matched, done = None, None, 0
    for upto in WAVES:
        chosen = ordered.where((F.col("place") > done) & (F.col("place") <= upto))
        if best is not None:
            kth = best.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
            chosen = chosen.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
        chosen = materialise(chosen.select("q", "window"), "stop-chosen")
        if counted is not None:
            counted["read"] = counted.get("read", 0) + chosen.join(asked, "q").join(index.blocks.select("term", "window"), ["term", "window"]).count()
        rows = _scored(chosen, asked, index)
        if every:
            rows = rows.join(asked.select("q", "need").distinct(), "q").where(F.col("matched") == F.col("need"))
        rows = materialise(rows.select("q", "number", "score").join(index.directory, "number"), "stop-scored")
        found = rows.select("q").distinct()
        matched = found if matched is None else matched.unionAll(found)
        if eligible is not None:
            rows = rows.join(eligible, ["doc_id", "revision"], "left_semi")
        columns = ("q", "chunk_id", "doc_id", "revision", "score")
        was, rows = best, rows.select(*columns)
        best = materialise(ranked(rows if best is None else rows.unionAll(best.select(*columns)), k), "stop-best")
        release(chosen, was)
        done = upto
    return best, materialise(matched.distinct(), "stop-matched")


def top_k(index: Blocks, figures: DataFrame, queries: DataFrame, k: int = 10, eligible: DataFrame | None = None, counted: dict | None = None) -> DataFrame:
    """(q, rank, chunk_id, doc_id, revision, score) of ``queries`` (q, terms): the best ``k`` chunks, two a document; scores negative, best least.

    As keyword search has it: chunks with all terms, and only for queries that have none in the
    whole collection, chunks with any.  ``eligible`` (doc_id, revision): the revisions shown.
    ``counted`` is told how many blocks the queries' terms have and how many were read.
    """
    heads = index.blocks.select("term", "window", "n", "tf_most", "dl_least")
    asked = materialise(weights(queries, heads, figures), "stop-asked")
    blocks = asked.join(heads, "term").withColumn("bound", F.col("w") * _gain(F.col("tf_most"), F.col("dl_least")))
    bounds = materialise(blocks.groupBy("q", "window", "need").agg(F.sum("bound").alias("bound"), F.count("*").alias("terms")), "stop-windows")
    if counted is not None:
        counted["held"] = bounds.agg(F.sum("terms")).first()[0]
    both, matched = _round(asked, bounds.where("terms = need").select("q", "window", "bound"), index, eligible, k, True, counted)
    left = materialise(asked.join(matched, "q", "left_anti"), "stop-left")
    best = both
    if not left.isEmpty():
        some, _ = _round(left, bounds.join(matched, "q", "left_anti").select("q", "window", "bound"), index, eligible, k, False, counted)
        best = both.unionByName(some)
    return best.select("q", "rank", "chunk_id", "doc_id", "revision", (-F.col("score")).alias("score"))
