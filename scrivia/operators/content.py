"""Keyword (BM25) and vector search over chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions.stemming import stem_of
from scrivia.functions.text import embed_text, word_tokens
from scrivia.operators import vectors
from scrivia.operators.catalog import default_revisions
from scrivia.storage import materialise

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
PER_DOC, EXCERPT = 2, 700
#: Rows of a search that are broadcast at most: some tens of megabytes.
FOUND_MOST = 300_000


def postings(chunks: DataFrame, *key: str, tokens: Column | None = None) -> DataFrame:
    """(term, key: chunk_id if none is named, tf, dl: the chunk's tokens), counted row by row: nothing is shuffled."""
    key = key or ("chunk_id",)
    rows = chunks.select(*key, F.array_sort(word_tokens("text") if tokens is None else tokens).alias("ts")).withColumn("n", F.size("ts"))
    # where equal terms, neighbours now, begin
    begins = F.filter(F.transform("ts", lambda t, i: F.when((i == 0) | (t != F.get("ts", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.where("n > 0").select(*key, "ts", "n", begins.alias("at"))
    each = F.transform("at", lambda a, i: F.struct(F.get("ts", a).alias("term"), (F.coalesce(F.get("at", i + 1), F.col("n")) - a).cast("long").alias("tf")))
    return rows.select(*key, F.col("n").alias("dl"), F.inline(each)).select("term", *key, "tf", "dl")


def stemmed_postings(post: DataFrame) -> DataFrame:
    """``post`` by stems: only the distinct vocabulary goes through the stemmer."""
    vocabulary = post.select("term").distinct().select("term", stem_of("term").alias("stem"))
    return post.join(vocabulary, "term").groupBy(F.col("stem").alias("term"), "chunk_id", "dl").agg(F.sum("tf").alias("tf")).select("term", "chunk_id", "tf", "dl")


def corpus_figures(post: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (total, avgdl): chunks, those without tokens too, and their mean tokens, from the postings' sums."""
    tokens = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    return chunks.agg(F.count("*").alias("total")).crossJoin(tokens).select("total", (F.col("tokens") / F.when(F.col("total") > 0, F.col("total"))).alias("avgdl"))


def bm25(post: DataFrame, figures: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, matched, score): negative BM25 over all chunks, so the best come first; a repeated term counts again."""
    times: dict[str, int] = {}
    for t in terms:
        times[t.lower()] = times.get(t.lower(), 0) + 1
    # the terms' postings only: a term filter reads few row groups of a table ordered by term
    hits = post.where(F.col("term").isin(*times))
    count = F.create_map(*[F.lit(x) for kv in times.items() for x in kv])[F.col("term")]
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))
    # one row of figures, a row a term of the query
    weights = df.crossJoin(F.broadcast(figures)).select("term", (count * idf).alias("w"), "avgdl")
    tf = F.col("tf")
    gain = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(weights), "term").groupBy("chunk_id").agg(F.count("*").alias("matched"), (-F.sum(gain)).alias("score"))


def keyword_scores(post: DataFrame, figures: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with all terms, or where the corpus has none of those, with any."""
    if not terms:
        raise ValueError("empty query")
    scored = bm25(post, figures, terms)
    need = len({t.lower() for t in terms})
    if need == 1:
        return scored.select("chunk_id", "score")
    most = scored.agg(F.max("matched").alias("most"))
    both = scored.crossJoin(F.broadcast(most))  # one row
    return both.where((F.col("matched") == need) | (F.col("most") < need)).select("chunk_id", "score")


def assemble(scores: DataFrame, chunks: DataFrame, documents: DataFrame, defaults: DataFrame | None = None, top_k: int = 10, include_superseded: bool = False) -> DataFrame:
    """Best first, two chunks a document, latest revisions only unless asked; ``defaults`` as ``default_revisions`` gives them.

    No fetch limits: filters come before the cap and the cap before the limit.
    """
    defaults = default_revisions(documents) if defaults is None else defaults
    rows = scores.join(chunks.select("chunk_id", "doc_id", "revision"), "chunk_id")
    rows = rows.join(defaults, ["doc_id", "revision"], "left" if include_superseded else "inner")
    w = Window.partitionBy("doc_id").orderBy("score", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PER_DOC)
    # texts and titles are looked up for the few rows that are shown
    few = rows.orderBy("score", "chunk_id").limit(top_k).join(chunks.drop("doc_id", "revision"), "chunk_id").join(documents.select("doc_id", "revision", "title"), ["doc_id", "revision"])
    return few.orderBy("score", "chunk_id").select(
        "chunk_id", "doc_id", "revision", "title", F.col("section_path").alias("section"), "kind",
        F.coalesce("is_current", F.lit(False)).alias("is_current"), F.substring("text", 1, EXCERPT).alias("excerpt"), "score",
    )


# --- vectors ----------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def semantic(index: vectors.VectorIndex, queries: DataFrame, chunks: DataFrame, documents: DataFrame, defaults: DataFrame, top_k: int = 10) -> DataFrame:
    """The ``top_k`` chunks, two a document, nearest to each of ``queries`` (q, embedding), as ``assemble`` shows them, with q and rank.

    ``index`` holds the chunks that may be shown: ids are chunk ids, groups document ids.  What is found is without texts and
    goes to the chunks, up to ``FOUND_MOST`` rows; beyond these, excerpts are shuffled.
    """
    near = vectors.search(index, queries, top_k, cap=PER_DOC).select("q", "rank", F.col("id").alias("chunk_id"), (-F.col("score")).alias("score"))
    near = materialise(near, "found")
    shown = chunks.select("chunk_id", "doc_id", "revision", F.col("section_path").alias("section"), "kind", F.substring("text", 1, EXCERPT).alias("excerpt"))
    rows = shown.join(F.broadcast(near) if near.count() <= FOUND_MOST else near, "chunk_id")
    rows = rows.join(documents.select("doc_id", "revision", "title"), ["doc_id", "revision"]).join(defaults, ["doc_id", "revision"], "left")
    return rows.select("q", "rank", "chunk_id", "doc_id", "revision", "title", "section", "kind", F.coalesce("is_current", F.lit(False)).alias("is_current"), "excerpt", "score")


def embed_backlog(chunks: DataFrame, documents: DataFrame, embedded: DataFrame) -> DataFrame:
    """(chunk_id, text) of chunks that have no vector yet, as they are embedded."""
    left = chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti")
    rows = left.join(documents.select("doc_id", "revision", "title"), ["doc_id", "revision"])
    return rows.select("chunk_id", embed_text("doc_id", "revision", "title", "section_path", "text").alias("text"))


def build_embeddings(chunks: DataFrame, documents: DataFrame, embedded: DataFrame, embed: Callable, model: str, stored_model: str | None = None, batch: int = 128) -> DataFrame:
    """Vectors (chunk_id, embedding) of the backlog; ``embed`` maps a list of texts to vectors.

    Refuses to mix models.
    """
    if stored_model and stored_model != model:
        raise ValueError(f"index has {stored_model} embeddings; refusing to append {model}")

    def run(frames):
        import pandas as pd

        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"chunk_id": part.chunk_id, "embedding": [list(map(float, v)) for v in embed(list(part.text))]})

    raw = embed_backlog(chunks, documents, embedded).mapInPandas(run, "chunk_id string, embedding array<double>")
    return raw.select("chunk_id", l2_normalised(F.col("embedding")).alias("embedding"))
