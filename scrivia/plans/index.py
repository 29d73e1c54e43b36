"""build_index: Word files in, Parquet tables out; open_index reads them back."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.text import parse_filename
from scrivia.operators import catalog, chunking, content, early_stop, references, vectors
from scrivia.plans import log
from scrivia.sources import docx
from scrivia.sources.fixtures import DOCUMENT, chunks_of
from scrivia.storage import materialise, release


def fold_files(parsed: DataFrame) -> DataFrame:
    """Files with parsed names as documents with their chunks, copies ranked after the first, unreadable files last."""
    files = docx.extract(parsed).withColumn("revision", F.coalesce("revision", F.lit(""))).withColumn("chunks", chunking.chunk_pack("blocks"))
    files = files.withColumns(
        {
            "content_hash": chunking.content_hash("chunks"),
            "char_count": chunking.char_count("chunks").cast("long"),
            "is_empty": F.size("chunks") == 0,
            "id": F.xxhash64("filename"),
        }
    )
    return chunking.dedupe(files, F.col("error").isNotNull())


def write_tables(documents: DataFrame, chunks: DataFrame, put: Callable, get: Callable) -> None:
    """What searching needs besides: stemmed postings by range of term, their blocks, the corpus's figures, default revisions."""
    # a term filter reads few row groups
    put(content.stemmed_postings(content.postings(chunks)).repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), "postings")
    put(early_stop.numbered(chunks), "directory")
    put(early_stop.blocked(get("postings"), get("directory")), "blocks")
    put(content.corpus_figures(get("postings"), chunks), "figures")
    put(catalog.default_revisions(documents), "defaults")


def build_index(spark: SparkSession, corpus: str, path: str) -> dict:
    """Ingest a folder of Word files; any unparsable file name aborts.

    Tables go to folders of their own, and one commit names them when all are there:
    readers see the old index or the new one, and a failed build leaves the old.
    """
    began = time.time()
    parsed = parse_filename(docx.corpus_files(spark, corpus))
    bad = [repr(r[0]) for r in parsed.where("doc_id IS NULL").select("filename").orderBy("filename").toLocalIterator()]
    if bad:
        raise ValueError(f"{len(bad)} file names do not start with a document ID: " + ", ".join(bad))
    at: dict[str, str] = {}
    put = lambda df, name: at.__setitem__(name, log.written(path, name, df))
    get = lambda name: spark.read.parquet(f"{path}/{at[name]}")
    staged = materialise(fold_files(parsed), "staged")  # the folds run once; all tables derive from it
    kept = staged.where("rank = 1 and error is null")
    put(kept.select(*DOCUMENT), "documents")
    put(chunks_of(kept).sortWithinPartitions("doc_id", "revision", "position"), "chunks")
    # every file, with what became of it
    outcome = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("rank") == 1, "kept").when(F.col("conflict"), "conflicting copy").otherwise("copy")
    put(staged.select("filename", "doc_id", "revision", outcome.alias("outcome"), "error"), "files")
    chunks, documents = get("chunks"), get("documents")
    # document types are a column of the catalog, and a mention's shape lists them
    types = [r[0] for r in documents.select("type_prefix").distinct().collect()]
    put(references.extract_refs(chunks, references.mention_shape(types)).dropDuplicates(["from_doc", "from_rev", "to_doc"]), "refs")
    write_tables(documents, chunks, put, get)
    put(spark.createDataFrame([("corpus_dir", corpus), ("chunk_max_chars", str(chunking.MAX_CHUNK_CHARS))], "key string, value string"), "meta")
    stats = ingest_report(*[get(n) for n in ("files", "documents", "chunks", "refs")]).first().asDict()
    # whatever the index held, vectors too, is of other chunks
    log.commit(spark, path, lambda seen: log.Change(anew={**at, **_emptied(spark, path, seen, at)}))
    release(staged)
    return {**stats, "seconds": round(time.time() - began, 1)}


def _emptied(spark: SparkSession, path: str, seen: log.State | None, made: dict) -> dict[str, DataFrame]:
    held = log.opened(spark, path, {n: at for n, at in seen.tables.items() if n not in made}) if seen else {}
    return {name: df.limit(0) for name, df in held.items()}


def ingest_report(files: DataFrame, documents: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of counts over an index's tables."""
    a = files.agg(
        F.count("*").alias("files"), F.count_if(F.col("outcome") == "copy").alias("duplicates_skipped"),
        F.count_if(F.col("outcome") == "conflicting copy").alias("duplicates_conflicting"), F.count_if(F.col("outcome") == "unreadable").alias("unreadable"),
    )
    b = documents.agg(F.count("*").alias("documents"), F.countDistinct("doc_id").alias("doc_ids"), F.count_if("is_empty").alias("empty_docs"))
    c = documents.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("rev_chains"))
    parts = (a, b, c, chunks.agg(F.count("*").alias("chunks")), refs.agg(F.count("*").alias("ref_edges")), references.dangling(refs, documents).agg(F.count("*").alias("dangling_refs")))
    return reduce(DataFrame.crossJoin, parts)  # one row each


def current(spark: SparkSession, path: str) -> log.State:
    found = log.state(spark, path)
    if found is None:
        raise FileNotFoundError(f"search index not found at {path}: run build_index first")
    return found


def set_meta(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Insert or replace one entry of the key-value table."""

    def change(seen: log.State) -> log.Change:
        old = log.opened(spark, path, seen.tables)["meta"].where(F.col("key") != key)
        return log.Change(anew={"meta": old.unionAll(spark.createDataFrame([(key, value)], old.schema)).coalesce(1)})

    current(spark, path)
    log.commit(spark, path, change)


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index's tables by name, as of the last commit; ``embeddings`` and their blocks where there are any."""
    return log.opened(spark, path, current(spark, path).tables)


def backfill_embeddings(spark: SparkSession, path: str, embed: Callable, model: str, batch: int = 128) -> int:
    """Embed and store the chunks without a vector, record the model, and return how many there were."""
    current(spark, path)
    filled = 0

    def change(seen: log.State) -> log.Change:
        nonlocal filled
        index = log.opened(spark, path, seen.tables)
        meta = {r["key"]: r["value"] for r in index["meta"].collect()}  # a few entries
        held = index.get("embeddings")
        known = spark.createDataFrame([], "chunk_id string, embedding array<double>") if held is None else held
        stored = None if known.isEmpty() else meta.get("embed_model")
        new = materialise(content.build_embeddings(index["chunks"], index["documents"], known, embed, model, stored, batch), "embeddings")
        filled = new.count()
        pivots, blocks = vectors.saved(vectors.build(known.unionByName(new).select(F.col("chunk_id").alias("id"), "embedding")), spark)
        told = index["meta"].where("key <> 'embed_model'").unionAll(spark.createDataFrame([("embed_model", model)], index["meta"].schema)).coalesce(1)
        return log.Change(anew={"vector_pivots": pivots, "vector_blocks": blocks, "meta": told}, more={"embeddings": new}, reads=("embeddings", "chunks"))

    log.commit(spark, path, change)
    return filled
