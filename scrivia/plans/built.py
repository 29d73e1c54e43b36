"""An index over the driver's tables, each table built once for each state of them and session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.operators import catalog, chunking, content, early_stop, references, vectors
from scrivia.sources import fixtures as fx
from scrivia.storage import changed, materialise, release

#: Characters of text whose postings a task gathers and sorts in memory.
TASK_CHARS = 16_000_000

_BUILT: dict[tuple, Index] = {}
_VECTORS: dict[tuple, vectors.VectorIndex] = {}


class Index(dict):
    """Tables by name, each built when it is first asked for: a query pays for what it reads.

    staged (the collection's files with their chunks); documents, chunks, refs, defaults, titles (their tokens), directory; titled (chains with their titles, from names alone);
    blocks, postings (term, number, tf, dl) and figures of plain and (stem_...) of stemmed tokens.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        kind, what = ("stem_", name[5:]) if name.startswith("stem_") else ("", name)
        self[name] = made = getattr(self, f"_{what}")(*[kind] * (what in ("blocks", "postings", "figures")))
        return made

    def _staged(self) -> DataFrame:
        return materialise(fx.kept(self.spark, self.sf_dir).select(*fx.DOCUMENT, "chunks"), "index-staged")

    def _documents(self) -> DataFrame:
        return self["staged"].drop("chunks")

    def _chunks(self) -> DataFrame:
        # a document's chunks come from one row, so their numbers are neighbours; written down, they are fixed
        return materialise(fx.chunks_of(self["staged"]).withColumn("number", F.monotonically_increasing_id()), "index-chunks")

    def _directory(self) -> DataFrame:
        return self["chunks"].select("chunk_id", "doc_id", "revision", "number")

    def _defaults(self) -> DataFrame:
        return materialise(catalog.default_revisions(self["documents"]), "index-defaults")

    def _titles(self) -> DataFrame:
        return materialise(catalog.tokens_of(catalog.chains(self["documents"])), "index-titles")

    def _titled(self) -> DataFrame:
        # no file is folded for its name
        names = None if "staged" in self else materialise(fx.names(self.spark, self.sf_dir), "index-names")
        kept = self["documents"] if names is None else chunking.first_copies(names)
        made = materialise(catalog.titled(kept), "index-titled")
        release(names)
        return made

    def _refs(self) -> DataFrame:
        return materialise(references.extract_refs(self["chunks"], references.mention_shape(list(fx.TYPES))), "index-refs")

    def _blocks(self, kind: str) -> DataFrame:
        size = self["documents"].agg(F.sum("char_count")).first()[0] or 0
        tasks = max(self.spark.sparkContext.defaultParallelism, size // TASK_CHARS + 1)
        return materialise(early_stop.windowed(self["chunks"], tasks, bool(kind)), "index-blocks")

    def _postings(self, kind: str) -> DataFrame:
        return self[f"{kind}blocks"].select("term", F.inline("entries"))

    def _figures(self, kind: str) -> DataFrame:
        return materialise(content.corpus_figures(self[f"{kind}postings"], self["chunks"]), "index-figures")


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    source = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, source, changed(spark, source))
    if key not in _BUILT:
        _BUILT[key] = Index(spark, sf_dir)
    return _BUILT[key]


def vectors_of(spark: SparkSession, sf_dir: str, shown: bool = False) -> vectors.VectorIndex:
    """An index of all embeddings (ids: vec_id), or of those that stand for a chunk of a default revision (ids: chunk_id, groups: doc_id)."""
    sources = [f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings")]
    key = (spark.sparkContext.applicationId, shown, *sources, *[changed(spark, s) for s in sources])
    if key not in _VECTORS:
        rows = fx.read(spark, sf_dir, "embeddings")
        if shown:
            i = index_of(spark, sf_dir)
            first = i["chunks"].where("position = 0").select("chunk_id", "doc_id", "revision", F.col("id").alias("vec_id"))
            of = first.join(i["defaults"], ["doc_id", "revision"], "left_semi")
            rows = of.join(rows, "vec_id").select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("group"), "embedding")
        else:
            rows = rows.select(F.col("vec_id").alias("id"), "embedding")
        _VECTORS[key] = vectors.build(rows)
    return _VECTORS[key]


def embedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, vec_id) of the chunks that a vector of the driver's tables stands for."""
    return chunks.where("position = 0").select("chunk_id", F.col("id").alias("vec_id")).join(vectors.select("vec_id"), "vec_id", "left_semi")
