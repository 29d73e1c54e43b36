"""Extension: new Word files appended to an index as they arrive (file stream and foreachBatch).

The collection itself is static per session; this adds documents, chunks and postings (blocks
of windows of their own, so none that are there change) of new files to an index that
``build_index`` made: folders of their own, named by one commit a batch.  A revision the
index holds already is a copy and left out, and so are files whose name has no document ID.
The reference graph is left to the next ``build_index``, as a new type changes what counts
as a mention in older documents.  Figures are sums that a batch adds to; default revisions, a
small table, are written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.text import parse_filename
from scrivia.operators import catalog, content, early_stop
from scrivia.plans import log
from scrivia.plans.index import DOCUMENT, current, fold_files
from scrivia.sources import docx
from scrivia.sources.fixtures import chunks_of
from scrivia.storage import materialise, release


def grown_figures(held: DataFrame, added: DataFrame) -> DataFrame:
    """(total, avgdl) of two collections' figures together."""
    both = held.unionByName(added)
    return both.agg(F.sum("total").alias("total"), (F.sum(F.col("total") * F.coalesce("avgdl", F.lit(0.0))) / F.when(F.sum("total") > 0, F.sum("total"))).alias("avgdl"))


def append(spark: SparkSession, path: str, files: DataFrame) -> int:
    """Add the Word ``files`` (as a binary file source reads them) that are new; returns how many documents they make."""
    ids = ["doc_id", "revision"]
    folded = materialise(fold_files(parse_filename(docx.named(files)).where("doc_id IS NOT NULL")).where("rank = 1 and error is null"), "arrived")  # the folds run once
    added = 0

    def change(seen: log.State) -> log.Change:
        nonlocal added
        index = log.opened(spark, path, seen.tables)
        new = materialise(folded.join(index["documents"].select(*ids), ids, "left_anti"), "arrived-new")
        added = new.count()
        if not added:
            return log.Change()
        documents, chunks = new.select(*DOCUMENT), chunks_of(new)
        post = materialise(content.stemmed_postings(content.postings(chunks)), "arrived-postings")
        directory = materialise(early_stop.numbered(chunks, early_stop.next_number(index["directory"])), "arrived-directory")
        anew = {
            "figures": grown_figures(index["figures"], content.corpus_figures(post, chunks)),
            "defaults": catalog.default_revisions(index["documents"].unionByName(documents)),
        }
        more = {"documents": documents, "chunks": chunks, "postings": post, "directory": directory, "blocks": early_stop.blocked(post, directory)}
        # what is new and which numbers are free follow from these
        return log.Change(anew, more, reads=("documents", "directory"))

    log.commit(spark, path, change)
    release(folded)
    return added


def append_stream(spark: SparkSession, corpus: str, path: str, checkpoint: str):
    """A query that appends new files under ``corpus`` to the index at ``path``.

    A batch that is run again finds its documents in the index and adds nothing; several
    streams may write to one index.
    """
    current(spark, path)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.docx").load(corpus)
    add = lambda batch, n: append(batch.sparkSession, path, batch) and None
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
