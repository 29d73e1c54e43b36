"""Ordered folds over a document's blocks: sections, table blocks, chunks, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions.folds import emitting
from scrivia.functions.text import heading_label
from scrivia.storage import materialise, release

MAX_CHUNK_CHARS = 2_000
MAX_TABLE_CHARS = 4_000
#: Names shared by several files that are broadcast at most: some megabytes.
SHARED_MOST = 100_000
_TEXT = "struct<path:array<string>,section:int,kind:string,text:string>"
_CHUNK = "struct<section_path:string,section:int,kind:string,text:string>"


def section_fold(items: Column | str) -> Column:
    """Blocks with their heading path.

    ``items``: array<struct<level:int (null: a block), kind, text>> in document order.  A heading of level n
    cuts the path to n - 1 parts and adds itself, so a skipped level leaves a short path;
    headings and blocks without text are dropped.
    """
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(0).alias("section"))

    def step(s, x):
        heading, blank = x["level"].isNotNull(), x["text"] == ""
        path = F.concat(F.slice(s["path"], F.lit(1), F.greatest(F.lit(0), x["level"] - 1)), F.array(x["text"]))
        after = F.when(heading & ~blank, F.struct(path.alias("path"), (s["section"] + 1).alias("section"))).otherwise(s)
        return after, ~heading & ~blank, F.struct(s["path"].alias("path"), s["section"].alias("section"), x["kind"].alias("kind"), x["text"].alias("text"))

    return emitting(items, start, step, _TEXT)


def chunk_pack(blocks: Column | str, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Blocks packed greedily, section by section, never split; the array's index is the position.

    A chunk closes where its blocks' characters (line ends not counted) and the next block's pass ``limit``.
    The fold carries the open chunk only.
    """
    start = F.struct(F.lit(None).cast(_CHUNK).alias("open"), F.lit(0).alias("n"))

    def step(s, x):
        was, size = s["open"], F.length(x["text"])
        closes = was.isNotNull() & ((was["section"] != x["section"]) | (s["n"] + size > limit))
        fresh = F.struct(heading_label(x["path"]).alias("section_path"), x["section"].alias("section"), x["kind"].alias("kind"), x["text"].alias("text"))
        grown = F.struct(
            was["section_path"].alias("section_path"),
            was["section"].alias("section"),
            F.when(was["kind"] == x["kind"], x["kind"]).otherwise("mixed").alias("kind"),
            F.concat(was["text"], F.lit("\n"), x["text"]).alias("text"),
        )
        opens = closes | was.isNull()
        after = F.struct(F.when(opens, fresh).otherwise(grown).alias("open"), F.when(opens, size).otherwise(s["n"] + size).alias("n"))
        return after, closes, was

    return emitting(blocks, start, step, _CHUNK, lambda s: F.filter(F.array(s["open"]), lambda c: c.isNotNull()))


def table_blocks(rows: Column | str, limit: int = MAX_TABLE_CHARS) -> Column:
    """Markdown blocks of a table (array<array<string>>): the header is repeated for every piece."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    first = F.get(full, F.lit(0))
    head = F.concat(line(first), F.lit("\n"), line(F.transform(first, lambda c: F.lit("---"))))
    start = F.struct(head.alias("head"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s, r):
        text = line(r)
        closes = s["open"].isNotNull() & (s["n"] + F.length(text) > limit)
        opens = closes | s["open"].isNull()
        size = F.length(text) + 1
        piece = F.concat(F.when(opens, s["head"]).otherwise(s["open"]), F.lit("\n"), text)
        after = F.struct(s["head"].alias("head"), piece.alias("open"), (F.when(opens, F.length(s["head"])).otherwise(s["n"]) + size).alias("n"))
        return after, closes, s["open"]

    last = lambda s: F.array(F.coalesce(s["open"], s["head"]))
    packed = emitting(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), start, step, "string", last)
    return F.filter(packed, lambda t: t.isNotNull())


def content_hash(chunks: Column | str) -> Column:
    return F.sha2(F.array_join(F.transform(chunks, lambda c: c["text"]), "\n"), 256)


def char_count(chunks: Column | str) -> Column:
    return F.length(F.array_join(F.transform(chunks, lambda c: c["text"]), "\n"))


def explode_chunks(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, position, section_path, kind, text) of ``docs`` with a ``chunks`` array."""
    out = docs.select(*keep, F.posexplode("chunks").alias("position", "c"))
    return out.select(*keep, "position", "c.section_path", "c.kind", "c.text")


def _copies(*last: Column):
    return Window.partitionBy("doc_id", "revision").orderBy(*last, "is_duplicate", "filename")


def ranked(docs: DataFrame, *last: Column) -> DataFrame:
    """Adds ``rank`` (1: kept) per (doc_id, revision): rows for which a condition of ``last`` holds go last, originals
    before copies, then by filename."""
    return docs.withColumn("rank", F.row_number().over(_copies(*last)))


def first_copies(docs: DataFrame, most: int = SHARED_MOST) -> DataFrame:
    """The rows of rank 1.  Only rows that share their (doc_id, revision) with others are shuffled, with all their columns;
    those are told by their names, unless over ``most`` names are shared."""
    shared = materialise(docs.groupBy("doc_id", "revision").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "revision"), "shared-names")
    n = shared.count()
    if not 0 < n <= most:
        release(shared)
        return docs if n == 0 else ranked(docs).where("rank = 1").drop("rank")
    names = F.broadcast(shared.select(F.col("doc_id").alias("shared_id"), F.col("revision").alias("shared_revision")))
    same = F.col("doc_id").eqNullSafe(F.col("shared_id")) & F.col("revision").eqNullSafe(F.col("shared_revision"))
    among = ranked(docs.join(names, same, "left_semi")).where("rank = 1").drop("rank")
    return docs.join(names, same, "left_anti").unionByName(among)


def dedupe(docs: DataFrame, *last: Column) -> DataFrame:
    """``ranked``, with ``conflict``: a copy whose content is another."""
    first = F.first("content_hash").over(_copies(*last))
    return ranked(docs, *last).withColumn("conflict", (F.col("rank") > 1) & (F.col("content_hash") != first))
