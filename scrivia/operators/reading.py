"""Reading one document: outline, section filter, guarded body."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions.text import normal_id
from scrivia.operators import catalog

MAX_FULL, MAX_READ = 30_000, 60_000


def outline(chunks: DataFrame) -> DataFrame:
    """(doc_id, revision, section, chars, first): sections in order of ``first``."""
    out = chunks.groupBy("doc_id", "revision", "section_path").agg(F.sum(F.length("text")).alias("chars"), F.min("position").alias("first"))
    return out.withColumn("section", F.coalesce(F.nullif("section_path", F.lit("")), F.lit("(no heading)"))).drop("section_path")


def in_section(chunks: DataFrame, section: str) -> DataFrame:
    return chunks.where(F.contains(F.lower("section_path"), F.lit(section.lower())))


def body(chunks: DataFrame, limit: int = MAX_READ) -> DataFrame:
    """(doc_id, revision, char_count, included, truncated, text): chunks in order while their characters fit."""
    w = Window.partitionBy("doc_id", "revision").orderBy("position")
    rows = chunks.withColumn("upto", F.sum(F.length("text")).over(w)).withColumn("before", F.lag("section_path").over(w))
    head = F.concat(F.lit("\n§ "), F.coalesce(F.nullif("section_path", F.lit("")), F.lit("(no heading)")), F.lit("\n"))
    piece = F.concat(F.when(F.col("section_path").eqNullSafe(F.col("before")), F.lit("")).otherwise(head), "text")
    fits = F.col("upto") <= limit
    out = rows.groupBy("doc_id", "revision").agg(
        F.sum(F.length("text")).alias("char_count"),
        F.coalesce(F.sum(F.when(fits, F.length("text"))), F.lit(0)).alias("included"),
        F.bool_or(~fits).alias("truncated"),
        F.array_sort(F.collect_list(F.when(fits, F.struct("position", piece.alias("piece"))))).alias("pieces"),
    )
    text = F.trim(F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n"), F.lit(" \n"))
    return out.withColumn("text", text).drop("pieces")


def section_dump(files: DataFrame, chars: int = 150) -> DataFrame:
    """(id, section, path, text_blocks, table_blocks, chars, preview) of every section of ``files`` (id, blocks)."""
    each = files.select("id", F.posexplode("blocks").alias("i", "b"))
    out = each.groupBy("id", F.col("b.section").alias("section")).agg(
        F.array_join(F.first("b.path"), " > ").alias("path"), F.count_if(F.col("b.kind") == "text").alias("text_blocks"),
        F.count_if(F.col("b.kind") == "table").alias("table_blocks"), F.sum(F.length("b.text")).alias("chars"),
        F.array_sort(F.collect_list(F.struct("i", F.substring("b.text", 1, chars).alias("t")))).alias("ts"),
    )
    preview = F.substring(F.array_join(F.transform("ts", lambda x: x["t"]), " "), 1, chars)
    return out.withColumn("preview", preview).drop("ts")


def locate(chains: DataFrame, doc_id: str, revision: str | None = None, loose: bool = True) -> DataFrame:
    """One row (outcome, doc_id, latest_current, wanted, info, revisions) for the document and revision asked for.

    Outcomes: ``unknown`` document (none, or several and no exact one), ``obsolete`` (no revision asked, none
    current), ``no revision`` of that name, ``empty``, ``found``.  Exact identifiers go before looser matches, of any number;
    without ``loose`` there are none of these.
    """
    asked = F.lit(doc_id)
    same = normal_id("doc_id") == normal_id(asked)
    hits = chains.where(catalog.id_score(asked, F.col("doc_id"), F.col("type")) == 100 if loose else same).withColumn("exact", same)
    each = hits.groupBy("exact").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "latest_current", "revisions")).alias("c"))
    best = each.agg(F.max_by(F.struct("n", "c"), "exact").alias("b")).select("b.n", "b.c.*")
    wanted = F.col("latest_current") if revision is None else F.lit(revision.upper())
    rows = best.withColumn("wanted", wanted).withColumn("info", F.get(F.filter("revisions", lambda r: r["revision"] == F.col("wanted")), F.lit(0)))
    outcome = (
        F.when(F.coalesce("n", F.lit(0)) != 1, "unknown").when(F.col("wanted").isNull(), "obsolete").when(F.col("info").isNull(), "no revision")
        .when(F.col("info.is_empty"), "empty").otherwise("found")
    )
    return rows.select(outcome.alias("outcome"), "doc_id", "latest_current", "wanted", "info", "revisions")


def contents(chunks: DataFrame, section: str | None = None, full: int = MAX_FULL, most: int = MAX_READ) -> DataFrame:
    """(outcome, char_count, included, truncated, text) of one document's chunks: ``read``, or ``too large`` for a whole one."""
    got = body(chunks if section is None else in_section(chunks, section), most)
    large = F.lit(section is None) & (F.col("char_count") > full)
    return got.select(F.when(large, "too large").otherwise("read").alias("outcome"), "char_count", "included", "truncated", F.when(~large, F.col("text")).alias("text"))
