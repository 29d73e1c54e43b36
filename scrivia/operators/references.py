"""The graph of identifier mentions between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.functions.text import normal_id

# Names of the directions.
DIRECTIONS = {"in": "inbound", "out": "outbound", "inbound": "inbound", "outbound": "outbound", "both": "both"}


def mention_shape(types: list[str]) -> str:
    """Mentions of observed types but IFU, longest first so none shadows another."""
    alternatives = "|".join(sorted((t for t in types if t != "IFU"), key=lambda t: (-len(t), t)))
    return rf"\b(IFU-MX1|(?:{alternatives})(?:-[A-Z0-9]{{2,3}})?-\d{{2,4}})\b"


def extract_refs(chunks: DataFrame, shape: str) -> DataFrame:
    """(from_doc, from_rev, to_doc, n_mentions, context) of ``chunks`` (doc_id, revision, position, text).

    The context is 60 characters about the first mention.  Offsets come from the gaps between matches.
    """
    hits = F.regexp_extract_all("text", F.lit(shape), F.lit(1))
    gaps = F.split("text", shape, -1)
    found = chunks.where(F.col("text").rlike(shape)).select("doc_id", "revision", "position", "text", hits.alias("hits"), gaps.alias("gaps"))
    each = found.select("doc_id", "revision", "position", "text", "hits", "gaps", F.posexplode("hits").alias("i", "to_doc"))
    each = each.where(F.col("to_doc") != F.col("doc_id"))
    count = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    start = count(F.slice("gaps", F.lit(1), F.col("i") + 1)) + count(F.slice("hits", F.lit(1), F.col("i")))
    low = F.greatest(F.lit(0), start - 60)
    each = each.withColumn("context", F.trim(F.substring("text", low + 1, start + F.length("to_doc") + 60 - low)))
    return each.groupBy(F.col("doc_id").alias("from_doc"), F.col("revision").alias("from_rev"), "to_doc").agg(
        F.count("*").alias("n_mentions"), F.min_by("context", F.struct("position", "i")).alias("context")
    )


def dangling(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """Targets that are no document."""
    return refs.select("to_doc").distinct().join(documents.select(F.col("doc_id").alias("to_doc")), "to_doc", "left_anti")


def outbound(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """Per source and target over all revisions: the maxima of mentions and of context, each by itself."""
    known = documents.select(F.col("doc_id").alias("to_doc")).distinct().withColumn("k", F.lit(True))
    top = refs.groupBy("from_doc", "to_doc").agg(F.max("n_mentions").alias("mentions"), F.substring(F.max("context"), 1, 160).alias("context"))
    return top.join(known, "to_doc", "left").select("from_doc", "to_doc", "mentions", F.coalesce("k", F.lit(False)).alias("resolved"), "context")


def inbound(refs: DataFrame) -> DataFrame:
    return refs.select("to_doc", "from_doc", "from_rev", F.col("n_mentions").alias("mentions"), F.substring("context", 1, 160).alias("context"))


def get_references(refs: DataFrame, documents: DataFrame, doc_id: str, direction: str = "both") -> dict[str, DataFrame]:
    """Frames by direction for one document, identified by its normalised id."""
    way = DIRECTIONS.get(direction.lower())
    if way is None:
        raise ValueError(f"no such direction: {direction!r} (known: {', '.join(DIRECTIONS)})")
    out, same = {}, normal_id(F.lit(doc_id))
    if way in ("outbound", "both"):
        out["references"] = outbound(refs, documents).where(normal_id("from_doc") == same).orderBy(F.desc("mentions"), "to_doc")
    if way in ("inbound", "both"):
        out["cited_by"] = inbound(refs).where(normal_id("to_doc") == same).orderBy(F.desc("mentions"), "from_doc", "from_rev")
    return out
