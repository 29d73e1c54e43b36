"""Headings and list items of web pages as sections, with Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.functions.text import squeeze
from scrivia.operators import chunking

_TAG = r"(?is)<(h[1-9]|p|li)\b[^>]*>(.*?)</\1>"


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, ord, path, section, kind, text) from h1..h9, p and li elements, list items prefixed."""
    clean = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", " ")
    tags = F.regexp_extract_all(clean, F.lit(_TAG), F.lit(1))
    texts = F.regexp_extract_all(clean, F.lit(_TAG), F.lit(2))
    items = F.transform(
        F.arrays_zip(tags.alias("t"), texts.alias("x")),
        lambda z: F.struct(
            F.when(F.lower(z["t"]).rlike("^h[1-9]$"), F.substring(z["t"], 2, 1).cast("int")).alias("level"),
            F.lit("text").alias("kind"),
            F.when((F.lower(z["t"]) == "li") & (squeeze(F.regexp_replace(z["x"], "<[^>]+>", " ")) != ""), F.concat(F.lit("- "), squeeze(F.regexp_replace(z["x"], "<[^>]+>", " "))))
            .otherwise(squeeze(F.regexp_replace(z["x"], "<[^>]+>", " "))).alias("text"),
        ),
    )
    out = pages.select("page_id", F.posexplode(chunking.section_fold(items)).alias("ord", "b"))
    return out.select("page_id", "ord", F.array_join("b.path", " > ").alias("path"), "b.section", "b.kind", "b.text")
