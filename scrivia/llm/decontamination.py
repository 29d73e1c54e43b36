"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrames only).

Items are short and documents long, so resemblance says nothing and containment
is asked for.  Items are partitioned by size (powers of two of their distinct
shingles).  An item's sketch is its bottom-k MinHash values, among shingles that
fewer items hold first, k being set by its partition: an item contained to
``threshold`` misses at most n - ceil(threshold n) of its n shingles, so of one more
at least one is in the document, and a sketch that long overlooks nothing.

``candidates``: documents of any length probe all their shingles against the
sketches only, copies of a text as one.  ``verified``: of each candidate pair the
whole text's shingles are compared with all of the item's, word by word.

Edge cases: words are runs of letters and digits, lower-cased; items of fewer
words than a shingle are one shingle of all their words; items without words
match nothing; null and empty texts hold nothing; rows equal in id and text are
one; a repeated item id with other text counts its own shingles under one id by
its best; ids are of any type; extra columns are not read (``contained``) or kept
whatever their names (``clean``); empty tables give no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import materialise, membership_filter, possible_members, quoted, release, table, unused

WIDTH = 5
THRESHOLD = 0.8
#: Up to so many sketch rows are broadcast (about 50 bytes each); beyond, a filter and a shuffle.
BROADCAST_SHINGLES = 200_000


def words_of(col: Column):
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _starts(width):
    return F.sequence(F.lit(0), F.size("words") - width)


def item_sketches(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(item, item_id, width, n, shingle, h, sketch: boolean) of every distinct shingle of the items (item_id, text)."""
    items = items.withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.least(F.lit(width), F.size("words")).alias("width"))
    items = items.withColumn("item", F.struct("item_id", F.xxhash64("words").alias("t")))
    at = items.select("item", "item_id", "width", "words", F.explode(_starts(F.col("width"))).alias("p"))
    own = F.slice("words", F.col("p") + 1, F.col("width"))
    every = at.select("item", "item_id", "width", F.array_join(own, " ").alias("shingle"), own.alias("own")).distinct()
    by_width = [F.when(F.col("width") == w, F.xxhash64(*[F.get("own", F.lit(i)) for i in range(w)])) for w in range(1, width + 1)]
    every = every.select("item", "item_id", "width", "shingle", F.coalesce(*by_width).alias("h"))
    sizes = every.groupBy("item").agg(F.count("*").alias("n"))
    held = every.groupBy("h").agg(F.count("*").alias("items"))
    # the partition's largest size gives the sketch length that all of it needs
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    k = (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("long")
    by_hash = Window.partitionBy("item").orderBy("items", F.xxhash64("h"), "h", "shingle")
    ranked = every.join(sizes, "item").join(held, "h").withColumn("rank", F.row_number().over(by_hash))
    return ranked.select("item", "item_id", "width", "n", "shingle", "h", (F.col("rank") <= k).alias("sketch"))


def candidates(texts: DataFrame, sketches: DataFrame, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(text_hash, item) of the texts (text_hash, text) that hold a shingle of an item's sketch; ``sketches`` is a written table."""
    own = sketches.where("sketch").select("h", "width", "item")
    # at most WIDTH
    widths = sorted(r[0] for r in own.select("width").distinct().collect())
    small = own.count() <= broadcast_shingles
    filt = None if small else membership_filter(own.select("h").distinct(), "h", "bench-filter")
    rows = texts.select("text_hash", words_of(F.col("text")).alias("words"))
    met = []
    for w in widths:
        at = rows.where(F.size("words") >= w).select("text_hash", "words", F.explode(_starts(w)).alias("p"))
        probe = at.select("text_hash", F.xxhash64(*[F.get("words", F.col("p") + i) for i in range(w)]).alias("h"))
        these = own.where(F.col("width") == w).select("h", "item")
        met.append(probe.join(F.broadcast(these), "h") if small else possible_members(probe, F.col("h"), filt).join(these, "h"))
    if not met:
        return texts.select("text_hash", F.lit(None).cast(sketches.schema["item"].dataType).alias("item")).where(F.lit(False))
    found = reduce(DataFrame.unionAll, [m.select("text_hash", "item") for m in met]).distinct()
    out = materialise(found, "bench-candidates")
    release(filt and filt.rows)
    return out


def verified(texts: DataFrame, pairs: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(text_hash, digest, item_id, shared, item_shingles, containment) of the candidate ``pairs`` that hold ``threshold`` of the item."""
    filt = membership_filter(materialise(pairs.select("text_hash").distinct(), "bench-texts"), "text_hash", "bench-texts-filter")
    asked = possible_members(texts, F.col("text_hash"), filt).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # each text once, however many copies it has; written, so that no plan splits it into words once a shingle
    asked = asked.groupBy("text_hash", "digest").agg(F.min("text").alias("text")).select("text_hash", "digest", words_of(F.col("text")).alias("words"))
    asked = materialise(asked, "bench-words")
    whole = sketches.groupBy("item", "item_id", "width", "n").agg(F.collect_list("shingle").alias("shingles"))
    both = pairs.join(asked, "text_hash").join(whole, "item")
    own = F.transform(_starts(F.col("width")), lambda p: F.array_join(F.slice("words", p + 1, F.col("width")), " "))
    shared = F.size(F.array_intersect("shingles", F.when(F.size("words") >= F.col("width"), own).otherwise(F.array().cast("array<string>"))))
    counted = materialise(both.select("text_hash", "digest", "item_id", "n", shared.cast("long").alias("shared")), "bench-counted")
    sized = counted.where(F.col("shared") >= F.col("n") * F.lit(threshold))
    best = sized.groupBy("text_hash", "digest", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "shared", "n")).alias("b"))
    best = best.select(
        "text_hash", "digest", "item_id", F.col("b.shared").alias("shared"), F.col("b.n").alias("item_shingles"), F.round("b.containment", 6).alias("containment")
    )
    out = materialise(best, "bench-found")
    release(filt.rows, asked, counted)
    return out


def leaks(texts: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``verified`` pairs of the distinct texts (text_hash, text) and the items (item_id, text)."""
    sketches = materialise(item_sketches(items.select("item_id", F.col("text").cast("string").alias("text")), threshold, width), "bench-sketches")
    pairs = candidates(texts, sketches, broadcast_shingles)
    out = verified(texts, pairs, sketches, threshold)
    release(sketches, pairs)
    return out


def contained(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of documents that hold ``threshold`` of an item."""
    own = F.col(quoted(text)).cast("string")
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(own).alias("text_hash"), own.alias("text"))
    found = leaks(rows.select("text_hash", "text"), items, **options)
    filt = membership_filter(found, "text_hash", "bench-found-filter")
    asked = possible_members(rows, F.col("text_hash"), filt).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    return asked.join(found.drop("text_hash"), "digest").drop("digest")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    cols = [F.col(quoted(c)) for c in docs.columns]
    h, digest, gone = unused(docs.columns, "h", "digest", "gone")
    own = F.col(quoted(text)).cast("string")
    found = leaks(docs.select(F.xxhash64(own).alias("text_hash"), own.alias("text")), items, **options)
    filt = membership_filter(found, "text_hash", "bench-found-filter")
    named = docs.withColumn(h, F.xxhash64(own))
    free = possible_members(named, F.col(h), filt, rest=True).select(*cols)
    asked = possible_members(named, F.col(h), filt).withColumn(digest, F.sha2(own.cast("binary"), 256))
    asked = asked.join(found.select(F.col("digest").alias(gone)).distinct(), F.col(digest).eqNullSafe(F.col(gone)), "left_anti")
    return free.unionByName(asked.select(*cols))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS wd, array_to_string(w[p:p + least(len(w), {WIDTH}) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS p FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
dw AS (SELECT doc_id, hash(text) AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, t, wd, array_to_string(w[p:p + wd - 1], ' ') AS s
      FROM (SELECT doc_id, t, w, wd, unnest(range(1, len(w) - wd + 2)) AS p
            FROM dw, (SELECT DISTINCT wd FROM i) WHERE len(w) >= wd))
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared, CAST(any_value(item_shingles) AS BIGINT) AS item_shingles,
       round(count(*) / any_value(item_shingles), 6) AS containment
FROM d JOIN i USING (wd, s) JOIN n USING (item_id)
GROUP BY doc_id, t, item_id HAVING count(*) >= {THRESHOLD} * any_value(item_shingles)
"""
