"""Sharding by extendible hashing.

A document's place is a 60-bit hash; the directory maps hash prefixes to shards
and only a bucket over the byte limit splits on one more bit.  The directory is
built from sums: bytes per cell (prefixes of enough bits that cells are small),
rolled up to every shorter prefix; a shard is the shortest prefix whose bytes
fit.  Cells still too large are split on further bits, which touches no
other rows.  What no bit can split (documents of one hash, or one document above
the limit) goes to overflow pages, numbered along the bucket's running bytes.

Edge cases: null ids hash as the empty string, and repeated ids share a hash
and so a shard, or its overflow pages; null and empty texts have 0 bytes and still
get a shard; a document larger than the limit has a page of its own; ids are of any
type; columns not in ``keep`` are not read; an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import materialise, quoted, release, running, table, unused

SHARD_BYTES = 16 << 20
HASH_BITS = 60
_STEP = 12


def place(doc_id: Column):
    """The leading 60 bits of MD5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h, bits):
    """The first ``bits`` of a 60-bit hash as a number (bits: Column or int)."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - bits).cast("int"))


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The directory of (h, bytes) rows: levels of (bits, cells), most rows need the first only.

    Each ``cells`` maps the hash prefixes of ``bits`` bits it settles to their
    shard: (cell, prefix, depth, shard_bytes).  Cells it leaves out are those a later
    level splits further.  A shard at depth 60 may exceed the limit.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low, top = 0, max(1, (max(1, total // limit)).bit_length() + 4)
    levels, open_rows = [], sizes
    while True:
        top = min(top, HASH_BITS)
        cells = open_rows.groupBy(_prefix(F.col("h"), top).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        cells = materialise(cells, "shard-cells")
        above = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, cast({top} - depth as int))")
        )
        sums = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        fits = (F.col("shard_bytes") <= limit) | F.lit(top == HASH_BITS) & (F.col("depth") == top)
        # the shortest prefix that fits; one that covers a settled shorter one fits too, so least depth wins
        settled = above.join(sums.where(fits), ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf")
        )
        settled = materialise(settled.select("cell", "leaf.prefix", "leaf.depth", "leaf.shard_bytes"), "shard-cells")
        levels.append((top, settled))
        left = materialise(cells.join(settled, "cell", "left_anti").select("cell"), "shard-open")
        if top == HASH_BITS or left.isEmpty():
            return levels
        open_rows = materialise(open_rows.join(left, _prefix(F.col("h"), top) == F.col("cell"), "left_semi"), "shard-rows")
        low, top = top + 1, top + _STEP


def paged(over: DataFrame, limit: int) -> DataFrame:
    """(row, page, page_bytes) of the rows (row, depth, prefix, bytes) of buckets that no bit can split.

    Pages of half the limit by running bytes; what is above half the limit itself gets a
    page a row, numbered downwards.
    """
    half = max(1, limit // 2)
    big = F.col("bytes") > half
    over = materialise(over.withColumn("big", big).withColumn("one", F.lit(1)), "shard-over")
    run = running(over, ["depth", "prefix", "big"], [F.col("bytes"), F.col("row")], "bytes", "before", "shard-pages")
    count = running(over, ["depth", "prefix", "big"], [F.col("bytes"), F.col("row")], "one", "k", "shard-large").select(F.col("row").alias("r"), "k")
    page = F.when(F.col("big"), -F.col("k") - 1).otherwise(F.floor(F.greatest(F.lit(0), F.col("before") + F.col("bytes") - 1) / half))
    at = run.join(count, F.col("row") == F.col("r")).select("row", "depth", "prefix", "bytes", page.cast("long").alias("page"))
    at = materialise(at, "shard-pages")
    sums = materialise(at.groupBy("depth", "prefix", "page").agg(F.sum("bytes").alias("page_bytes")), "shard-page-bytes")
    return materialise(at.join(sums, ["depth", "prefix", "page"]).select("row", "page", "page_bytes"), "shard-paged")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) with bytes, shard (bits and page), depth, shard_bytes; where a kept
    column has one of these names, the new one gets an underscore."""
    keep = [doc_id] if keep is None else keep
    names = unused(keep, "bytes", "shard", "depth", "shard_bytes")
    mine = [f"k{i}" for i in range(len(keep))]
    base = docs.select(
        *[F.col(quoted(c)).alias(k) for c, k in zip(keep, mine)],
        place(F.col(quoted(doc_id))).alias("h"),
        F.coalesce(F.octet_length(F.col(quoted(text)).cast("string")), F.lit(0)).cast("long").alias("bytes"),
    )
    sizes = materialise(base.select("h", "bytes"), "shard-sizes")
    levels = directory(sizes, limit)
    release(sizes)
    out, rest = None, base
    for i, (top, cells) in enumerate(levels):
        at = rest.withColumn("cell", _prefix(F.col("h"), top))
        part = at.join(cells, "cell").drop("cell")
        out = part if out is None else out.unionByName(part)
        if i + 1 < len(levels):
            rest = at.join(cells, "cell", "left_anti").drop("cell")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))

    def named(rows: DataFrame, page, size) -> DataFrame:
        label = F.concat(F.lit("s"), bits, F.when(page != 0, F.concat(F.lit("."), page.cast("string"))).otherwise(""))
        new = (F.col("bytes"), label, F.col("depth").cast("long"), size.cast("long"))
        return rows.select(*[F.col(k).alias(c) for k, c in zip(mine, keep)], *[x.alias(n) for x, n in zip(new, names)])

    # only buckets at the last bit can be over the limit
    if levels[-1][1].where(F.col("shard_bytes") > limit).isEmpty():
        return named(out, F.lit(0), F.col("shard_bytes"))
    over = materialise(out.where(F.col("shard_bytes") > limit).withColumn("row", F.monotonically_increasing_id()), "shard-overflow")
    pages = paged(over.select("row", "depth", "prefix", "bytes"), limit).withColumnRenamed("row", "r")
    split = named(over.join(pages, F.col("row") == F.col("r")), F.col("page"), F.col("page_bytes"))
    return named(out.where(F.col("shard_bytes") <= limit), F.lit(0), F.col("shard_bytes")).unionByName(split)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT d.*, g.depth, h >> (60 - g.depth) AS prefix FROM d, (SELECT unnest(range(0, 25)) AS depth) g),
s AS (SELECT depth, prefix, sum(bytes) AS shard_bytes FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, p.h, p.bytes, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix)
      WHERE s.shard_bytes <= {SHARD_BYTES} GROUP BY ALL)
SELECT doc_id, bytes,
       's' || CASE WHEN f.depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(h >> (60 - f.depth)), f.depth) END AS shard,
       CAST(f.depth AS BIGINT) AS depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM f JOIN s ON s.depth = f.depth AND s.prefix = f.h >> (60 - f.depth)
"""
