"""Exact dedup as a log-structured merge index over text digests (DataFrames only).

``DigestIndex.append`` logs an entry (digest, length, id) for every row and deals them to
memtables of bounded size.  A memtable is *flushed* by merging its equal digests and
writing them as a run, sorted by digest, with a filter (a bitmap of its digests).
*Compaction* merges runs two by two, level by level: before a run is read for merging its
rows are asked of the other run's filter, and only those that may be in both are shuffled
and merged, the preferred row (longest original, then smallest id) winning; the others are
copied.  Digests with more than one row are *hits*.  Hits are verified on their bytes: the
normalised texts themselves are the grouping key, so rows fall in one class only if every
byte agrees.  Should one digest cover two texts, its rows are classed by text instead.

Edge cases: a null text counts as empty and all empty texts are one group; of rows
that repeat a doc_id in one group one is kept, as all count; a null doc_id loses every
tie; ids are of any type; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import BLANK, Filter, materialise, membership_filter, possible_members, quoted, release, table

#: Rows a memtable holds at most, and the least number of memtables.
MEMTABLE_ROWS, MEMTABLES = 1 << 28, 4


def normalised(col: Column):
    return F.regexp_replace(F.coalesce(col, F.lit("")), f"[{BLANK}]+", "")


def _preferred():
    """Least value = longest original, then smallest doc_id, nulls last, then the row logged first."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "row")


class Run(NamedTuple):
    """Rows (digest, count, best), sorted by digest, and the bitmap of their digests."""

    rows: DataFrame
    filter: Filter


class DigestIndex:
    """An LSM index of digests in the shared folder."""

    def __init__(self, memtables: int = MEMTABLES, memtable_rows: int = MEMTABLE_ROWS):
        self.memtables, self.memtable_rows = memtables, memtable_rows
        self.log: DataFrame | None = None
        self.levels: list[list[Run]] = [[]]

    def append(self, docs: DataFrame) -> None:
        """Log the rows of ``docs`` (doc_id, text) and flush their memtables."""
        memtables = max(self.memtables, -(-docs.count() // self.memtable_rows))
        row = F.monotonically_increasing_id()
        entries = docs.select(
            F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
            F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n"),
            "doc_id", row.alias("row"), F.xxhash64("text").alias("raw"), F.pmod(row, F.lit(memtables)).alias("memtable"),
        )
        self.log = materialise(entries, "lsm-log")
        for m in range(memtables):
            mine = self.log.where(F.col("memtable") == m)
            self._put(mine.groupBy("digest").agg(F.count("*").alias("count"), F.min(_preferred()).alias("best")), 0)

    def _put(self, rows: DataFrame, level: int) -> None:
        rows = materialise(rows.sortWithinPartitions("digest"), f"lsm-level{level}")
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(Run(rows, membership_filter(rows, "digest", f"lsm-filter{level}")))

    def compact(self) -> DataFrame:
        """Merge until one run is left; returns its rows."""
        level = 0
        while sum(map(len, self.levels)) > 1:
            while len(self.levels[level]) > 1:
                a, b = self.levels[level].pop(0), self.levels[level].pop(0)
                self._put(merged(a, b), level + 1)
                release(a.rows, b.rows, a.filter.rows, b.filter.rows)
            if self.levels[level] and level + 1 < len(self.levels):  # an odd one moves up
                self.levels[level + 1].append(self.levels[level].pop())
            level += 1
        return self.levels[-1][0].rows


def merged(a: Run, b: Run) -> DataFrame:
    """Both runs in one; what the other's filter rules out is copied."""
    both = possible_members(a.rows, F.col("digest"), b.filter).unionAll(possible_members(b.rows, F.col("digest"), a.filter))
    both = both.groupBy("digest").agg(F.sum("count").alias("count"), F.min("best").alias("best"))
    return both.unionAll(possible_members(a.rows, F.col("digest"), b.filter, rest=True)).unionAll(possible_members(b.rows, F.col("digest"), a.filter, rest=True))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    index = DigestIndex()
    index.append(docs)
    hits = index.compact().where(F.col("count") > 1).select("digest", F.col("count").alias("group_size"), "best")
    hits = materialise(hits, "lsm-hits")
    filt = membership_filter(hits, "digest", "lsm-hits-filter")
    asked = materialise(possible_members(index.log, F.col("digest"), filt).join(hits, "digest"), "lsm-hit-rows")

    # byte verification: only texts logged under a hit are normalised again, and leave their
    # task once for every distinct text
    raw = materialise(asked.select("raw").distinct(), "lsm-raw")
    known = membership_filter(raw, "raw", "lsm-raw-filter")
    suspects = possible_members(docs.withColumn("raw", F.xxhash64("text")), F.col("raw"), known)
    suspects = suspects.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), normalised(F.col("text")).alias("norm"))
    suspects = suspects.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    classes = materialise(suspects.groupBy("digest", "norm").agg(F.count("*").alias("size")).select("digest", "size"), "lsm-classes")
    torn = materialise(classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "lsm-torn")

    if not torn.isEmpty():  # one digest for several texts: those rows are classed by their bytes
        split = materialise(suspects.join(torn, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "lsm-split")
        best = split.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.min(_preferred()).alias("best"))
        exact = split.join(best, ["digest", "norm"]).select("digest", "doc_id", "row", "group_size", "best")
        asked = asked.join(torn, "digest", "left_anti").select(*exact.columns).unionByName(exact)
    same = F.col("best.row") == F.col("row")
    grouped = asked.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "digest")
    # false positives of the filter are no hits
    lone = possible_members(index.log, F.col("digest"), filt).join(hits, "digest", "left_anti").unionByName(possible_members(index.log, F.col("digest"), filt, rest=True))
    lone = lone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return lone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS place,
             first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
             CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size
      FROM d)
"""
