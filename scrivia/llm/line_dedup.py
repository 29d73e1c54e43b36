"""Cross-site boilerplate lines by distinct-site spread.

A HyperLogLog sketch of the sites is kept for each line hash; sketches of tasks
merge by aggregation.  Lines estimated clearly above the threshold are boilerplate,
those near it (three standard errors and one site) get an exact distinct count.

Edge cases: a null text stays null and has no lines; blank and short lines are
never boilerplate; a null site counts as one site of its own; rows that repeat
each get a row; ids are of any type; extra columns are not read; an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import materialise, membership_filter, possible_members, quoted, table

MIN_SITES = 8
MIN_CHARS = 20
LG_K = 10


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    line = F.regexp_replace(F.trim("line"), r"\s+", " ")
    each = docs.where("text is not null").select("key", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return each.select("key", "site", "pos", line.alias("line")).where(F.length("line") >= min_chars).select(
        "key", "site", "pos", F.unhex(F.md5("line")).alias("h")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h) of the lines seen on at least ``min_sites`` sites."""
    error = 3 * 1.04 / (2 ** (lg_k / 2))
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    spread = materialise(spread.where(F.col("sites") >= low), "line-spread")
    near = spread.where(F.col("sites") <= high).select("h")
    exact = (
        lines.join(near, "h", "left_semi").select("h", "site").distinct()
        .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h")
    )
    return materialise(spread.where(F.col("sites") > high).select("h").unionAll(exact), "line-boilerplate")


def line_dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text", site: str = "source", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, text without boilerplate lines, n_lines, n_removed."""
    docs = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        F.coalesce(F.col(quoted(site)).cast("string"), F.lit("\x00")).alias("site"),
        F.col(quoted(text)).cast("string").alias("text"),
    )
    docs = docs.withColumn("key", F.struct("doc_id", "site", F.xxhash64("text").alias("a"), F.crc32(F.coalesce("text", F.lit(""))).alias("b")))
    lines = materialise(_lines(docs, min_chars), "line-hashes")
    common = boilerplate(lines, min_sites)
    cut = lines.join(common, "h", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("cut"))
    cut = materialise(cut, "line-cuts")
    filt = membership_filter(cut, "key", "line-filter")

    whole = F.split("text", "\n", -1)
    n_lines = F.coalesce(F.size(whole).cast("long"), F.lit(0).cast("long"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    left = F.array_join(F.filter(whole, lambda x, i: ~F.array_contains("cut", i)), "\n")
    touched = possible_members(docs, F.col("key"), filt).join(cut, "key", "left")
    touched = touched.select(
        "doc_id",
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(left).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.size("cut")).cast("long").alias("n_removed"),
    )
    others = possible_members(docs, F.col("key"), filt, rest=True).select(
        "doc_id", "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")
    )
    return touched.unionByName(others)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, chr(1)) AS site, text FROM documents),
l AS (SELECT k, site, u.pos, u.line FROM d, (SELECT unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
m AS (SELECT k, site, pos, line, md5(regexp_replace(trim(line), '\s+', ' ', 'g')) AS h,
        length(regexp_replace(trim(line), '\s+', ' ', 'g')) >= {MIN_CHARS} AS long FROM l),
b AS (SELECT h FROM m WHERE long GROUP BY h HAVING count(DISTINCT site) >= {MIN_SITES}),
c AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE long AND h IN (SELECT h FROM b)) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (long AND h IN (SELECT h FROM b))), '') AS text
      FROM m GROUP BY k)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE c.text END) AS BIGINT) AS n_chars,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(c.text) END AS text_sha256
FROM d LEFT JOIN c USING (k)
"""
