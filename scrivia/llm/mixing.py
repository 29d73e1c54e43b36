"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served again from the
start once it is through.  A document's virtual finish time is the source's
cumulative words at its end divided by the source's target, so in the order of finish
times over all sources the next is always of the source furthest behind its share.
That order is range-sorted once for all sources and cut at the total budget; nothing
is cut by source before.  The one document of each source that is in service when
all queues together have had the budget is queued word by word instead of whole, so
sources end within a word or so of their targets.

Running sums take two levels: rows are ranged over the order, ties included, then
summed within ranges, with the sums of earlier ranges added.  No task holds a whole
source, all rows of one id, or all sources.

Edge cases: a null or blank text has size 0, is served no words and keeps taken 0;
the null source is one more source, last in order; rows that repeat a doc_id or
have none are separate documents; no words at all give targets of 0; ids are of any
type; extra columns are not read (``mix``) or kept whatever their names (``mixed``); an
empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import BLANK, materialise, quoted, release, running, table, unused

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_PASSES = 2


def words_in(col):
    return F.coalesce(F.regexp_count(col, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, capped at ``passes`` x size.

    The level rises as sources reach their cap and the others share what is left,
    until no more do.
    """
    per = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one")), "mix-sources")
    ranked = running(per, [], [F.col("source").isNull(), F.col("source")], "one", "rank", "mix-ranks")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per_w = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(passes))
    budget = float(per_w.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * float(percent) / 100.0
    level = 0.0
    while True:
        full = F.col("cap") / F.col("w") <= level
        held, open_w = per_w.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        rest = (budget - (held or 0.0)) / open_w if open_w else level
        if rest <= level:
            break
        level = rest
    out = materialise(per_w.select("source", "source_size", F.round(F.least(F.col("cap"), F.col("w") * F.lit(level)), 6).alias("target")), "mix-targets")
    release(per, ranked)
    return out


def queues(docs: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, passes: int = MOST_PASSES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents (doc_id, source, text, ``keep``) in their queues: row, h, size, queue (words before it), source_size, target."""
    sizes = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), *keep,
        ),
        "mix-sizes",
    )
    share = targets(sizes, weights, percent, passes)
    queued = running(sizes, ["source"], [F.col("h"), F.col("size"), F.col("row")], "size", "queue", "mix-queues")
    facts = share.select(F.col("source").alias("s2"), "source_size", "target")
    out = materialise(queued.join(facts, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-queued")
    release(sizes, queued, share)
    return out


def line(queued: DataFrame, passes: int = MOST_PASSES) -> tuple[DataFrame, int]:
    """(row, h, source, start, words, finish) of all passes over all queues, unordered and uncut, and the budget."""
    whole = F.floor(F.col("target") + 1e-6).cast("long")
    per = queued.groupBy("source").agg(F.first("target").alias("target"))
    total, budget = per.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(whole), F.lit(0))).first()
    # virtual time at which all queues together have had the budget
    at = F.lit(float(budget) / total if total else 0.0) * F.col("target")
    served = queued.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    served = served.withColumn("start", F.col("queue") + F.col("pass") * F.col("source_size"))
    in_service = (F.col("start") < at) & (F.col("start") + F.col("size") > at)
    step = F.when(in_service, F.lit(1)).otherwise(F.col("size")).cast("long")
    served = served.withColumn("step", step).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("step"))).alias("from"))
    words = F.least(F.col("step"), F.col("size") - F.col("from"))
    served = served.select("row", "h", "source", "target", (F.col("start") + F.col("from")).alias("start"), words.alias("words"))
    return served.withColumn("finish", (F.col("start") + F.col("words")) / F.col("target")).drop("target"), int(budget)


def cut(served: DataFrame, budget: int) -> DataFrame:
    """The rows of ``line`` that the budget reaches in order of finish time; the last may be taken in part."""
    served = materialise(served, "mix-line")
    order = [F.col(c) for c in ("finish", "h", "source", "row", "start")]
    # (finish, h, source, row, start) differ for any two rows, so ranges split ties too
    summed = running(served, [], order, "words", "served", "mix-served")
    release(served)
    out = summed.where(F.col("served") < budget).withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("served")))
    out.scratch_path = summed.scratch_path
    return out


def mix(
    docs: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, passes: int = MOST_PASSES,
    text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, finish and ``keep``."""
    own = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"), F.col(quoted(text)).alias("text"), *keep)
    queued = queues(own, weights, percent, passes, keep)
    taken = cut(*line(queued, passes))
    per = materialise(taken.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"), F.max("finish").alias("finish")), "mix-taken")
    release(taken)
    out = queued.join(per, F.col("row") == F.col("r"), "left")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish", *keep
    )


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix serves it, to the nearest whole time.

    Rows without words stay once; rows equal in id, source and text share alike.
    """
    cols = [F.col(quoted(c)) for c in docs.columns]
    t, d, s, h, n = unused(docs.columns, "t", "d", "s", "h", "n")
    of, own, sub = (F.col(quoted(c)) for c in (text, doc_id, source))
    plain = docs.select(own.alias("doc_id"), sub.alias("source"), of.alias("text"), F.xxhash64(of).alias("text_hash"))
    served = mix(plain, keep=("text_hash",), **options)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")))
    per = served.withColumn("times", times).groupBy("doc_id", "source", "text_hash").agg(F.sum("times").alias("c"), F.count("*").alias("r"))
    per = per.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("text_hash").alias(h), F.round(F.col("c") / F.col("r")).cast("int").alias(n))
    per = materialise(per.where(F.col(n) > 0), "mix-times")
    same = (F.col(t) == F.col(h)) & own.eqNullSafe(F.col(d)) & sub.cast("string").eqNullSafe(F.col(s))
    joined = docs.withColumn(t, F.xxhash64(of)).join(per, same)
    return joined.select(*cols, F.explode(F.sequence(F.lit(1), F.col(n))).alias(t)).select(*cols)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM r),
x AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * 150.0::DOUBLE / 100.0::DOUBLE AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_cap,
        sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
y AS (SELECT *, (budget - full_cap) / open_w AS level FROM x),
z AS (SELECT *, max(level) OVER () AS lev FROM y),
t AS (SELECT source, source_size, round(least(cap, w * lev), 6) AS target FROM z),
b AS (SELECT CAST(sum(floor(target + 1e-6)) AS BIGINT) AS budget, CAST(sum(floor(target + 1e-6)) AS DOUBLE) / sum(target) AS v FROM t),
q AS (SELECT d.*, t.source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queue
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT q.*, queue + pass * source_size AS start,
        CASE WHEN queue + pass * source_size < v * target AND queue + pass * source_size + size > v * target THEN 1 ELSE size END AS step
      FROM q, b, (VALUES (0), (1)) p(pass) WHERE size > 0 AND target > 0),
l AS (SELECT doc_id, h, source, target, CAST(start + off AS BIGINT) AS start, least(step, size - off) AS words
      FROM (SELECT *, unnest(range(0, size, CAST(step AS BIGINT))) AS off FROM k)),
f AS (SELECT *, sum(words) OVER (ORDER BY (start + words) / target, h, source, start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS served FROM l),
g AS (SELECT doc_id, CAST(sum(least(words, budget - served)) AS BIGINT) AS taken FROM f, b WHERE served < budget GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN g ON q.doc_id IS NOT DISTINCT FROM g.doc_id
"""
