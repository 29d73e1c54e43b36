"""Shared pieces: scratch tables, fixed-size membership filters, running sums, components."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.storage import arrow_batches, delete, materialise, new_path, release  # noqa: F401

#: The six ASCII blanks, as a Java character class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, lengthened until they clash with no column."""
    taken = {c.lower() for c in columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


# --- fixed-size membership filter -------------------------------------------

#: A filter has 32 bits a key within these bounds: 512 KiB to 16 MiB, whatever the input.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 27
_WORDS_PER_ROW = 512


class Filter(NamedTuple):
    """Rows (__slot, __words): 512 longs each."""

    rows: DataFrame
    bits: int


def membership_filter(keys: DataFrame, key: str, label: str) -> Filter:
    """A written bitmap over ``xxhash64(key)``; ``keys`` should be a written table.

    Its size follows the number of keys up to ``MOST_BITS``; beyond, only the share of
    false positives grows.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * max(1, keys.count()) - 1).bit_length()))
    pos = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    word, bit = (F.col("p") / 64).cast("long"), F.expr("shiftleft(1L, cast(p % 64 as int))")
    set_bits = keys.select(pos.alias("p")).select(word.alias("w"), bit.alias("v"))
    # every word once without a bit, so that rows are whole and in order
    words = set_bits.unionAll(keys.sparkSession.range(bits // 64).select("id", F.lit(0).cast("long"))).groupBy("w").agg(F.bit_or("v").alias("v"))
    rows = words.groupBy((F.col("w") / _WORDS_PER_ROW).cast("long").alias("__slot")).agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("x"))
    rows = rows.select("__slot", F.transform("x", lambda x: x["v"]).alias("__words"))
    return Filter(materialise(rows, label, parts=1 + bits // (64 * _WORDS_PER_ROW) // 512), bits)


def possible_members(df: DataFrame, key: Column, filt: Filter, rest: bool = False) -> DataFrame:
    """Rows whose key may be in the filter (``rest``: those whose key is not)."""
    cols = df.columns
    at, slot, words = unused(cols, "__p", "__slot", "__words")
    probed = df.withColumn(at, F.pmod(F.xxhash64(key), F.lit(filt.bits))).withColumn(slot, (F.col(at) / (64 * _WORDS_PER_ROW)).cast("long"))
    bitmap = filt.rows.select(F.col("__slot").alias(slot), F.col("__words").alias(words))
    hit = F.expr(f"(shiftright({words}[cast({at} / 64 as int) % {_WORDS_PER_ROW}], cast({at} % 64 as int)) & 1L) = 1L")
    # at most MOST_BITS
    joined = probed.join(F.broadcast(bitmap), slot, "left" if rest else "inner")
    return joined.where(~F.coalesce(hit, F.lit(False)) if rest else hit).select(*[F.col(quoted(c)) for c in cols])


def quoted(name: str) -> str:
    """The column of exactly this name, dots and all."""
    return "`" + name.replace("`", "``") + "`"


# --- running sums -----------------------------------------------------------

#: Rows a range of an order holds on average; ranges follow the input.
RANGE_ROWS = 65536


def running(df: DataFrame, groups: list[str], order: list, value: str, out: str, label: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the group's earlier rows by ``order``.

    ``df`` is a written table, its columns not named range_ or before_.
    """
    ranges = max(1, df.count() // RANGE_ROWS)
    ranged = materialise(df.repartitionByRange(ranges, *groups, *order).withColumn("range_", F.spark_partition_id()), label)
    sums = ranged.groupBy(*groups, "range_").agg(F.sum(value).alias("v"))
    before = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"g{i}_" for i in range(len(groups))]
    sums = sums.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("range_").alias("r_"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("before_"))
    sums = materialise(sums, label, parts=ranges)
    inside = Window.partitionBy(*groups, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("range_") == F.col("r_")
    for g, n in zip(groups, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    summed = ranged.withColumn("in_", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, same)
    done = materialise(summed.select(*df.columns, (F.col("before_") + F.col("in_")).alias(out)), label, parts=ranges)
    release(ranged, sums)
    return done


# --- connected components ---------------------------------------------------


#: Edges a task holds on average.
PART_EDGES = 50_000


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node.

    Alternating large-star and small-star rounds; each round's edges are a table
    in the shared folder, and only counts reach the driver.  A hub's rows are
    pre-aggregated for its minimum and joined back from a written table, so the
    adaptive skew join can split them.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        label,
    )

    def named() -> DataFrame:
        out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        out.scratch_path = now.scratch_path
        return out

    n = now.count()
    if not n:
        return named()
    parts = 1 + n // PART_EDGES  # no table here has many more rows than there are edges
    while True:
        was = now
        # large star: neighbours above a node hang on to the node's minimum
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), label, parts=parts)
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, label, parts=parts)
        # small star: neighbours below a node hang on to their minimum
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label, parts=parts)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, "u").select(F.inline(ends)).where("u <> v").distinct()
        now = materialise(small, label, parts=parts)
        release(was, lows, large, low)
        # done when all are stars: no node hangs on to two, nor on to one that hangs on to another
        sides = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        ups = sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ups.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return named()
