"""Exact vector search for many queries: blocks around pivots, pruned by angle.

**Index.**  Unit vectors go to the nearest of at most ``PIVOTS`` pivots (a few k-means steps over
a bounded sample, which decides only how well blocks are pruned) and are cut, by angle to the
pivot, into blocks of ``BLOCK_ROWS``.  A block knows its members' least and greatest angle.

**Search.**  Angles on the sphere obey the triangle inequality: a member of a block is at least
``max(a - greatest, least - a)`` away from a query at angle ``a`` to the pivot.  Each query first
sees its own pivot's innermost block, which gives it a k-th best score; then every block that
this score does not rule out is multiplied with the queries that it may serve, one matrix product
a block of queries and a block of vectors.  A task keeps ``k`` rows a query and hands them
on; merging those is a ranking within each query.  Nothing is sorted as a whole.

With ``cap``, at most so many rows of one ``group`` are among a query's ``k``.  That holds part by
part: whatever is in the whole's answer is in the answer of each part that holds it.

Ids are unique; vectors without a group are one group.  Vectors null, empty, zero or with null or non-finite entries are not indexed and not asked;
vectors of another length than the pivots' (the commonest one) are not indexed, and not asked either.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from scrivia.storage import materialise, release

#: Pivots at most, rows of the sample a pivot, k-means steps.
PIVOTS, SAMPLE, STEPS = 128, 32, 5
#: Vectors of a block and queries of a block at most; rows that a task holds before it hands them on.
BLOCK_ROWS, QUERY_ROWS, HEAP_ROWS = 4096, 512, 1 << 20
#: Angles carry rounding; a block is ruled out only beyond this.
SLACK = 1e-7


class VectorIndex(NamedTuple):
    pivots: np.ndarray  # (pivots, dim)
    blocks: DataFrame  # (block, part, pivot, inner, low, high, ids, groups, data)


def sound_vectors(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """The ``rows`` whose ``vec`` (array of double) has a direction, with ``norm`` and ``vec`` as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.names.index(vec))
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths[lengths > 0]):
                part = b.take(pa.array(np.flatnonzero(lengths == length)))
                m = _matrix(part.column(b.schema.names.index(vec)))  # null entries are NaN
                most = np.abs(m).max(axis=1)
                ok = np.flatnonzero(np.isfinite(most) & (most > 0))
                # by the largest entry, so that squares neither overflow nor vanish
                norm = most[ok] * np.sqrt(np.square(m[ok] / most[ok, None]).sum(axis=1))
                part = part.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(norm, pa.float64())], [*b.schema.names, "norm"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("norm", DoubleType())]))


def unit(rows: DataFrame) -> DataFrame:
    """``rows`` with ``vec`` at length one, without those that have no direction."""
    sound = sound_vectors(rows.withColumn("vec", F.col("vec").cast("array<double>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, norm = b.column(b.schema.names.index("vec")), b.column(b.schema.names.index("norm")).to_numpy()
            flat = vec.flatten().to_numpy() / np.repeat(norm, vec.value_lengths().to_numpy())
            ends = np.concatenate([[0], np.cumsum(vec.value_lengths().to_numpy())])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([lists if name == "vec" else c for name, c in zip(b.schema.names, b.columns)], b.schema.names).drop_columns(["norm"])

    fields = [f for f in sound.schema.fields if f.name != "norm"]
    return sound.mapInArrow(run, StructType(fields))


def fit_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit centres of the sample by spherical k-means, each of the first ones farthest from those before: a cluster without one widens another's blocks."""
    first, near = [0], sample @ sample[0]
    while len(first) < min(pivots, len(sample)):
        first.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[first[-1]])
    centres = sample[first]
    for _ in range(STEPS):
        of = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds pivot and angle: of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angles = _angles(_matrix(b.column("vec")), pivots)
                near = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near])], [*b.schema.names, "pivot", "angle"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("pivot", IntegerType()), StructField("angle", DoubleType())]))


def build(vectors: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Index ``vectors`` (id, embedding and, where wanted, group and part: blocks hold one part)."""
    extra = [c if c in vectors.columns else F.lit(None).cast("string").alias(c) for c in ("group", "part")]
    whole = materialise(unit(vectors.select("id", *extra, F.col("embedding").alias("vec"))), "vectors-unit")
    lengths = whole.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    rows = whole.where(F.size("vec") == dim)
    # a bounded sample, in the order of a hash
    sample = rows.select("vec").orderBy(F.xxhash64("vec")).limit(pivots * SAMPLE).collect()
    centres = fit_pivots(np.array([r["vec"] for r in sample], dtype=np.float64).reshape(len(sample), -1), pivots) if sample else np.zeros((0, 0))
    placed = materialise(_placed(rows, centres), "vectors-placed") if sample else rows.selectExpr("*", "0 AS pivot", "0D AS angle").limit(0)
    ranged = placed.repartitionByRange(max(1, placed.count() // (4 * block_rows) + 1), "part", "pivot", "angle", "id").sortWithinPartitions("part", "pivot", "angle", "id")
    # rows of a pivot that share a task are cut as they come; the first cut of a pivot is its innermost there
    numbered = ranged.withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    w = Window.partitionBy("task", "part", "pivot").orderBy("row")
    cut = numbered.withColumn("cut", ((F.row_number().over(w) - 1) / block_rows).cast("long"))
    key = ("task", "part", "pivot", "cut")
    grouped = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("angle", "id", "group", "vec"))).alias("x"))
    blocks = grouped.select(
        F.xxhash64(*key).alias("block"), "part", "pivot", F.col("x")[0]["angle"].alias("low"), F.element_at("x", -1)["angle"].alias("high"),
        F.col("x.id").alias("ids"), F.col("x.group").alias("groups"), F.flatten("x.vec").alias("data"),
    )
    first = F.row_number().over(Window.partitionBy("part", "pivot").orderBy("low", "block")) == 1
    out = materialise(blocks, "vectors-cut")
    inner = out.select("block", "part", "pivot", "low").withColumn("inner", first).where("inner").select(F.col("block").alias("b"))
    release(whole, placed if sample else None)
    final = out.join(F.broadcast(inner), F.col("block") == F.col("b"), "left").withColumn("inner", F.col("b").isNotNull()).drop("b")  # a row a pivot and part
    return VectorIndex(centres, materialise(final, "vectors-blocks"))


def saved(index: VectorIndex, spark) -> tuple[DataFrame, DataFrame]:
    """(pivots, blocks) as tables."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(index.pivots)]
    return spark.createDataFrame(rows, "pivot int, vec array<double>"), index.blocks


def opened(pivots: DataFrame, blocks: DataFrame) -> VectorIndex:
    """The index that ``saved`` gave as tables."""
    rows = [r["vec"] for r in pivots.orderBy("pivot").collect()]  # PIVOTS at most
    return VectorIndex(np.array(rows, dtype=np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0)), blocks)


class _Best:
    """The best ``k`` rows of each query, at most ``cap`` of a group."""

    def __init__(self, k: int, cap: int | None):
        self.k, self.cap, self.held, self.rows = k, cap, {}, 0

    def floor(self, q, known: float) -> float:
        held = self.held.get(q)
        return known if held is None or len(held[0]) < self.k else max(known, held[0][-1])

    def add(self, q, scores: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> None:
        held = self.held.get(q)
        if held is not None:
            scores, ids, groups = (np.concatenate([a, b]) for a, b in zip(held, (scores, ids, groups)))
            self.rows -= len(held[0])
        order = np.lexsort((ids, -scores))
        if self.cap is None:
            order = order[: self.k]
        else:
            seen, kept = {}, []
            for i in order:
                if seen.setdefault(groups[i], 0) < self.cap:
                    seen[groups[i]] += 1
                    kept.append(i)
                    if len(kept) == self.k:
                        break
            order = np.array(kept, dtype=int)
        self.held[q] = scores[order], ids[order], groups[order]
        self.rows += len(order)

    def handed_on(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(q, i, g, s) for q, (scores, ids, groups) in self.held.items() for s, i, g in zip(scores.tolist(), ids.tolist(), groups.tolist())]
        self.held, self.rows = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _served(angle: np.ndarray, known: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which queries, at ``angle`` to the pivot, may find a score above ``known`` in the block."""
    reach = np.arccos(np.clip(known, -1.0, 1.0))
    return np.maximum(angle - high, low - angle) <= reach + SLACK


def _multiplied(index: VectorIndex, k: int, cap: int | None, ids: pa.DataType, groups: pa.DataType):
    pivots, schema = index.pivots, pa.schema([("q", pa.int64()), ("id", ids), ("group", groups), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, cap)
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i] for name in b.schema.names}
                qs, known = (r[c].values.to_numpy(zero_copy_only=False) for c in ("qs", "known"))
                queries = r["vecs"].values.to_numpy(zero_copy_only=False).reshape(len(qs), -1)
                pivot = pivots[r["pivot"].as_py()][None, :]
                use = np.flatnonzero(_served(_angles(queries, pivot)[:, 0], known, r["low"].as_py(), r["high"].as_py()))
                if not len(use):
                    continue
                members, of = np.array(r["ids"].as_py()), np.array(["" if g is None else g for g in r["groups"].as_py()])
                data = r["data"].values.to_numpy(zero_copy_only=False).reshape(len(members), -1)
                scores = queries[use] @ data.T
                for row, at in enumerate(use):
                    hit = np.flatnonzero(scores[row] >= best.floor(qs[at], known[at]) - SLACK)
                    if len(hit):
                        best.add(qs[at], scores[row, hit], members[hit], of[hit])
                if best.rows > HEAP_ROWS:
                    yield best.handed_on(schema)
        if best.rows:
            yield best.handed_on(schema)

    return run


def _tiles(blocks: DataFrame, meta: DataFrame, index: VectorIndex, own: bool) -> DataFrame:
    """(qblock, block): what is to be multiplied; ``own``: the innermost blocks of the queries' own pivots, else all others not ruled out."""
    pivots = index.pivots
    # four numbers a block of vectors
    m = meta.toPandas()
    at, low, high, inner, block = (m[c].to_numpy() for c in ("pivot", "low", "high", "inner", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qs, known, mine = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("qs", "known", "pivots"))
                if own:
                    take = inner & np.isin(at, mine)
                else:
                    angle = _angles(b.column("vecs")[i].values.to_numpy(zero_copy_only=False).reshape(len(qs), -1), pivots)
                    take = np.array([_served(angle[:, p], known, lo, hi)[~(n & (mine == p))].any() for p, lo, hi, n in zip(at, low, high, inner)], dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(take.sum(), b.column("qblock")[i].as_py()), pa.int64()), pa.array(block[take], pa.int64())], ["qblock", "block"])

    return blocks.select("qblock", "qs", "known", "pivots", "vecs").mapInArrow(run, "qblock long, block long")


def _packed(queries: DataFrame, query_rows: int) -> DataFrame:
    """Blocks of queries, those of one pivot side by side."""
    w = F.expr(f"row div {query_rows}")
    rows = queries.repartitionByRange("pivot", "q").sortWithinPartitions("pivot", "q").withColumn("row", F.monotonically_increasing_id())
    x = rows.groupBy(w.alias("qblock")).agg(F.collect_list(F.struct("q", "known", "pivot", "vec")).alias("x"))
    return x.select("qblock", F.col("x.q").alias("qs"), F.col("x.known").alias("known"), F.col("x.pivot").alias("pivots"), F.flatten("x.vec").alias("vecs"))


def ranked(hits: DataFrame, k: int, cap: int | None) -> DataFrame:
    """``hits`` (q, id, group, score) with ``rank``: the best ``k`` of each query, at most ``cap`` of a group."""
    order = [F.desc("score"), F.asc("id")]
    if cap is not None:
        hits = hits.withColumn("of", F.row_number().over(Window.partitionBy("q", "group").orderBy(*order))).where(F.col("of") <= cap).drop("of")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, cap: int | None = None, part: str | None = None, counted: dict | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q, rank, id, group, score) of the ``k`` vectors nearest to each of ``queries`` (q: long, embedding), best first, ties by id.

    ``part``: only blocks of this part.  ``counted``: is told how many pairs of blocks there are and how many were multiplied.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    blocks = index.blocks if part is None else index.blocks.where(F.col("part") == part)
    kinds = {f.name: f.dataType.elementType for f in blocks.schema if f.name in ("ids", "groups")}
    ddl = f"q long, id {kinds['ids'].simpleString()}, `group` {kinds['groups'].simpleString()}, score double"
    if not len(index.pivots):
        return ranked(spark.createDataFrame([], ddl), k, cap)
    asked = unit(queries.select("q", F.col("embedding").alias("vec"))).where(F.size("vec") == index.pivots.shape[1])
    asked = materialise(_placed(asked, index.pivots), "vectors-asked")
    meta = blocks.select("block", "pivot", "low", "high", "inner")
    run = _multiplied(index, k, cap, to_arrow_type(kinds["ids"]), to_arrow_type(kinds["groups"]))
    hits, multiplied, waves = None, 0, []
    for own in (True, False):
        known = asked.withColumn("known", F.lit(-2.0))
        if hits is not None:
            # a score that only ties the k-th best may still come before it by its id
            kth = ranked(hits, k, cap).where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
            known = asked.join(kth, "q", "left").withColumn("known", F.coalesce("kth", F.lit(-2.0)))
        qblocks = materialise(_packed(known, query_rows), "vectors-queries")
        tiles = materialise(_tiles(qblocks, meta, index, own), "vectors-tiles", batch=16)
        if counted is not None:
            multiplied += tiles.count()
            counted.update(pairs=qblocks.count() * blocks.count(), multiplied=multiplied)
        pairs = tiles.join(qblocks.select("qblock", "qs", "known", "vecs").hint("merge"), "qblock").join(blocks.hint("merge"), "block")
        found = materialise(pairs.select("qs", "known", "vecs", "pivot", "low", "high", "ids", "groups", "data").mapInArrow(run, ddl), "vectors-hits", batch=1)
        hits = found if hits is None else hits.unionByName(found).dropDuplicates(["q", "id"])
        waves += [qblocks, tiles]
    release(asked, *waves)
    return ranked(hits, k, cap).select("q", "rank", "id", "group", "score")
