"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Nearness is the inner product.  Vectors of one segment are divided by the segment's
greatest norm M and lifted by the coordinate sqrt(1 - |v|^2/M^2); a query is divided by
its own norm.  Both are then of length one, and their distance falls as the inner product
rises: d^2 = 2 - 2 * score / (|q| M).  Segments hold one band of norms (a quarter of a
power of two), so that M is near every norm in them.

**Index.**  Every vector's lifted form is projected on ``PROJECTIONS`` random directions, and
each direction keeps one array of its segment's projections, sorted, with the vectors'
places.  Nothing is fitted.  Equal vectors are one node with its least ids.

**Search.**  Around a query's projection each array opens a window of half-width
``WINDOW * R``.  Virtual rehashing widens R.  Where windows expose few new entries these are
listed and counted; where they expose many, every vector's rank in the array is held against
the window's two ends, which counts the same.  A
vector collides in a window with a known probability if it is within R of the query, so
``THRESHOLD`` of the windows hold it with probability ``REACH`` or more, and vectors counted
that often are verified by their inner product.  The search of a segment ends when R
passes the distance of the k-th best that is known for the query: whatever is nearer was
verified with that probability, so this is the expected recall, or more, on any data.
R starts at that distance where k are known from segments before, and
grows up to the whole segment where fewer than k are known.  No cap on candidates.

Segments are searched in waves of 1, 3, 12, ... (greatest norms first), each wave starting
from the k-th best scores of those before; a segment whose greatest possible score is
below a block's k-th bests is not read.  Queries travel in blocks.

Edge cases: vectors null, empty, zero or with null or non-finite entries take no part, as
queries or candidates; vectors of other lengths are searched apart, among their own; a null
vec_id is no query and comes last in ties; ids are whole numbers; a query's own row is
left out, rows that repeat its id or vector are not; fewer candidates than k give all;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import materialise, quoted, release, table
from scrivia.operators.vectors import sound_vectors

PROJECTIONS, WINDOW, REACH, SEED = 96, 1.36, 0.97, 7
#: Rows a segment holds on average (ranks are 16 bits wide) and a block of queries at most; segments a wave has for each one before it.
SEGMENT_ROWS, QUERY_ROWS, WAVE = 8192, 1024, 3
#: Blocks of queries that a task searches a segment for, on average.
BLOCKS_A_TASK = 8
#: Windows that newly expose less than this share of the arrays are listed entry by entry; others compare ranks.
LISTED = 1 / 32
#: The first R, and how much wider each next one is.
FIRST, WIDER = 0.25, 2.0
_LAST_ID = (1 << 63) - 1


def collision_threshold(projections: int = PROJECTIONS, window: float = WINDOW, reach: float = REACH) -> int:
    """The most collisions that a vector at distance R has with probability ``reach`` or more."""
    from math import comb, erf, sqrt

    p, below = erf(window / sqrt(2)), 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - reach:
            return count
    return projections


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Gaussian directions of the lifted space, in columns; the same everywhere."""
    return np.random.default_rng((SEED, dim)).standard_normal((dim + 1, projections))


# --- index ------------------------------------------------------------------


class Index(NamedTuple):
    nodes: DataFrame  # (node, ids: the least k + 1 (z, vec_id, row), least first)
    segments: DataFrame  # (segment, dim, at, top, data: binary)
    shape: list  # (dim, segments of it)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, vec: array of double, norm) of the vectors that take part; a written table."""
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(embedding)).cast("array<double>").alias("vec"))
    # -0.0 and 0.0 are one value
    rows = sound_vectors(rows.withColumn("vec", F.transform("vec", lambda c: c + F.lit(0.0))))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", "norm"), "ann-rows")


def _least(k: int) -> Column:
    # the k + 1 least rows of a vector: the most that one query can be given, itself included
    return F.row_number().over(Window.partitionBy("vec").orderBy("z", "vec_id", "row")) <= k + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' sorted arrays: (least ids, nodes, vectors, sorted projections, places, ranks) end to end."""
    for b in batches:
        for r in b.to_pylist():
            n, d = len(r["nodes"]), r["dim"]
            v = np.array(r["vecs"], dtype=np.float64).reshape(n, d)
            unit = v / r["top"]
            lifted = np.concatenate([unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))[:, None]], axis=1)
            projected = np.ascontiguousarray((lifted @ directions(d)).T, dtype=np.float32)
            places = np.argsort(projected, axis=1, kind="stable")
            ordered = np.take_along_axis(projected, places, axis=1)
            ranks = np.empty(places.shape, dtype=np.uint16)
            np.put_along_axis(ranks, places, np.arange(n, dtype=np.uint16)[None, :], axis=1)
            data = b"".join(a.tobytes() for a in (np.array(r["least"], dtype=np.int64), np.array(r["nodes"], dtype=np.int64), v, ordered, places.astype(np.uint16), ranks))
            one = {"segment": [r["segment"]], "dim": [d], "at": [r["at"]], "top": [r["top"]], "rows": [n], "data": [data]}
            yield pa.RecordBatch.from_pydict(one, schema=_SEGMENT)


_SEGMENT = pa.schema([("segment", pa.int64()), ("dim", pa.int32()), ("at", pa.int64()), ("top", pa.float64()), ("rows", pa.int32()), ("data", pa.binary())])


def build_index(rows: DataFrame, k: int, segment_rows: int = SEGMENT_ROWS) -> Index:
    """Index every row of ``usable`` rows for searches of up to ``k``."""
    if segment_rows > 1 << 15:
        raise ValueError("a segment holds 32,768 rows on average at most")
    first = rows.withColumn("z", F.col("vec_id").isNull()).withColumn("of", _least(k)).where("of")
    ids = F.array_sort(F.collect_list(F.struct("z", "vec_id", "row")))
    band = F.floor(F.log2("norm") * 4 + 0.5)
    folded = first.groupBy("vec").agg(ids.alias("ids"), F.max("norm").alias("norm"))
    nodes = materialise(folded.select(F.monotonically_increasing_id().alias("node"), "vec", "ids", "norm", F.size("vec").alias("dim"), band.alias("band")), "ann-nodes")
    # bands are quarters of a double's powers of two: some thousands at most for a length
    bands, shape = [], {}
    for r in nodes.groupBy("dim", "band").count().orderBy("dim", F.desc("band")).collect():
        parts = -(-r["count"] // segment_rows)
        bands.append((r["dim"], r["band"], shape.get(r["dim"], 0), parts))
        shape[r["dim"]] = shape.get(r["dim"], 0) + parts
    offset, offsets = 0, {}
    for d, parts in shape.items():
        offsets[d] = offset
        offset += parts
    plan = nodes.sparkSession.createDataFrame([(d, b, at, p, offsets[d] + at) for d, b, at, p in bands], "dim int, band long, first long, parts long, base long")
    dealt = nodes.join(F.broadcast(plan), ["dim", "band"]).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")))
    dealt = dealt.select("dim", (F.col("first") + F.col("part")).alias("at"), (F.col("base") + F.col("part")).alias("segment"), "node", "vec", "norm", F.coalesce(F.col("ids")[0]["vec_id"], F.lit(_LAST_ID)).alias("least"))
    grouped = dealt.groupBy("segment", "dim", "at").agg(F.collect_list(F.struct("node", "vec", "least")).alias("x"), F.max("norm").alias("top"))
    grouped = grouped.select("segment", "dim", "at", "top", F.col("x.node").alias("nodes"), F.col("x.least").alias("least"), F.flatten("x.vec").alias("vecs"))
    packed = grouped.mapInArrow(_packed, "segment long, dim int, at long, top double, rows int, data binary")
    segments = materialise(packed, "ann-segments", batch=1)
    return Index(nodes.select("node", "ids", "vec"), segments, sorted(shape.items()))


# --- search -----------------------------------------------------------------


class _Segment:
    def __init__(self, dim: int, top: float, rows: int, data: bytes):
        m, self.dim, self.top, self.rows = PROJECTIONS, dim, top, rows
        at = 0
        out = []
        for dtype, count in ((np.int64, rows), (np.int64, rows), (np.float64, rows * dim), (np.float32, m * rows), (np.uint16, m * rows), (np.uint16, m * rows)):
            out.append(np.frombuffer(data, dtype, count, at))
            at += np.dtype(dtype).itemsize * count
        self.least, self.nodes = out[0], out[1]
        self.vectors = out[2].reshape(rows, dim)
        self.sorted, self.places, self.ranks = (a.reshape(m, rows) for a in out[3:])
        self._off, self._in = np.empty((m, rows), dtype=np.uint16), np.empty((m, rows), dtype=bool)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each vector: the windows [low, high) of ranks that hold it."""
        # below the window the difference wraps round, beyond its width too
        np.subtract(self.ranks, low.astype(np.uint16)[:, None], out=self._off)
        np.less(self._off, (high - low).astype(np.uint16)[:, None], out=self._in)
        return np.add.reduce(self._in.view(np.uint8), axis=0, dtype=np.uint8)

    def distance(self, score, norm):
        """Distance of lifted vectors at a score."""
        return np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(score / (norm * self.top), -1, 1)))


def _windows(seg: _Segment, projected: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, projections) bounds of the windows of half-width WINDOW * radius."""
    low, high = np.empty(projected.shape, dtype=np.int64), np.empty(projected.shape, dtype=np.int64)
    for j in range(projected.shape[1]):
        low[:, j] = np.searchsorted(seg.sorted[j], projected[:, j] - WINDOW * radius, "left")
        high[:, j] = np.searchsorted(seg.sorted[j], projected[:, j] + WINDOW * radius, "right")
    return low, high


def search_segment(seg: _Segment, queries: np.ndarray, norms: np.ndarray, known: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores): up to ``k`` verified vectors of the segment that no ``known`` k-th score outdoes."""
    need, m = collision_threshold(), PROJECTIONS
    # lifted queries have a last coordinate of zero
    projected = (queries / norms[:, None]) @ directions(seg.dim)[:-1]
    active = np.flatnonzero(norms * seg.top * (1 + 1e-12) >= known)
    counts = np.zeros((len(queries), seg.rows), dtype=np.uint8)
    done = np.zeros((len(queries), seg.rows), dtype=bool)
    low, high = np.zeros((2, len(queries), m), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.intp), np.empty(0))] * len(queries)
    # the distance from which on nothing is wanted: of the k-th best known, here or before
    stop = np.where(np.isfinite(known), seg.distance(known, norms), np.inf)
    radius = np.where(np.isfinite(stop), stop, FIRST)
    while len(active):
        whole = radius[active] >= 2.0
        lo, hi = _windows(seg, projected[active], radius[active])
        lo[whole], hi[whole] = 0, seg.rows
        exposed = ((hi - lo) - (high[active] - low[active])).sum(axis=1)
        left = []
        for row, q in enumerate(active):
            if exposed[row] > LISTED * m * seg.rows:
                counts[q] = seg.collisions(lo[row], hi[row])
            else:
                for j in range(m):
                    if low[q, j] == high[q, j]:  # nothing exposed so far
                        counts[q, seg.places[j, lo[row, j] : hi[row, j]]] += 1
                    else:
                        counts[q, seg.places[j, lo[row, j] : low[q, j]]] += 1
                        counts[q, seg.places[j, high[q, j] : hi[row, j]]] += 1
            new = np.flatnonzero((counts[q] >= need) & ~done[q])
            if len(new):
                done[q, new] = True
                score = seg.vectors[new] @ queries[q]
                places, scores = np.concatenate([found[q][0], new]), np.concatenate([found[q][1], score])
                best = np.lexsort((seg.least[places], -scores))[:k]
                found[q] = places[best], scores[best]
                if len(best) == k:
                    stop[q] = min(stop[q], seg.distance(scores[best[-1]], norms[q]))
            if radius[q] < min(stop[q], 2.0):
                left.append(q)
        low[active], high[active] = lo, hi
        active = np.array(left, dtype=np.intp)
        radius[active] = np.minimum(radius[active] * WIDER, np.minimum(stop[active], 2.0))
    for q in range(len(queries)):
        places, scores = found[q]
        wanted = scores >= known[q]
        if wanted.any():
            yield q, places[wanted], scores[wanted]


_HIT = pa.schema([("q", pa.int64()), ("node", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i] for name in b.schema.names}
                seg = _Segment(r["dim"].as_py(), r["top"].as_py(), r["rows"].as_py(), r["data"].as_py())
                qs, norms, known = (r[c].values.to_numpy(zero_copy_only=False) for c in ("qs", "norms", "known"))
                queries = r["vecs"].values.to_numpy(zero_copy_only=False).reshape(-1, seg.dim)
                hits = [(np.full(len(p), qs[q]), seg.nodes[p], seg.least[p], s) for q, p, s in search_segment(seg, queries, norms, known, k)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*hits)], schema=_HIT)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "least", "node")
    return hits.withColumn("of", F.row_number().over(w)).where(F.col("of") <= k)


def nearest_nodes(index: Index, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q, node, least, score): the ``k`` best nodes found for each written query (q, vec, norm)."""
    best: DataFrame | None = None
    begin, width, most = 0, 1, max((n for _, n in index.shape), default=0)
    queries = queries.withColumn("dim", F.size("vec"))
    spark = queries.sparkSession
    while begin < most:
        rows = queries.withColumn("known", F.lit(float("-inf")))
        if best is not None:
            kth = best.where(F.col("of") == k).select("q", F.col("score").alias("kth"))
            rows = queries.join(kth, "q", "left").withColumn("known", F.coalesce("kth", F.lit(float("-inf"))))
        # queries alike in what they still want share a block
        blocks = rows.withColumn("block", F.expr(f"monotonically_increasing_id() div {query_rows}")).groupBy("block", "dim").agg(F.collect_list(F.struct("q", "norm", "known", "vec")).alias("x"))
        blocks = materialise(
            blocks.select("block", "dim", F.col("x.q").alias("qs"), F.col("x.norm").alias("norms"), F.col("x.known").alias("known"), F.flatten("x.vec").alias("vecs"),
                          F.array_max(F.transform("x", lambda e: e["norm"])).alias("long"), F.array_min("x.known").alias("least")), "ann-blocks",
        )
        wave = index.segments.where((F.col("at") >= begin) & (F.col("at") < begin + width))
        # a row for each block and segment that has anything to give it
        sides = wave.select("segment", "dim", "top")
        tiles = blocks.select("block", "dim", "long", "least").join(sides, "dim").where(F.col("long") * F.col("top") * 1.000001 >= F.col("least"))
        # a segment is sent out once for so many blocks: all queries meet in the first one
        salt = F.pmod(F.xxhash64("block"), F.lit(-(-blocks.count() // BLOCKS_A_TASK) or 1))
        tiles = materialise(tiles.select("block", "segment", F.col("dim").alias("d"), salt.alias("salt")), "ann-tiles")
        wave = wave.join(tiles.select("segment", "salt").distinct(), "segment")
        posted = tiles.join(blocks.select("block", F.col("dim").alias("d"), "qs", "norms", "known", "vecs").hint("merge"), ["block", "d"]).drop("block", "d")
        pairs = posted.join(wave.hint("merge"), ["segment", "salt"])
        hits = pairs.select("dim", "top", "rows", "data", "qs", "norms", "known", "vecs").mapInArrow(_searched(k), "q long, node long, least long, score double")
        hits = materialise(hits, "ann-hits", batch=1)
        was, all_hits = best, hits if best is None else hits.unionByName(best.drop("of"))
        best = materialise(_best(all_hits, k), "ann-best")
        release(blocks, tiles, hits, was)
        begin, width = begin + width, (begin + width) * WAVE
    return best.drop("of") if best is not None else spark.createDataFrame([], "q long, node long, least long, score double")


def nearest(index: Index, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` (row, vec_id, vec, norm; row null where it is none of the index's)."""
    asked = materialise(queries.groupBy("vec").agg(F.max("norm").alias("norm")).select(F.monotonically_increasing_id().alias("q"), "vec", "norm"), "ann-queries")
    # one more, as a query may find itself
    nodes = nearest_nodes(index, asked, k + 1, query_rows)
    rows = nodes.join(index.nodes.select("node", "ids"), "node").select("q", "score", F.inline("ids"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "z", "vec_id", "row")
    rows = rows.withColumn("of", F.row_number().over(w)).where(F.col("of") <= k + 1)
    found = rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("of", "vec_id", "row", "score"))).alias("found"))
    found = materialise(found.join(asked.select("q", "vec"), "q").select("vec", "found"), "ann-found")
    # many queries may be one vector: the merge join can be split where it is skewed
    each = queries.select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "vec").join(found.hint("merge"), "vec")
    others = F.slice(F.filter("found", lambda f: ~f["row"].eqNullSafe(F.col("own"))), 1, k)
    return each.select("query_id", F.posexplode(others).alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(build_index(rows, 20), rows.where(F.col("vec_id") % 20 == 0), 20)
