"""Near-duplicate removal for a corpus: copies by five-word shingles, without loss.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity
of at least 0.8.  One document of each group, the one of least id, stays.

SimHash comes first, as in op7: fingerprints within ``RADIUS`` bits are found exactly by
meet-in-the-middle ball hashing (``simhash.links``), and each text is compared with the
least text it is linked to and is folded if it is similar.

Large families of copies beyond that radius are folded next, as all their pairs would be too
many: where more than ``FAMILY`` texts share a half of a SimHash over distinct words
(``TABLES`` fingerprints, eight keys a text), each is compared with the key's least text only
and is folded if it is similar, round by round while that folds many.

Then all texts, folded ones too, are paired by prefix filtering: with shingles in one
order for all, two similar sets share one of their first n - ceil(0.8 n) + 1.  Any order
loses no pair; shingles that a sample of the texts finds common come last, so few texts
meet.  A pair's first shared shingle is even among the first n - ceil(8/9 n) + 1 of the
shorter set, so only those are joined with the longer set's longer prefix: form letters
of one shape that differ just too much share none there.  Where many still meet, lengths
are joined in classes, and a set asks only those that what is left at the shingle allows.
Texts of one group already need no comparing: at each shingle the group with most
texts there is compared with all the rest.  Where that would cost more, at shingles of more
than ``FAMILY`` texts each is compared first with ``HEADS`` of the least edited ones, round by
round while that links many.  All that is compared is verified on the whole sets, but for pairs whose parities already differ
in more bits than sets of that similarity do in shingles.

Edge cases: null, empty and blank texts are one text; equal texts are folded before the
search; rows equal in id and text are copies of each other; a null id stays only
where the group has no other; extra columns are kept; an empty table is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import BLANK, Filter, components, materialise, membership_filter, possible_members, quoted, release, unused
from scrivia.llm.simhash import fold_bits, links, shingle_hashes, simhash

#: Bits by which linked fingerprints differ at most, as in op7.
RADIUS = 4
TABLES, WIDTH, SIMILARITY, FAMILY, HEADS = 4, 5, 0.8, 16, 16
#: One text in so many is counted to tell common shingles; their levels are kept by slots of the hash.
SAMPLE, SLOTS = 8, 1 << 22
#: Pairs a task verifies on average.
PART_PAIRS = 1_000
#: Classes of lengths for each doubling of the length.
CLASSES = 32
#: Longs of a text's bitmap; its shingles set one bit each.
MARKS = 8
_MARKS = [f"m{i}" for i in range(MARKS)]


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """An independent hash of each hash (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_fingerprints(text: bytes | None, tables: int = TABLES) -> list[int]:
    words = set((text or b"").lower().split())
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)
    return [fold_bits(_mixed(h, t + 1)) for t in range(tables)]


def prefix(h: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: two sets as similar as that share one of theirs."""
    h = np.unique(h)
    h = h[np.lexsort((h, levels[h & np.uint64(SLOTS - 1)]))]
    return h[: len(h) - math.ceil(len(h) * similarity - 1e-9) + 1]


def marks(h: np.ndarray) -> np.ndarray:
    """Sets differ in no fewer shingles than their bitmaps in bits."""
    bits = np.zeros(64 * MARKS, dtype=np.uint8)
    bits[h >> np.uint64(40) & np.uint64(64 * MARKS - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def parities(h: np.ndarray) -> np.ndarray:
    """Two to four bits a shingle, each flipped by every shingle that falls on it.

    Sets differ in no fewer shingles than these in bits, also with the longer folded to the
    shorter's length by xor of its halves.
    """
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _rows(docs: DataFrame, tables: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, fp: SimHash, f0, f1, ... over distinct words, n: distinct shingles, p: the first ones, w: parities, m0, m1, ...: bitmap)."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs))
    names = [f"f{t}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            fps = np.array([word_fingerprints(t, tables) for t in texts], dtype=np.uint64).reshape(b.num_rows, tables)
            cols = [pa.array(np.ascontiguousarray(fps[:, t]).view(np.int64)) for t in range(tables)]
            fp = pa.array(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))
            sets = [np.unique(shingle_hashes(t, WIDTH)) for t in texts]
            n = pa.array([len(h) for h in sets], pa.int32())
            p = pa.array([prefix(h, levels.value, similarity).view(np.int64) for h in sets], pa.list_(pa.int64()))
            w = pa.array([parities(h) for h in sets], pa.list_(pa.int64()))
            bits = np.array([marks(h) for h in sets], dtype=np.int64).reshape(b.num_rows, MARKS)
            m = [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(MARKS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, *cols, n, p, w, *m], ["doc_id", "text_hash", "fp", *names, "n", "p", "w", *_MARKS])

    src = docs.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    longs = lambda cols: "".join(f", {c} long" for c in cols)
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long{longs(names)}, n int, p array<bigint>, w array<bigint>{longs(_MARKS)}"
    return materialise(src.mapInArrow(run, schema), "near-rows", batch=256)


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(text_hash, s: array of distinct five-word shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t or b"", WIDTH)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_hash", "s"])

    return texts.select("text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(run, "text_hash long, s array<bigint>")


def _levels(docs: DataFrame) -> np.ndarray:
    """By slot of a shingle's hash, the length in bits of the largest count among sampled texts; 0 up to one text."""
    some = docs.where(F.pmod(F.xxhash64("text_hash"), F.lit(SAMPLE)) == 0)
    held = _shingle_sets(some).select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    slots = held.groupBy(F.expr(f"cast(h & {SLOTS - 1}L as int)").alias("slot")).agg(F.max("c").alias("c"))
    slots = materialise(slots.select("slot", F.least(F.floor(F.log2("c")) + 1, F.lit(99)).cast("byte").alias("level")), "near-levels", batch=256)
    got = slots.toArrow()  # at most SLOTS rows of five bytes
    release(slots)
    out = np.zeros(SLOTS, dtype=np.int8)
    out[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return out


def _meeting(rows: DataFrame, keys: DataFrame, label: str) -> DataFrame:
    """The rows (key, ...) of the keys, written; a filter of the keys goes first, so other rows never leave their task."""
    keys = materialise(keys, f"{label}-keys")
    filt = membership_filter(keys, "key", f"{label}-filter")
    # keys are distinct; an inner join, as Spark moves a semi join below the filter and then shuffles every row
    met = materialise(possible_members(rows, F.col("key"), filt).join(keys.hint("merge"), "key"), label)
    release(keys, filt.rows)
    return met


def _balled(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): each text with the least text whose fingerprint is within ``radius`` bits, found by ball hashing."""
    texts = rows.select("fp", "text_hash").distinct()
    least = materialise(texts.groupBy("fp").agg(F.min("text_hash").alias("least")), "near-prints")
    near = materialise(links(least.select("fp"), radius), "near-balls")
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(n)).hint("merge") for c, n in (("a", "x"), ("b", "y")))
    across = near.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = texts.join(least.hint("merge"), "fp").where("text_hash <> least").select(F.col("least").alias("a"), F.col("text_hash").alias("b"))
    pairs = materialise(_ordered(across.unionAll(equal)).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-pairs")
    release(least, near)
    return pairs


def _families(nodes: DataFrame, tables: int) -> DataFrame:
    """(key, node) of the half fingerprints that more than ``FAMILY`` texts share."""
    halves = []
    for t in range(tables):
        halves.append(F.expr(f"(f{t} & 4294967295L) | {(2 * t) << 40}L"))
        halves.append(F.expr(f"shiftrightunsigned(f{t}, 32) | {(2 * t + 1) << 40}L"))
    emitted = nodes.select(F.col("text_hash").alias("node"), F.explode(F.array(*halves)).alias("key"))
    return _meeting(emitted, emitted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY).select("key"), "near-families")


def _led(met: DataFrame) -> DataFrame:
    """(a, b): each text of a variant with the variant's pivot, its least text."""
    least = materialise(met.groupBy("key").agg(F.min("node").alias("a")), "near-pivots")
    led = met.join(least.hint("merge"), "key").where("node <> a").select("a", F.col("node").alias("b"))
    led = materialise(led.distinct(), "near-pairs")
    release(least)
    return led


def _ends(pairs: DataFrame, parts: int) -> Filter:
    """A filter of the texts in ``pairs`` (a, b)."""
    ends = pairs.select(F.col("a").alias("text_hash")).unionAll(pairs.select("b")).distinct()
    ends = materialise(ends, "near-ends", parts=parts)
    filt = membership_filter(ends, "text_hash", "near-ends-filter")
    release(ends)
    return filt


def _both(pairs: DataFrame, texts: DataFrame, **columns: str) -> DataFrame:
    """``pairs`` with the named columns of both texts, as name + a and name + b."""
    for end in "ab":
        side = texts.select(F.col("text_hash").alias(end), *[F.col(c).alias(f"{n}{end}") for n, c in columns.items()])
        pairs = pairs.join(side.hint("merge"), end)
    return pairs


def _likely(pairs: DataFrame, rows: DataFrame, similarity: float, parts: int) -> DataFrame:
    """The pairs (a, b) but those whose parities show that they are not similar."""
    filt = _ends(pairs, parts)
    wide = possible_members(rows.select("text_hash", "n", "w"), F.col("text_hash"), filt)
    wide = materialise(wide.groupBy("text_hash").agg(F.min("n").alias("n"), F.min("w").alias("w")), "near-parities", parts=parts)
    joined = _both(pairs, wide, n="n", w="w").withColumn("k", F.least(F.size("wa"), F.size("wb")))
    halves = lambda w: F.zip_with(F.slice(w, 1, F.col("k")), F.slice(w, F.col("k") + 1, F.col("k")), lambda p, q: p.bitwiseXOR(q))
    # sets of that similarity are of one length or of two neighbouring ones
    wa, wb = (F.when(F.size(w) > F.col("k"), halves(w)).otherwise(F.col(w)) for w in ("wa", "wb"))
    differ = F.aggregate(F.zip_with(wa, wb, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    n = F.col("na") + F.col("nb")
    near = joined.where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity)
    near = near.where(differ <= n * F.lit((1 - similarity) / (1 + similarity)) + 1e-9)
    near = materialise(near.select("a", "b"), "near-likely", parts=parts)
    release(filt.rows, wide)
    return near


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar."""
    pairs = _likely(pairs, rows, similarity, 1 + pairs.count() // PART_PAIRS)
    parts = 1 + pairs.count() // PART_PAIRS
    filt = _ends(pairs, parts)
    texts = possible_members(docs.select("text_hash", "text"), F.col("text_hash"), filt)
    sets = materialise(_shingle_sets(texts.groupBy("text_hash").agg(F.min("text").alias("text"))), "near-sets", batch=256, parts=parts)
    n, m = F.size("sa"), F.size("sb")
    both = F.size(F.array_intersect("sa", "sb"))
    joined = _both(pairs, sets, s="s")
    near = joined.where((F.least(n, m) >= F.greatest(n, m) * similarity)).where(both >= (n + m - both) * F.lit(similarity))
    near = materialise(near.select("a", "b"), "near-edges", parts=parts)
    release(pairs, filt.rows, sets)
    return near


def _asks(similarity: float, of: str = ""):
    """Whether a set as short as its partner, or shorter, may share this shingle first."""
    return F.col(f"{of}left") >= F.col(f"{of}n") * F.lit(2 * similarity / (1 + similarity)) - 1e-9


def _shared(texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, left, m0, m1, ...) of the first shingles that texts of several groups share, one of them as the shorter."""
    teams = materialise(_teamed(texts.withColumnRenamed("text_hash", "node"), roots), "near-teams")
    # left: how many shingles, this one included, are not yet passed
    first = teams.select("node", "team", "n", *_MARKS, F.posexplode("p").alias("i", "key"))
    first = first.select("key", "node", "team", "n", (F.col("n") - F.col("i")).alias("left"), *_MARKS)
    held = first.groupBy("key").agg(F.min("team").alias("lo"), F.max("team").alias("hi"), F.max(_asks(similarity)).alias("asks"))
    mixed = held.where("lo <> hi and asks").select("key")
    met = _meeting(first.drop("team"), mixed, "near-shared")
    release(teams)
    return met


def _teamed(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``df`` (node, ...) with the team each node is in."""
    known = roots.select(F.col("node").alias("__n"), "root").hint("merge")
    return df.join(known, F.col("node") == F.col("__n"), "left").withColumn("team", F.coalesce("root", "node")).drop("__n", "root")


def _sides(met: DataFrame, *more) -> tuple[DataFrame, DataFrame]:
    """``met`` as (key, a, ta, xa: what ``_enough`` asks) with ``more`` columns, and as (key, b, tb, xb)."""
    x = F.struct("n", "left", *_MARKS)
    a, b = ([F.col("node").alias(s), F.col("team").alias(f"t{s}"), x.alias(f"x{s}")] for s in "ab")
    return met.select("key", *a, *more), met.select("key", *b)


def _enough(similarity: float):
    """No more can be shared than is left at the first shared shingle, and no fewer differ than bits of the bitmaps."""
    n = F.col("xa.n") + F.col("xb.n")
    left = F.least("xa.left", "xb.left") >= n * F.lit(similarity / (1 + similarity)) - 1e-9
    differ = sum(F.bit_count(F.col(f"xa.{m}").bitwiseXOR(F.col(f"xb.{m}"))) for m in _MARKS)
    return left & (differ <= n * F.lit((1 - similarity) / (1 + similarity)) + 1e-9)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _starred(met: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b): at shingles that over ``FAMILY`` texts share, each with ``HEADS`` of them, others each turn.

    Heads are those with the fewest rarer shingles, one of each of ``HEADS`` classes: of a
    family of copies the least edited, so the same at many shingles and similar to most.
    """
    many = materialise(met.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > FAMILY).select("key"), "near-many")
    large = materialise(met.join(many.hint("merge"), "key", "left_semi"), "near-large")
    a, b = _sides(large)
    dealt = a.withColumn("z", F.xxhash64("a", F.lit(turn))).withColumn("passed", F.col("xa.n") - F.col("xa.left"))
    best = F.struct("passed", "z", "a", "ta", "xa")
    heads = [F.min(F.when(F.pmod("z", F.lit(HEADS)) == i, best)) for i in range(HEADS)]
    heads = dealt.groupBy("key").agg(F.array_compact(F.array(*heads)).alias("x"))
    heads = heads.select("key", F.transform("x", lambda x: F.struct(x["a"], x["ta"], x["xa"])).alias("x"))
    heads = materialise(heads.select("key", F.inline("x").alias("a", "ta", "xa")), "near-heads")
    pairs = materialise(_ordered(b.join(heads.hint("merge"), "key").where("ta <> tb").where(_enough(similarity))), "near-pairs")
    release(many, large, heads)
    return pairs


#: Pairs that meet at a key of ``_most``.
_PAIRS = "((asks - i) * n + i * (n - m))"


def _most(met: DataFrame, similarity: float) -> DataFrame:
    """(key, most: the group with most texts there, m: of how many, i: of how many that ask, n, asks: of how many in all)."""
    each = met.groupBy("key", "team").agg(F.count("*").alias("m"), F.count_if(_asks(similarity)).alias("i"))
    most = each.groupBy("key").agg(F.max(F.struct("m", "team", "i")).alias("x"), F.sum("m").alias("n"), F.sum("i").alias("asks"))
    return materialise(most.select("key", F.col("x.team").alias("most"), F.col("x.m").alias("m"), F.col("x.i").alias("i"), "n", "asks"), "near-most")


def _class(n):
    return F.floor(F.log2(n) * CLASSES).cast("int")


def _questions(teamed: DataFrame, most: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, rest, size, a, ta, xa) asked of (key, rest, size, b, tb, xb): the shorter sets of the longer, of other groups.

    ``rest``: whether the longer is not of the key's largest group, which asks only such.
    ``size``: the class of the longer's length, from the shorter's own up to what its shingles left can reach; 0 where few pairs meet.
    """
    left = most.where("m < n").select("key", "most", F.expr(f"{_PAIRS} > n * {HEADS}").alias("many")).hint("merge")
    a, b = _sides(teamed)
    a, b = a.join(left, "key"), b.join(left, "key")
    n, reach = F.col("xa.n"), F.col("xa.left") * F.lit((1 + similarity) / similarity) - F.col("xa.n") + 1e-6
    sizes = F.when(F.col("many"), F.sequence(_class(n), F.greatest(_class(n), _class(reach)))).otherwise(F.array(F.lit(0)))
    rests = F.when(F.col("ta") == F.col("most"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    asking = a.where(_asks(similarity, "xa.")).withColumn("size", F.explode(sizes)).withColumn("rest", F.explode(rests))
    asked = b.withColumn("size", F.when(F.col("many"), _class(F.col("xb.n"))).otherwise(0)).withColumn("rest", F.col("tb") != F.col("most"))
    return asking.drop("most", "many"), asked.drop("most", "many")


def _across(teamed: DataFrame, most: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of texts of different groups that may be similar by their first shared shingle."""
    asking, asked = _questions(teamed, most, similarity)
    pairs = asking.join(asked, ["key", "rest", "size"]).where("ta <> tb and xa.n <= xb.n").where(_enough(similarity))
    return materialise(_ordered(pairs), "near-pairs")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash) rows, (node, root) of grouped texts) for ``docs`` (doc_id, text_hash, text)."""
    rows = _rows(docs, tables, similarity)
    names = [f"f{t}" for t in range(tables)]
    active = materialise(rows.groupBy("text_hash").agg(*[F.min(f).alias(f) for f in names]), "near-nodes")
    parts: list[DataFrame] = []

    def edges() -> DataFrame:
        return reduce(DataFrame.unionAll, parts)

    def folded(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The active texts without those that prove similar to a lesser one, which has it, or one below it, to stand for it."""
        found = _verified(pairs, docs, rows, similarity)
        parts.append(found)
        gone = found.select(F.col("b").alias("text_hash")).distinct()
        left = materialise(active.join(gone, "text_hash", "left_anti"), "near-nodes")
        n = gone.count()
        release(pairs, active)
        return left, n

    active, _ = folded(_balled(rows, radius))
    while True:
        met = _families(active, tables)
        active, gone = folded(_led(met))
        few = gone * 10 <= met.select("node").distinct().count()
        release(met)
        if few:
            break
    release(active)
    roots = components(edges(), "near-cc")
    met = _shared(rows.groupBy("text_hash").agg(*[F.min(c).alias(c) for c in ("n", "p", *_MARKS)]), roots, similarity)
    turn, linked = 0, True
    while True:
        teamed = materialise(_teamed(met, roots), "near-teamed")
        most = _most(teamed, similarity)
        # stars cost ``HEADS`` comparisons a text and shingle: they are tried where all pairs cost more, as long as they link
        pairs, shared = most.agg(F.sum(F.expr(_PAIRS)), F.sum("n")).first()
        last = not linked or (pairs or 0) <= HEADS * (shared or 0)
        pairs = _across(teamed, most, similarity) if last else _starred(teamed, similarity, turn)
        found = _verified(pairs, docs, rows, similarity)
        parts.append(found)
        linked = not last and found.count() * 10 > pairs.count()
        release(teamed, most, pairs, roots)
        roots, turn = components(edges(), "near-cc"), turn + 1
        if last:
            break
    release(met, *parts)
    return rows, roots


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns."""
    cols = [F.col(quoted(c)) for c in docs.columns]
    h, gone, of = unused(docs.columns, "h", "gone", "of")
    own, body = F.col(quoted(doc_id)), F.col(quoted(text))
    body = F.when(body.rlike(f"[^{BLANK}]"), body).otherwise("")
    named = docs.withColumn(h, F.xxhash64(body))
    rows, roots = near_groups(named.select(own.alias("doc_id"), F.col(h).alias("text_hash"), body.alias("text")), **options)
    slim = rows.select("doc_id", "text_hash")
    placed = materialise(
        slim.join(roots, slim.text_hash == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root")), "near-placed"
    )
    release(rows, roots)
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    keep = materialise(placed.groupBy("root").agg(F.count("*").alias("n"), F.min(first).alias("k")).where("n > 1").select("root", "k"), "near-keep")
    # rows of groups of more than one row; all others pass without a shuffle of their texts
    grouped = placed.join(keep, "root").select("text_hash", "k").distinct()
    grouped = materialise(grouped.select(F.col("text_hash").alias(gone), F.col("k.doc_id").alias(of), (F.col("text_hash") == F.col("k.text_hash")).alias("first")), "near-grouped")
    release(placed, keep)
    filt = membership_filter(grouped, gone, "near-grouped-filter")
    single = possible_members(named, F.col(h), filt, rest=True).select(*cols)
    asked = possible_members(named, F.col(h), filt)
    # false positives of the filter are in no group and stay
    lone = asked.join(grouped.select(gone), F.col(h) == F.col(gone), "left_anti").select(*cols)
    stays = grouped.where("first").select(gone, of)
    chosen = asked.join(stays, (F.col(h) == F.col(gone)) & own.eqNullSafe(F.col(of)), "left_semi")
    # rows equal in id and text are copies of each other: one of each stays
    ids = chosen.withColumn(of, own)
    return single.unionByName(lone).unionByName(ids.dropDuplicates([h, of]).select(*cols))
