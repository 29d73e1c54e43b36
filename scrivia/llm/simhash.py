"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the
radius of each.  Every fingerprint emits its variants, rows meet by variant, and
colliding pairs are verified on the whole fingerprint.

``blocks=1`` is the literal form: a 64-bit fingerprint at radius 4 emits its
2,081 variants within 2 bits.  Members of one variant are within 2 + 2 bits of
each other, so they need no comparing: each is linked to the variant's least
member, which keeps links linear in the size of a group.

``blocks=2`` (default) applies the same step to each 32-bit half: by pigeonhole
one half of a linked pair differs in at most radius // 2 bits, so its variants
within half of *that* meet: 2 x 33 rows instead of 2,081.  A meeting here says
nothing of the other half, so pairs are verified; in crowded variants, where
all pairs would be too many, members take the literal form instead.  Both
forms are exact.

Equal fingerprints are folded to one node first, so copies never make pairs.

Edge cases: a null or blank text has no words and fingerprint zero, linked like
any other; fewer words than a shingle make one shingle of them all; null doc_ids
take part but never name a component unless all of its ids are null; repeated
rows each get a row; ids are of any type; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scrivia.llm.common import components, materialise, membership_filter, possible_members, quoted, table

#: Up to so many fingerprints at a variant, their pairs are compared one by one.  A fingerprint
#: has 66 half-variants: with up to 63 at each, its pairs (66 x 31) are never more than its 2,081 variants.
CROWDED = 63


def fold_bits(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    if not len(h):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of blank-separated words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends + 1).tolist()
    ends = ends.tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    first = [0, *starts[: len(words) - width]]
    return np.array([digest(line[a:b], 42) for a, b in zip(first, ends[width - 1 :])], dtype=np.uint64)


def simhash(text: bytes | None, width: int = 4) -> int:
    return fold_bits(shingle_hashes(text or b"", width))


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp: long, the 64 bits as a signed number) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("binary").alias("text"))
    return src.mapInArrow(run, StructType([src.schema["doc_id"], StructField("fp", LongType())]))


def ball(bits: int, radius: int, shift: int = 0) -> list[int]:
    """All masks of at most ``radius`` set bits, as signed 64-bit numbers."""
    out = []
    for r in range(radius + 1):
        for c in combinations(range(shift, shift + bits), r):
            m = sum(1 << i for i in c)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _masks(values: list[int]):
    return F.expr(f"array({','.join(f'{v}L' if v > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for v in values)})")


def _half_variants(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, fp): the two halves' variants within half of radius // 2 bits, key = half and variant."""
    reach = (radius // 2 + 1) // 2
    masks = _masks(ball(32, reach))
    low, high = F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)")
    each = nodes.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 40)))).alias("h"))
    return each.select("fp", "h", F.explode(masks).alias("m")).select(
        F.col("h").bitwiseXOR(F.col("m")).alias("key"), "fp"
    )


def _literal_variants(nodes: DataFrame, reach: int) -> DataFrame:
    """(key, fp): all variants within ``reach`` bits.

    A ball is dealt out in 65 slices, by the lowest bit changed, before it is emitted: a
    few fingerprints with thousands of variants each would else sit in a few tasks.
    """
    slices: list[list[int]] = [[] for _ in range(65)]
    for m in ball(64, reach):
        slices[(m & -m).bit_length() - 1 if m else 64].append(m)
    table = F.array(*[_masks(x) for x in slices])
    dealt = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).repartition("fp", "i")
    return dealt.select("fp", F.explode(F.get(table, F.col("i"))).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("key"), "fp")


def _star_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Literal form: (a, b) links of each fingerprint to the least one at each of its variants."""
    if radius % 2:
        raise ValueError("the literal form takes an even radius")
    emitted = _literal_variants(nodes, radius // 2)
    shared = emitted.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("key", "a")
    shared = materialise(shared, "ball-star")
    return emitted.join(shared.hint("merge"), "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = 4, blocks: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b) links whose closure joins exactly the fingerprints within ``radius`` bits.

    ``nodes`` (fp: long) holds distinct fingerprints.
    """
    if blocks == 1:
        return _star_links(nodes, radius)
    emitted = _half_variants(nodes, radius)
    shared = materialise(
        emitted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"),
        "ball-shared",
    )
    filt = membership_filter(shared, "key", "ball-filter")
    met = materialise(possible_members(emitted, F.col("key"), filt).join(shared.hint("merge"), "key"), "ball-met")
    few = met.where(F.col("n") <= crowded)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
        .distinct()
    )
    dense = materialise(met.where(F.col("n") > crowded).select("fp").distinct(), "ball-dense")
    return pairs if dense.isEmpty() else pairs.unionAll(_star_links(dense, radius))


def near_classes(fps: DataFrame, radius: int = 4, blocks: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``fps`` (doc_id, fp)."""
    fps = materialise(fps, "simhash-rows", batch=256)
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(materialise(links(nodes.select("fp"), radius, blocks), "simhash-links"), "simhash-cc")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    classes = materialise(rooted.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(fingerprints(table(spark, sf_dir, "documents"), 4), radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
