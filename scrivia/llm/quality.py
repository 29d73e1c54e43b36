"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are counted once in Arrow batches (a byte
histogram and a few word counts).  Trees are grown on the driver from a bounded sample
of labelled rows (``TRAIN_ROWS``) in binned features, all of one depth, and
flattened to arrays; scoring walks all trees of a batch level by level in numpy.

Edge cases: null and empty texts have all-zero statistics and get a score;
labels that repeat or are null count each or not at all; rows that repeat each
get a row; without labels of both classes the score is the base rate (0.5 with
none); extra columns are not read; an empty table is empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scrivia.llm.common import materialise, quoted, table

#: At most so many labelled rows are collected to grow the trees.
TRAIN_ROWS = 20_000
CUT = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_std", "word_max", "unique_words", "top_word", "repeats", "short_words",
    "upper", "digits", "stops", "commas", "symbols", "bars", "shouts", "brackets", "blank", "high_bytes", "entropy",
    "log_lines", "line_words", "unique_lines", "line_max", "odd_ends", "pair_top",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".?", "commas": b",;:", "symbols": b"#$%&*@^~=+",
    "bars": b"|", "shouts": b"!", "brackets": b"<>{}[]()/\\", "blank": b" \t\n\r\x0b\x0c",
}
_MASKS = {k: np.array(list(v)) for k, v in _CLASSES.items()}


def statistics(text: bytes | None) -> list[float]:
    """The document statistics named by ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = len(text)
    words = text.split()
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    line_words = [len(x.split()) for x in lines]
    p = hist[hist > 0] / n
    ends = sum(1 for w in words if w[-1] < 128 and not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] in b".,"))
    share = {k: float(hist[v].sum()) / n for k, v in _MASKS.items()}
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lens.mean()), float(lens.std()), float(np.log1p(lens.max())),
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, float((lens <= 3).mean()),
        share["upper"], share["digits"], share["stops"], share["commas"], share["symbols"], share["bars"], share["shouts"],
        share["brackets"], share["blank"], float(hist[128:].sum()) / n, float(-(p * np.log2(p)).sum()),
        float(np.log1p(len(lines))), len(words) / len(lines), len(set(lines)) / len(lines), float(np.log1p(max(line_words))),
        ends / m, max(pairs.values(), default=0) / m,
    ]


# --- trees ------------------------------------------------------------------


@dataclass
class Forest:
    """Complete trees in arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray  # goes right if the value is greater
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.split[trees, at])
        return self.base + self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss over histograms of gradients."""
    inner, leaves = 2**depth - 1, 2**depth
    f = x.shape[1] if x.ndim == 2 else len(FEATURES)
    mean = float(np.mean(y)) if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        clipped = min(max(mean, 1e-3), 1 - 1e-3)
        return Forest(np.zeros((1, inner), int), np.full((1, inner), np.inf), np.zeros((1, leaves)), float(np.log(clipped / (1 - clipped))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    out = Forest(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)  # node within its level
        for level in range(depth):
            width, best = 2**level, np.zeros(2**level)
            first = width - 1
            node = out.feature[t], out.split[t]
            chosen = np.full(width, bins)
            for j in range(f):
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                won = gain[np.arange(width), k]
                for i in np.nonzero(won > best + 1e-9)[0]:
                    best[i], chosen[i] = won[i], k[i]
                    node[0][first + i], node[1][first + i] = j, edges[j][k[i]]
            at = 2 * at + (binned[np.arange(len(y)), node[0][first + at]] > chosen[at])
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        out.leaf[t] = -rate * gs / (hs + l2)
        margin += out.leaf[t][at]
    return out


# --- Spark ------------------------------------------------------------------


def document_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, x: array<double>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    src = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("binary").alias("text"))
    return src.mapInArrow(run, StructType([src.schema["doc_id"], StructField("x", ArrayType(DoubleType()))]))


def fold(doc_id: str = "doc_id", of: int = 4):
    """crc32 of the id's text modulo ``of``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(0))


def label_sample(labels: DataFrame, label: str, train, rows: int = TRAIN_ROWS, balanced: bool = False) -> DataFrame:
    """(doc_id: string, y) of at most about ``rows`` labelled training rows, chosen by a hash of the id: all classes
    at one rate, or (``balanced``) half of each where there are enough."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y"))
    own = own.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(train).select(F.col("doc_id").cast("string").alias("doc_id"), "y")
    count = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if balanced:
        least = min(count.values(), default=0) if len(count) == 2 else 0
        small = min(least, rows // 2)
        most = {y: (small if n == least else rows - small) for y, n in count.items()}
    else:
        most = {y: rows * n / sum(count.values()) for y, n in count.items()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for y, n in count.items():
        keep = keep | ((F.col("y") == y) & (unit < 0.97 * most[y] / max(1, n) if most[y] < n else F.lit(True)))
    return own.where(keep).limit(rows)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 2, folds: int = 4, rows: int = TRAIN_ROWS) -> Forest:
    sample = label_sample(labels, label, fold(of=folds) != held_out, rows).select(F.col("doc_id").alias("label_id"), "y")
    # the sample is bounded by ``rows``; of documents that repeat an id one counts
    met = stats.join(F.broadcast(sample), F.col("doc_id").cast("string") == F.col("label_id"))
    got = sorted(met.groupBy("label_id", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: (r["label_id"], r["y"]))
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    return grow(x, np.array([r["y"] for r in got], dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stats = materialise(document_statistics(docs, text, doc_id), "quality-statistics", batch=256)
    forest = fit(stats, labels, rows=rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(x))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, StructType([stats.schema["doc_id"], StructField("score", DoubleType())]))
    return scored.select(
        "doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
