"""Embedding whitening from an exact scatter in residue numbers.

Entries become integers (``floor(scale * c)``).  Over the distinct integer vectors a first
pass takes n, the sums S and each dimension's range; a second one centres every vector
exactly as ``n*x - S`` and multiplies: in each partition, for each of several primes, a
matrix product of the residues, in doubles that never pass 2^53, so without rounding.
Residues are summed by aggregation, and the Chinese remainder theorem gives the scatter
as whole numbers; how many primes that takes follows from the ranges.  Its eigenvectors
come from ``eigh`` in double precision, run a second time in the first run's basis, which
clears what rounding left off the diagonal.

Only figures of the dimension's size (sums, ranges, the scatter) reach the driver.

Edge cases: vectors that are null, empty, hold null or non-finite entries, entries whose
integer does not fit a long, or have another length than most (ties: the longer) are
dropped; repeated rows each get their rows, and equal integer vectors count once in the
fit; a component without variance has a null ``whitened``; a deviation beyond a long is
null; a null vec_id is kept; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from scrivia.llm.common import materialise, quoted, release, table

SCALE, COMPONENTS = 256, 4
#: Balanced residues stay within 2^21, their products within 2^42: 1,024 of them sum exactly.
PRIME_BITS, EXACT_ROWS = 22, 1024


class Fit(NamedTuple):
    """Figures of the fit list; ``axes`` holds unit eigenvectors in columns, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    largest: int  # of |n*x - S|


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x: array of long) of the vectors that take part; a written table."""
    entry = F.transform(F.col("v"), lambda c: c.cast("double") * scale)
    rows = vectors.select(F.col(quoted(vec_id)).alias("vec_id"), F.col(quoted(embedding)).alias("v")).withColumn("v", entry)
    # comparisons with null are null, so an array with one is no part of this; NaN is above all numbers
    fit = rows.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float(1 << 63)), F.lit(False))))
    whole = materialise(fit.select("vec_id", F.transform("v", lambda c: F.floor(c) + F.lit(0)).alias("x")), "whiten-x")
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole if not lengths else whole.where(F.size("x") == lengths[0]["d"])


def primes(above: int, bits: int = PRIME_BITS) -> list[int]:
    """The greatest primes below 2^bits, as many as their product needs to pass ``above``."""
    out, product, p = [], 1, (1 << bits) - 1
    while product <= above:
        if all(p % k for k in range(3, isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _residue_scatter(distinct: DataFrame, n: int, sums: list[int], moduli: list[int]) -> DataFrame:
    """(p, i, j, v), i <= j: the sum of (n*x - S)_i * (n*x - S)_j modulo the p-th prime."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(moduli), d, d), dtype=np.int64)
        seen = False
        for b in batches:
            x = _matrix(b.column(0))
            for at in range(0, len(x), EXACT_ROWS):
                part, seen = x[at : at + EXACT_ROWS], True
                for k, p in enumerate(moduli):
                    y = (part % p * (n % p) - np.array([s % p for s in sums])) % p
                    y = np.where(y > p // 2, y - p, y).astype(np.float64)
                    totals[k] = (totals[k] + (y.T @ y).astype(np.int64)) % p
        if seen:
            k, i = np.divmod(np.arange(len(moduli) * d), d)
            rows = [totals[a, c, c:] for a, c in zip(k, i)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["p", "i", "row"])

    parts = distinct.select("x").mapInArrow(run, "p int, i int, row array<long>")
    cells = parts.select("p", "i", F.posexplode("row").alias("off", "v")).groupBy("p", "i", "off").agg(F.sum("v").alias("v"))
    return cells.select("p", "i", (F.col("i") + F.col("off")).alias("j"), "v")


def reconstructed(residues: list[tuple[int, int]]) -> int:
    """The whole number of least size with these (residue, prime) pairs."""
    value, product = 0, 1
    for r, p in residues:
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if value > product // 2 else value


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of a symmetric matrix: eigh, then eigh in that basis."""
    _, first = np.linalg.eigh(cov)
    turned = first.T @ cov @ first
    values, second = np.linalg.eigh((turned + turned.T) / 2)
    axes = first @ second
    axes /= np.linalg.norm(axes, axis=0)
    return values[::-1], axes[:, ::-1]


def fit_whitening(distinct: DataFrame) -> Fit | None:
    """Figures of the written fit list ``distinct`` (x: array of long); None where it is empty."""
    cells = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i")
    whole = cells.agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high"))
    figures = whole.orderBy("i").collect()  # a row a dimension
    if not figures:
        return None
    n, sums, d = figures[0]["n"], [int(r["s"]) for r in figures], len(figures)
    largest = max(max(abs(n * r["low"] - int(r["s"])), abs(n * r["high"] - int(r["s"]))) for r in figures)
    moduli = primes(2 * n * largest * largest + 1)
    residues: dict[tuple[int, int], list] = {}
    for r in _residue_scatter(distinct, n, sums, moduli).orderBy("p").collect():  # d * d / 2 cells a prime
        residues.setdefault((r["i"], r["j"]), []).append((r["v"] % moduli[r["p"]], moduli[r["p"]]))
    cov = np.empty((d, d))
    trace = 0
    for (i, j), found in residues.items():
        exact = reconstructed(found)
        trace += exact if i == j else 0
        cov[i, j] = cov[j, i] = exact / n**3  # rounded once
    values, axes = eigen(cov)
    return Fit(n, sums, values, axes, trace / n**3, largest)


def whitened_rows(rows: DataFrame, fit: Fit, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened: array of double, null where a component has no variance) of each row."""
    n, d, use = fit.n, len(fit.sums), min(components, len(fit.sums))
    usable = fit.values[:use] > d * np.finfo(float).eps * max(fit.trace, 0.0)
    narrow = fit.largest * fit.largest * d < 1 << 63  # else Python's whole numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(fit.sums, dtype=np.int64 if narrow else object)
        turn = np.where(usable, fit.axes[:, :use] / np.sqrt(np.where(usable, fit.values[:use], 1.0)), np.nan)
        for b in batches:
            x = _matrix(b.column(1)).reshape(-1, d)
            y = (x if narrow else x.astype(object)) * n - sums
            deviation = [int(v) for v in (y * y).sum(axis=1)]
            deviation = [v if abs(v) < 1 << 63 else None for v in deviation]
            w = (y / n).astype(np.float64) @ turn
            flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN to null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, use), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(run, StructType([kind]).add("deviation", LongType()).add("whitened", ArrayType(DoubleType())))


def identity_error(distinct: DataFrame, fit: Fit, components: int = COMPONENTS) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, over components with variance."""
    rows = whitened_rows(distinct.select(F.lit(0).alias("vec_id"), "x"), fit, components)
    use = min(components, len(fit.sums))
    cells = [F.get("whitened", F.lit(i)) for i in range(use)]
    mean = rows.agg(*[F.avg(c) for c in cells]).first()
    centred = [c - F.lit(m) for c, m in zip(cells, mean)]
    cov = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in range(use) for j in range(i, use)]).first()
    off = [abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(use) for j in range(i, use) if mean[i] is not None and mean[j] is not None]
    return max(off, default=0.0)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    rows = integers(vectors, vec_id, embedding, scale)
    distinct = materialise(rows.select("x").distinct(), "whiten-distinct")
    fit = fit_whitening(distinct)
    if fit is None:
        none = rows.select("vec_id").limit(0)
        return none.selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    error = identity_error(distinct, fit, components)
    release(distinct)
    share = F.array(*[F.lit(float(v / fit.trace) if fit.trace > 0 else None).cast("double") for v in fit.values[:components]])
    each = whitened_rows(rows, fit, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
