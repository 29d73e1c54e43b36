"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of token classes: abuse, harm, target, negation, reported
speech, intent, other.  Five transducers rewrite that stream one after the other, each
reading what the one before wrote, and weigh what they rewrite:

* insult: abuse becomes an INSULT, heavier where it is heaped up;
* threat: harm with intent before it, or that opens its clause, becomes a THREAT, other
  harm a mere MENTION;
* target: an insult or threat near a target becomes AIMED; a threat at nobody weighs less;
* negation: an insult, threat or mention shortly after one becomes DENIED;
* reported speech: what follows it in the clause becomes QUOTED.

They are composed once into a single table of states, which each clause with abuse or
harm runs through; a clause scores the sum of its lexical weights times the composed
factors.  The document's score is a logistic of its clause scores.

Lexical weights are learned: log odds of words and word beginnings between toxic and
other labelled rows of a bounded sample (``TRAIN_ROWS``), over one row of each
family of near copies; the fixed word lists below only start them off.

Edge cases: null and empty texts have no clauses and get the score of a text
without any; rows that repeat each get a row; without labels the fixed
lists alone decide; ids are of any type; extra columns are kept (``keep``) whatever
their names, or not read; an empty table is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scrivia.llm.common import arrow_batches, materialise, quoted, table, unused
from scrivia.llm.quality import fold, label_sample

TRAIN_ROWS = 20_000
CUT = 0.5

# The token classes' words.
INSULTS = "bastard clown disgusting dumb fool idiot imbecile loser moron pathetic pig scum stupid trash ugly vermin worthless"
THREATS = "beat burn crush destroy die hang harm hurt kill murder punish shoot stab strangle"
TARGETS = "he her him she them they u you your yours du dich euch ihr sie te toi tu usted vous vosotros"
NEGATIONS = "aint cannot isnt kein keine never nicht nie no none nor not nunca pas sans sin without"
INTENTS = "gonna must shall should vais vamos vas voy want werde werden will wirst"
REPORTS = "according alleged called claimed dijo dit quoted reported sagte said says tweeted wrote"

#: What tokens are, and what the transducers make of them.
OTHER, ABUSE, HARM, TARGET, NEGATION, REPORT, INTENT = range(7)
INSULT, THREAT, MENTION, AIMED_INSULT, AIMED_THREAT, DENIED, QUOTED = range(7, 14)
_CLASS = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS)) for w in ws.split()}
PRIOR = {**dict.fromkeys(INSULTS.split(), 2.0), **dict.fromkeys(THREATS.split(), 0.75)}
_THREAT = frozenset(THREATS.split())
#: So many tokens after it, a target, a negation, an intent and an insult count.
TARGET_REACH, NEGATION_REACH, INTENT_REACH, HEAP_REACH = 4, 3, 3, 2


class Transducer:
    """Deterministic: ``step(state, symbol)`` gives (next state, symbol out, factor)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def run(self, symbols: Iterable[int]) -> tuple[list[int], list[float]]:
        """The symbols rewritten, and their factors."""
        state, out, factors = self.start, [], []
        for s in symbols:
            state, to, factor = self.step(state, s)
            out.append(to)
            factors.append(factor)
        return out, factors

    def compose(self, other: Transducer) -> Transducer:
        """Reads what this reads and writes what ``other`` makes of what this writes."""

        def step(state, symbol):
            a, mid, f = self.step(state[0], symbol)
            b, out, g = other.step(state[1], mid)
            return (a, b), out, f * g

        return Transducer((self.start, other.start), step)

    def compile(self, symbols: int = INSULT) -> list[list[tuple[int, int, float]]]:
        """Rows by state number of (next state, symbol out, factor) by symbol in."""
        number, rows, todo = {self.start: 0}, [], deque([self.start])
        while todo:
            state, row = todo.popleft(), []
            for s in range(symbols):
                to, out, factor = self.step(state, s)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], out, factor))
            rows.append(row)
        return rows


def _insult(left: int, s: int):
    if s == ABUSE:
        return HEAP_REACH, INSULT, 1.1 if left else 1.0
    return max(0, left - 1), s, 1.0


def _threat(left: int, s: int):
    """State -1: at the start of the clause."""
    if s == INTENT:
        return INTENT_REACH, OTHER, 1.0
    if s == HARM:
        return (max(0, left), THREAT, 1.0) if left else (0, MENTION, 0.5)
    return max(0, left - 1), s, 1.0


def _target(left: int, s: int):
    if s == TARGET:
        return TARGET_REACH, OTHER, 1.0
    left_after = max(0, left - 1)
    if s == INSULT and left:
        return left_after, AIMED_INSULT, 1.25
    if s == THREAT:  # a threat without a target says little
        return (left_after, AIMED_THREAT, 1.5) if left else (left_after, THREAT, 0.25)
    return left_after, s, 0.5 if s == MENTION and not left else 1.0


def _negation(left: int, s: int):
    if s == NEGATION:
        return NEGATION_REACH, OTHER, 1.0
    return (max(0, left - 1), DENIED, 0.6) if left and s >= INSULT else (max(0, left - 1), s, 1.0)


def _report(on: int, s: int):
    if s == REPORT:
        return 1, OTHER, 1.0
    return (on, QUOTED, 0.6) if on and s >= INSULT else (on, s, 1.0)


TRANSDUCERS = (Transducer(0, _insult), Transducer(-1, _threat), Transducer(0, _target), Transducer(0, _negation), Transducer(0, _report))
GRAMMAR = reduce(Transducer.compose, TRANSDUCERS).compile()
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_BREAKS = frozenset(".!?;\n")
_BEGIN = range(4, 9)


@dataclass
class Lexicon:
    words: dict[str, float]
    begins: dict[str, float]

    def __post_init__(self):
        self.lengths = sorted({len(b) for b in self.begins})

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.begins.get(word[:n], 0.0))
        return best


def symbol(token: str, weight: float) -> int:
    """The class of a token that has this lexical weight."""
    if weight > 0.0:
        return HARM if token in _THREAT else ABUSE
    return _CLASS.get(token, OTHER)


def clause_scores(text: str | None, lexicon: Lexicon) -> tuple[list[tuple[int, int, list[int], float]], int]:
    """((start, end, what its abuse and harm became, score) of matched clauses, in tokens; number of tokens)."""
    if not text:
        return [], 0
    tokens = _TOKEN.findall(text.lower())
    known: dict[str, float] = {}
    hits = []
    for i, t in enumerate(tokens):
        w = known.get(t)
        if w is None:
            w = known[t] = lexicon.weight(t)
        if w > 0.0:
            hits.append(i)
    found, done = [], -1
    for i in hits:
        if i < done:
            continue
        start = i
        while start > 0 and tokens[start - 1] not in _BREAKS:
            start -= 1
        state, score, end, became = 0, 0.0, start, []
        while end < len(tokens) and tokens[end] not in _BREAKS:
            t = tokens[end]
            w = known[t]
            state, out, factor = GRAMMAR[state][symbol(t, w)]
            if w > 0.0:
                score += w * factor
                became.append(out)
            end += 1
        done = end
        found.append((start, end, became, score))
    return found, len(tokens)


def _features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    found, n = clause_scores(text, lexicon)
    if not found:
        return 0.0, 0.0, 0.0
    scores = [x[3] for x in found]
    return max(scores), math.log1p(sum(scores)), 100.0 * sum(scores) / max(1, n)


@dataclass
class Model:
    lexicon: Lexicon
    coef: np.ndarray  # intercept and three weights

    def score(self, text: str | None) -> float:
        z = self.coef[0] + float(np.dot(self.coef[1:], _features(text, self.lexicon)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning ---------------------------------------------------------------


def _terms(text: str | None) -> tuple[set[str], set[str]]:
    words = {w for w in _TOKEN.findall((text or "").lower()) if w not in _BREAKS}
    return words, {w[:n] for w in words for n in _BEGIN if len(w) > n}


def _family(text: str | None) -> int:
    words = (text or "").lower().split()
    return min((hash_of(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def hash_of(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> 1


def learn_lexicon(sample: DataFrame, least_share: float = 0.01, least_rows: int = 4) -> Lexicon:
    """Weights from ``sample`` (doc_id, text, y): terms in ``least_share`` of toxic families, nearly pure."""

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([_family(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "y", "family"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Counter] = {}
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, begins = _terms(text)
                for kind, terms in (("w", words), ("b", begins)):
                    seen.setdefault((kind, y), Counter()).update(terms)
        for (kind, y), c in seen.items():
            terms, n = list(c), list(c.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(terms)), pa.array(terms), pa.array(n if y else [0] * len(n), pa.int64()), pa.array([0] * len(n) if y else n, pa.int64())],
                ["kind", "term", "t", "c"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    one = sample.mapInArrow(families, f"doc_id {kind}, y int, family long").groupBy("family", "y").agg(F.min("doc_id").alias("doc_id"))
    one = materialise(one.select("doc_id").distinct(), "toxic-families")
    # bounded by the sample
    rows = sample.join(F.broadcast(one), "doc_id")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic:
        return Lexicon(dict(PRIOR), {})
    need = max(least_rows, math.ceil(least_share * toxic))
    counts = rows.mapInArrow(count, "kind string, term string, t long, c long").groupBy("kind", "term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    counts = counts.where(F.col("t") >= need).withColumn("w", odds)
    # a term of log odds 2.5 or more is 12 times as frequent in toxic rows; each is in ``need`` rows of a bounded sample
    terms = counts.where("w >= 2.5").collect()
    words = dict(PRIOR)
    priors = {r["term"]: r["w"] for r in counts.where(F.col("kind") == "w").where(F.col("term").isin(list(PRIOR))).collect()}
    words.update({w: max(0.0, x) for w, x in priors.items()})
    words.update({r["term"]: r["w"] for r in terms if r["kind"] == "w"})
    return Lexicon(words, {r["term"]: r["w"] for r in terms if r["kind"] == "b"})


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps with a ridge; classes weigh the same."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    beta = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[l2] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge @ beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, folds: int = 5, rows: int = TRAIN_ROWS) -> Model:
    """``docs`` (doc_id, text); ``held_out`` is the fold whose labels are not read."""
    train = F.lit(True) if held_out is None else fold(of=folds) != held_out
    chosen = label_sample(labels, "toxic", train, rows, balanced=True)
    # bounded by ``rows``
    same = docs.doc_id.cast("string") == F.col("label_id")
    sample = materialise(docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "label_id")), same).select("label_id", "text", "y"), "toxic-sample")
    sample = sample.withColumnRenamed("label_id", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [_features(t, lexicon) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in f], pa.float64()) for i in range(3)), b.column(2)], ["a", "b", "c", "y"])

    with arrow_batches(docs.sparkSession, 256):
        lexicon = learn_lexicon(sample)
        got = sample.mapInArrow(run, "a double, b double, c double, y int").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in got], dtype=float).reshape(len(got), 3)
    y = np.array([r["y"] for r in got], dtype=float)
    if len(set(y)) < 2:
        return Model(lexicon, np.array([-3.0, 1.0, 0.5, 0.0]))
    return Model(lexicon, logistic(x, y))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: int | None = 0, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (doc_id by default) and, last, the score of every whole text: toxicity_score, with
    underscores added where a kept column has that name."""
    keep = [doc_id] if keep is None else keep
    (name,) = unused(keep, "toxicity_score")
    own = F.col(quoted(text)).cast("string")
    model = fit(docs.select(F.col(quoted(doc_id)).alias("doc_id"), own.alias("text")), labels, held_out)
    # plain names meanwhile: mapInArrow takes none with dots
    plain = [f"c{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(keep, plain)], own.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            scores = pa.array([model.score(t) for t in b.column(len(plain)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(plain)], scores], [*plain, "score"])

    return src.mapInArrow(run, StructType([*src.schema.fields[:-1], StructField("score", DoubleType())])).toDF(*keep, name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold(of=5) == 0).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= CUT).cast("int").alias("predicted"),
    )
