"""Evaluation of answers: citations, validity, metric means, retrieval metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.text import CITATION_SHAPE


def citations(answers: DataFrame, text: str) -> DataFrame:
    """A row (doc, rev) for each citation."""
    d = F.regexp_extract_all(text, F.lit(CITATION_SHAPE), F.lit(1))
    r = F.regexp_extract_all(text, F.lit(CITATION_SHAPE), F.lit(2))
    out = answers.withColumn("__c", F.explode(F.arrays_zip(d.alias("doc"), r.alias("rev"))))
    return out.select("*", "__c.doc", "__c.rev").drop("__c")


def validity(cites: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """1.0 where all of an answer's citations name a document revision."""
    known = documents.select(F.col("doc_id").alias("doc"), F.col("revision").alias("rev")).distinct().withColumn("__k", F.lit(True))
    rows = cites.join(known, ["doc", "rev"], "left")
    return rows.groupBy(*keys).agg(
        F.bool_and(F.col("__k").isNotNull()).cast("double").alias("validity"), F.count("*").alias("citations")
    )


def metric_means(observations: DataFrame) -> DataFrame:
    """(metric, mean, k, n) of 0/1 observations (metric, value)."""
    return observations.groupBy("metric").agg(F.avg("value").alias("mean"), F.sum("value").alias("k"), F.count("*").alias("n")).orderBy("metric")


def contains_all(text: str, needles: list[str]) -> Column:
    out = F.lit(True)
    for n in needles:
        out = out & F.contains(F.lower(text), F.lit(n.lower()))
    return out


def must_cite(cited: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), cited)) == 0


def problems(answers: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """What is wrong with each of ``answers`` (keys, answer, contains, require_citations, must_cite), one row an answer.

    missing: needles that are not there, whatever their case; no_citations: some are asked for and there are
    none; uncited: documents that should be cited and are not; invalid: citations of no document and revision.
    Expectations that are null ask for nothing, and a null answer is empty; the keys name an answer and are not null.
    """
    answers = answers.withColumn("answer", F.coalesce("answer", F.lit("")))
    cited = F.regexp_extract_all("answer", F.lit(CITATION_SHAPE), F.lit(1))
    known = documents.select(F.col("doc_id").alias("doc"), F.col("revision").alias("rev")).distinct()
    bad = citations(answers, "answer").select(*keys, "doc", "rev").join(known, ["doc", "rev"], "left_anti").groupBy(*keys).agg(F.count("*").alias("bad"))
    count = lambda x: F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0)).cast("long")
    return answers.join(bad, keys, "left").select(
        *keys,
        count(F.filter("contains", lambda n: ~F.contains(F.lower("answer"), F.lower(n)))).alias("missing"),
        (F.coalesce("require_citations", F.lit(False)) & (F.size(cited) == 0)).alias("no_citations"),
        count(F.array_except("must_cite", cited)).alias("uncited"), F.coalesce("bad", F.lit(0)).cast("long").alias("invalid"),
    )


def recall_at(found: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(query, recall): share of each query's expected doc_ids among its first ``k`` (rank from 1)."""
    top = found.where(F.col("rank") <= k).select("query", "doc_id").distinct().withColumn("__h", F.lit(1))
    rows = expected.join(top, ["query", "doc_id"], "left")
    return rows.groupBy("query").agg(F.avg(F.coalesce("__h", F.lit(0))).alias("recall"))


def set_metrics(queries: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query (n_found, n_expected, equal, includes, honest): whether the found doc_ids are the expected ones,
    include them, and are none where none are expected."""
    f = found.select("query", "doc_id").distinct().withColumn("f", F.lit(1))
    e = expected.select("query", "doc_id").distinct().withColumn("e", F.lit(1))
    per = f.join(e, ["query", "doc_id"], "full").groupBy("query").agg(F.count("f").alias("n_found"), F.count("e").alias("n_expected"), F.count(F.col("f") + F.col("e")).alias("both"))
    rows = queries.join(per, "query", "left").na.fill(0, ["n_found", "n_expected", "both"])
    same = (F.col("n_found") == F.col("both")) & (F.col("n_expected") == F.col("both"))
    return rows.select(
        "query", "n_found", "n_expected", same.alias("equal"), (F.col("n_expected") == F.col("both")).alias("includes"),
        ((F.col("n_expected") == 0) & (F.col("n_found") == 0)).alias("honest"),
    )


def load_cases(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, id, query, filter, expect, expect_answer: JSON) of YAML case files; none where no file matches."""
    import glob  # cases are small files beside the code, as tests are

    import yaml

    rows = []
    for name in sorted(glob.glob(pattern)):
        with open(name, encoding="utf-8") as f:
            for case in yaml.safe_load(f) or []:
                parts = [None if case.get(k) is None else json.dumps(case[k]) for k in ("filter", "expect", "expect_answer")]
                rows.append((name, str(case["id"]), case.get("query"), *parts))
    return spark.createDataFrame(rows, "file string, id string, query string, filter string, expect string, expect_answer string")
