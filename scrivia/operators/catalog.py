"""Revision chains and catalog search with exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.text import PATTERN_MOST, fragments, fuzzy_tokens, lcs, lcs_of_long, letter_mask, letters, normal_id, pattern, revision_key

THRESHOLD, FLOOR, TYPE_CAP = 75.0, 55.0, 88.0
# Common names of the document types.
TYPE_NAMES = {
    "BOM": "bill of materials",
    "VVPR": "verification protocol report",
    "VVAM": "verification validation acceptance matrix trace",
    "ECR": "engineering change request",
    "ESF": "engineering specification",
    "RSK": "risk analysis assessment",
    "PLN": "plan",
    "DHF": "design history file",
    "DMR": "device master record",
    "DR": "design review",
    "IFU": "instructions for use",
    "TRA": "training",
    "QSR": "quality system record",
    "MEMO": "memo",
    "3P": "third party report",
}


def chains(documents: DataFrame) -> DataFrame:
    """One row per doc_id: type, revisions (ordered), latest_current, latest_any, title."""
    key = revision_key("revision")
    live = ~F.col("is_obsolete")
    entry = F.struct(
        F.length("revision").alias("n"), "revision", "title", "is_signed", "is_obsolete", "is_empty", "sw_version"
    )
    out = documents.groupBy("doc_id").agg(
        F.min("type_prefix").alias("type"),
        F.array_sort(F.collect_list(entry)).alias("revisions"),
        F.max(F.when(live, F.struct(key.alias("k"), "revision", "title"))).alias("cur"),
        F.max(F.struct(key.alias("k"), "revision", "title")).alias("any"),
    )
    return out.select(
        "doc_id",
        "type",
        "revisions",
        F.col("cur.revision").alias("latest_current"),
        F.col("any.revision").alias("latest_any"),
        F.coalesce("cur.title", "any.title").alias("title"),
    )


def titled(names: DataFrame) -> DataFrame:
    """(doc_id, type, revisions) with titles alone: what searches for many questions read of ``chains``, which names tell."""
    return names.groupBy("doc_id").agg(F.min("type_prefix").alias("type"), F.collect_list(F.struct("title")).alias("revisions"))


def default_revisions(documents: DataFrame) -> DataFrame:
    """(doc_id, revision, is_current): the latest of any status, and whether it is the latest current one."""
    c = chains(documents)
    return c.select("doc_id", F.col("latest_any").alias("revision"), F.coalesce(F.col("latest_any") == F.col("latest_current"), F.lit(False)).alias("is_current"))


def filtered(c: DataFrame, doc_type: str | None = None, status: str | None = None, sw_version: str | None = None) -> DataFrame:
    if doc_type:
        c = c.where(F.col("type") == doc_type.upper())
    if sw_version:
        v = sw_version.lower()
        v = v if v.startswith("v") else f"v{v}"
        c = c.where(F.exists("revisions", lambda r: F.coalesce(F.lower(r["sw_version"]) == v, F.lit(False))))
    if status:
        tests = {
            "signed": F.exists("revisions", lambda r: r["is_signed"]),
            "obsolete": F.col("latest_current").isNull(),
            "current": F.col("latest_current").isNotNull(),
            "empty": F.forall("revisions", lambda r: r["is_empty"]),
        }
        if status.lower() not in tests:
            raise ValueError(f"unknown status {status!r}")
        c = c.where(tests[status.lower()])
    return c


def id_score(query: Column, doc_id: Column, type_: Column) -> Column:
    """100 for the same identifier or a fragment of the same type and number, else 0."""
    hit = F.exists(fragments(query), lambda f: (f["prefix"] == type_) & (f["number"] == _number(doc_id)))
    return F.when((normal_id(query) == normal_id(doc_id)) | hit, F.lit(100.0)).otherwise(F.lit(0.0))


def _number(doc_id: Column) -> Column:
    return F.ltrim(F.split_part(doc_id, F.lit("-"), F.lit(-1)), F.lit("0"))


def title_tokens(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, t): the distinct tokens of each text."""
    return texts.select(F.col(key).alias("key"), F.explode(F.array_distinct(fuzzy_tokens(text))).alias("t"))


def near_tokens(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, t, r): tokens of queries (token) and of texts (t) whose similarity ``r`` is ``FLOOR`` or more.

    Lengths and the letters that only one side has bound the common subsequence from above; only
    pairs that these let pass, which loses none, are compared letter by letter.
    """
    asked = tokens.select("token").distinct().select("token", F.length("token").alias("n"), letter_mask("token").alias("m"), pattern("token").alias("p"))
    held = vocabulary.select("t").distinct().select("t", F.length("t").alias("tn"), letter_mask("t").alias("tm"))
    most = F.least(
        F.col("n") - F.bit_count(F.col("m").bitwiseAND(F.bitwise_not("tm"))), F.col("tn") - F.bit_count(F.col("tm").bitwiseAND(F.bitwise_not("m")))
    )
    # the queries' tokens are the stated side; Spark decides by its size how it travels
    met = held.crossJoin(asked).where(most * 200.0 >= FLOOR * (F.col("n") + F.col("tn")))
    common = F.when(F.col("n") <= PATTERN_MOST, lcs(F.col("p"), letters("t"))).otherwise(lcs_of_long("token", "t"))
    return met.select("token", "t", (common * F.lit(200.0) / (F.col("n") + F.col("tn"))).alias("r")).where(F.col("r") >= FLOOR)


def batch_token_scores(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, key, score) of texts with any score: length-weighted mean of each query token's best match among a text's ``tokens`` (key, t).

    Similarity is computed once for each distinct pair of tokens, not once a text or a query (q, query).
    """
    asked = queries.select("q", F.posexplode(fuzzy_tokens("query", stop=True)).alias("i", "token"))
    total = asked.groupBy("q").agg(F.sum(F.length("token")).alias("total"))
    best = tokens.join(near_tokens(tokens, asked), "t").groupBy("key", "token").agg(F.max("r").alias("r"))
    won = best.join(asked, "token").groupBy("q", "key").agg(F.sum(F.length("token") * F.col("r")).alias("won"))
    return won.join(total, "q").select("q", "key", (F.col("won") / F.col("total")).alias("score"))


def token_scores(texts: DataFrame, query: str, key: str = "key", text: str = "text") -> DataFrame:
    """(key, score) of every text for one query, 0 where nothing matches."""
    got = batch_token_scores(title_tokens(texts, key, text), _one(texts, query)).select(F.col("key").alias(key), "score")
    return texts.select(key).distinct().join(got, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def _one(df: DataFrame, query: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, query)], "q long, query string")


def by_identifier(c: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, doc_id, 100.0) of equal identifiers, and of fragments of the same type and number."""
    ids = c.select("doc_id", "type", _number(F.col("doc_id")).alias("number"))
    whole = queries.select("q", normal_id("query").alias("id")).join(ids.select("doc_id", normal_id("doc_id").alias("id")), "id").select("q", "doc_id", F.lit(100.0).alias("score"))
    parts = queries.select("q", F.inline(fragments("query"))).withColumnRenamed("prefix", "type").join(ids, ["type", "number"]).select("q", "doc_id", F.lit(100.0).alias("score"))
    return whole, parts


def type_scores(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """(q, type, score) by the types' names, capped."""
    names = spark.createDataFrame(list(TYPE_NAMES.items()), "key string, text string")
    return batch_token_scores(title_tokens(names), queries).select("q", F.col("key").alias("type"), F.least("score", F.lit(TYPE_CAP)).alias("score"))


def matches(c: DataFrame, queries: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(q, doc_id, score) of chains with any score for ``queries`` (q, query): the best of identifier, title and (capped) type-name matches.

    Every part is an equi-join: no chain is held against every query.  ``tokens``: the titles'
    tokens where they are written down already, ((doc_id, text), t).
    """
    whole, parts = by_identifier(c, queries)
    tokens = tokens_of(c) if tokens is None else tokens
    by_title = batch_token_scores(tokens, queries).select("q", "key.doc_id", "score").join(c.select("doc_id"), "doc_id", "left_semi").select("q", "doc_id", "score")
    by_type = c.select("doc_id", "type").join(type_scores(c.sparkSession, queries), "type").select("q", "doc_id", "score")
    every = whole.unionAll(parts).unionAll(by_title).unionAll(by_type)
    return every.groupBy("q", "doc_id").agg(F.max("score").alias("score"))


def tokens_of(c: DataFrame) -> DataFrame:
    """((doc_id, text), t): tokens of all revisions' titles, title by title."""
    titles = c.select("doc_id", F.explode(F.array_distinct(F.transform("revisions", lambda r: r["title"]))).alias("text"))
    return title_tokens(titles.select(F.struct("doc_id", "text").alias("key"), "text"))


def scored(c: DataFrame, query: str) -> DataFrame:
    """Every chain with ``score``, 0 where nothing matches."""
    return c.join(matches(c, _one(c, query)).drop("q"), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def search_catalog(
    documents: DataFrame, query: str | None = None, doc_type: str | None = None, status: str | None = None, sw_version: str | None = None, tokens: DataFrame | None = None
) -> DataFrame:
    """All matches (doc_id, type, title, latest_current, revisions, match_score), never truncated."""
    c = filtered(chains(documents), doc_type, status, sw_version)
    if not query:
        return c.orderBy("doc_id")
    hits = c.join(matches(c, _one(c, query), tokens).where(F.col("score") >= THRESHOLD).drop("q"), "doc_id")
    return hits.withColumn("match_score", F.bround("score").cast("int")).orderBy(F.desc("score"), "doc_id")


def closest_matches(documents: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The nearest chains over the whole catalog, filters ignored."""
    return scored(chains(documents), query).orderBy(F.desc("score"), "doc_id").limit(k).select("doc_id", "title", "score")
