"""Personal data by information-theoretic sanitisation (DataFrames only).

Base detectors find e-mail addresses, IP and card numbers and phones.  A term of
the text can give the same person away, so the corpus says how strongly: for a
protected entity e and a term t, with document counts over the whole corpus,

    disclosure(t, e) = PMI(t, e) / IC(e) = ln(n_te N / (n_t n_e)) / ln(N / n_e)

which is 1 where t occurs with e only.  In documents that hold e, terms at or above
``remove_at`` are removed and those at or above ``generalise_at`` replaced by a
class.  Counts of fewer than ``support`` documents, or of one text's copies, are no
evidence.

Positions are code points, end exclusive.  Per kind the leftmost non-overlapping
matches are taken and those that fail their check dropped, without retries.
Possessive quantifiers replace greedy ones where nothing follows them, which
matches the same and does not recurse on long runs.

Edge cases: a null text counts as empty; rows equal in id and text share one
analysis but each gets a row; null ids are kept; ids are of any type; terms of fewer
than ``TERM_CHARS`` characters are never taken; extra columns are not read; an empty
table is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.folds import emitting
from scrivia.llm.common import materialise, membership_filter, possible_members, quoted, release, table

KINDS = ("email", "ip", "card", "phone")
_MAIL = "A-Za-z0-9._%+-"
# Kinds: (a character any match holds, pattern).
_PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!$)|$)){4}$"
GENERALISE_AT, REMOVE_AT, SUPPORT, TERM_CHARS = 0.8, 0.95, 2, 3
_WORD = r"[\p{L}\p{N}]"
_SPAN = "struct<s:int,e:int,v:string>"


def _spans(text: Column, pattern: Column, needs: str | None) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches; linear in their number."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, gaps, lambda v, g: F.struct(F.length(g).alias("g"), v.alias("v")))

    def step(at, x):
        start, end = at + x["g"], at + x["g"] + F.length(x["v"])
        return F.coalesce(end, at), x["v"].isNotNull(), F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"))

    spans = emitting(steps, F.lit(0), step, _SPAN)
    none = F.array().cast(f"array<{_SPAN}>")
    return spans if needs is None else F.when(F.contains(text, F.lit(needs)), spans).otherwise(none)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def _holds(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(_OCTETS)
    n = F.length(_digits(v))
    if kind == "card":
        return F.when((n < 16) | (n > 19), F.lit(False)).otherwise(luhn(_digits(v)))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one column per kind: array<struct<s, e, v>> in order of start."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select("*", *[_spans(body, F.lit(p), needs).alias(f"raw_{k}") for k, (needs, p) in _PATTERNS.items()])
    return raw.select(
        *docs.columns, *[F.filter(f"raw_{k}", lambda x: _holds(k, x["v"])).alias(k) for k in KINDS]
    )


def _written(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _terms(text: str) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{_WORD}{{{TERM_CHARS},}}"), F.lit(0)))
    return words


def disclosing_terms(
    docs: DataFrame, held: DataFrame, generalise_at: float = GENERALISE_AT, support: int = SUPPORT
) -> tuple[DataFrame, DataFrame]:
    """((entity, term, disclosure), (key, text_hash, entity, term)): terms that give recurring entities away, and
    where they may stand.

    ``docs`` (text) is the corpus, ``held`` (key, text_hash, text, entities) its documents with entities.
    """
    each = held.select("key", "text_hash", F.explode(F.array_distinct("entities")).alias("entity"))
    mark = F.xxhash64("key")
    often = each.groupBy("entity").agg(
        F.count("*").alias("n_e"), F.min("text_hash").alias("a"), F.max("text_hash").alias("z"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s")
    )
    often = often.where((F.col("n_e") >= support) & (F.col("a") < F.col("z")))
    # entities of the very same documents are one, told by the least
    often = often.groupBy("n_e", "x", "s").agg(F.min("entity").alias("entity"))
    n = docs.count()
    # PMI / IC reaches the threshold only for terms in so few documents
    most = F.lit(float(n)) ** (1.0 - generalise_at) * F.col("n_e") ** generalise_at + 1e-6
    often = materialise(often.select("entity", "n_e", most.alias("most")), "pii-entities")
    of = materialise(each.join(often, "entity"), "pii-held")
    pairs = _pairs(of, held, support)
    met = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.min("text_hash").alias("a"), F.max("text_hash").alias("z"))
    met = materialise(met.where((F.col("n_te") >= support) & (F.col("a") < F.col("z"))).select("entity", "term", "n_te"), "pii-met")
    # how often those terms occur in the whole corpus; a filter of fixed size keeps other words in their task
    filt = membership_filter(met, "term", "pii-filter")
    words = docs.select(F.explode(_terms("text")).alias("term"))
    n_t = possible_members(words, F.col("term"), filt).groupBy("term").agg(F.count("*").alias("n_t"))
    scored = met.join(often, "entity").join(materialise(n_t, "pii-terms"), "term")
    pmi = F.log(F.col("n_te") * float(n) / (F.col("n_t") * F.col("n_e").cast("double")))
    scored = scored.withColumn("disclosure", F.when(F.col("n_e") < n, pmi / F.log(F.lit(float(n)) / F.col("n_e"))))
    reveals = materialise(scored.where(F.col("disclosure") >= generalise_at).select("entity", "term", "disclosure"), "pii-reveals")
    release(of, met, filt.rows)
    return reveals, pairs


def _pairs(of: DataFrame, held: DataFrame, support: int) -> DataFrame:
    """(key, text_hash, entity, term) of the terms of each document that can give one of its entities away: in
    ``support`` documents with entities at least, and in no more than ``of.most``."""
    keys = of.select("key").distinct()
    terms = materialise(held.join(keys, "key", "left_semi").select("key", F.explode(_terms("text")).alias("term")), "pii-words")
    df = materialise(terms.groupBy("term").agg(F.count("*").alias("n_h")).where(F.col("n_h") >= support), "pii-word-counts")
    few = terms.join(df, "term")
    pairs = materialise(of.join(few, "key").where(F.col("n_h") <= F.col("most")).select("key", "text_hash", "entity", "term"), "pii-pairs")
    release(terms, df)
    return pairs


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row per document: doc_id, a column of spans per kind, and ``terms``
    (array<struct<s, e, v, action>>) that disclose its entities."""
    docs = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    entities = F.concat(*[F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), F.lower(x["v"]))) for k in KINDS])
    base = base_spans(docs).select(
        "doc_id",
        F.struct("doc_id", F.xxhash64("text").alias("a"), F.crc32("text").alias("b")).alias("key"),
        F.xxhash64("text").alias("text_hash"),
        *KINDS,
        entities.alias("entities"),
        "text",
    )
    base = base.withColumn("text", F.when(F.size("entities") > 0, F.col("text")))
    base = materialise(base, "pii-base")
    # rows equal in id and text are one document here
    held = base.where(F.size("entities") > 0).select("key", "text_hash", "text", "entities").dropDuplicates(["key"])
    held = materialise(held, "pii-documents")
    reveals, pairs = disclosing_terms(docs, held, generalise_at)

    filt = membership_filter(reveals.select(F.struct("entity", "term").alias("et")), "et", "pii-reveal-filter")
    told = possible_members(pairs, F.struct("entity", "term"), filt).join(reveals, ["entity", "term"])
    told = told.groupBy("key", "term").agg(F.max("disclosure").alias("d"))
    told = told.groupBy("key").agg(
        F.array_sort(F.collect_list("term")).alias("all_terms"),
        F.collect_set(F.when(F.col("d") >= remove_at, F.col("term"))).alias("gone"),
    )
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_WORD})(?:"), F.array_join("all_terms", "|"), F.lit(rf")(?!{_WORD})"))
    covered = F.concat(*KINDS)
    spots = told.join(held.select("key", "text"), "key").join(base.select("key", *KINDS).dropDuplicates(["key"]), "key")
    spots = spots.select(
        "key", "gone", covered.alias("covered"), _spans(F.col("text"), pattern, None).alias("spots")
    )
    terms = F.transform(
        F.filter("spots", lambda x: ~F.exists("covered", lambda c: (c["s"] < x["e"]) & (x["s"] < c["e"]))),
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"),
            F.when(F.array_contains("gone", F.lower(x["v"])), "remove").otherwise("generalise").alias("action"),
        ),
    )
    spots = materialise(spots.select("key", terms.alias("terms")), "pii-spots")
    none = F.array().cast("array<struct<s:int,e:int,v:string,action:string>>")
    return base.join(spots, "key", "left").select("doc_id", "text_hash", *KINDS, F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id and the text with entities replaced by their kind, terms removed or generalised."""
    found = find_pii(docs, text, doc_id, **options)
    each = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{k}>").alias("r"))) for k in KINDS]
    each.append(
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["action"] == "remove", "").otherwise("<term>").alias("r")))
    )
    edits = F.array_sort(F.concat(*each))
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    src = docs.select(F.col(quoted(doc_id)).alias("doc_id"), body.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = found.select("doc_id", "text_hash", edits.alias("edits")).dropDuplicates(["doc_id", "text_hash"])
    found = found.withColumnsRenamed({"doc_id": "__d", "text_hash": "__t"})
    joined = src.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left")
    # overlapping kinds: the later one starts where the earlier ended
    done = F.aggregate(
        "edits",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"]).otherwise(
                F.concat(a["out"], F.substring("text", a["at"] + 1, x["s"] - a["at"]), x["r"])
            ).alias("out"),
        ),
    )
    return joined.select(
        "doc_id",
        F.when(F.col("edits").isNull(), F.col("text"))
        .otherwise(F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text"))))
        .alias("text"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.concat(*[_written(F.col(k), k) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written(F.col("terms"), "term")), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
