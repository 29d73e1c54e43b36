"""Column expressions over names and text: filename parsing, tokens, labels, similarity."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier, revision and version shapes of the collection's file names.
ID_SHAPE = r"^(IFU-MX1|[A-Z0-9]{2,4}(?:-[A-Z0-9]+)*?-\d+)"
TAIL_SHAPE = r"_\s*([A-Z])\s*(?:[-_]\s*([A-Za-z]+))?\s*$"
COPY_SHAPE = r"\(\d+\)\s*$"
VERSION_SHAPE = r"v\d+\.\d+(?:\.\d+)?(?:-\w+)?"
FRAGMENT_SHAPE = r"\b([A-Za-z0-9]{2,4})[\s._-]*(?:[Pp]0\d[\s._-]*)?(\d{2,4})\b"
CITATION_SHAPE = r"\[([A-Z0-9][A-Za-z0-9-]*)\s+Rev\.?\s+([A-Z0-9.]+)"
# Words that are no evidence in a catalog query.
STOPWORDS = ("the", "a", "an", "of", "for", "and", "or", "to", "in", "with", "mx1", "system")
# Combining marks that are part of a token and leave no trace in it.
MARKS = "".join(map(chr, (
    0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B,
    0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331,
)))


def _folded() -> dict[str, str]:
    """Latin letters that are a letter of a-z with one mark, the long s, and the micro sign as the Greek letter it is.

    Letters with two marks keep both, as do letters that stand on another one than a-z.
    """
    out = {"ſ": "s", "ẛ": "s", "µ": "μ"}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) == 2 and apart[0] in ascii_lowercase:
            out[c] = apart[0]
    return out


_FOLDED = _folded()
#: ``translate(x, MARKED, PLAIN)`` folds letters with a mark and drops marks that stand for themselves.
MARKED, PLAIN = "".join(_FOLDED) + MARKS, "".join(_FOLDED.values())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract(x, shape: str, group: int) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(_c(x), shape, group), F.lit(""))


def parse_filename(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Adds doc_id (null: no identifier), type_prefix, title, revision, is_signed, is_obsolete,
    is_duplicate, sw_version and warning."""
    stem = F.trim(F.regexp_replace(_c(filename), r"\.docx$", ""))
    df = files.withColumn("__stem", stem).withColumn("is_duplicate", F.col("__stem").rlike(COPY_SHAPE))
    df = df.withColumn("__stem", F.trim(F.regexp_replace("__stem", COPY_SHAPE, "")))
    df = df.withColumn("doc_id", extract("__stem", ID_SHAPE, 1))
    df = df.withColumn("__rest", F.substring("__stem", F.length("doc_id") + 1, F.length("__stem")))
    df = df.withColumn("revision", extract("__rest", TAIL_SHAPE, 1)).withColumn("__mark", extract("__rest", TAIL_SHAPE, 2))
    status = F.lower("__mark")
    title = F.trim(F.ltrim(F.trim(F.regexp_replace("__rest", TAIL_SHAPE, "")), F.lit("-")))
    df = df.withColumns(
        {
            "type_prefix": F.split_part("doc_id", F.lit("-"), F.lit(1)),
            "title": F.regexp_replace(title, r"\s{2,}", " "),
            "is_signed": F.coalesce(status == "signed", F.lit(False)),
            "is_obsolete": F.coalesce(status == "obsolete", F.lit(False)),
            "warning": F.when(~status.isin("signed", "obsolete"), F.concat(F.lit("unknown status suffix '"), "__mark", F.lit("'"))),
        }
    )
    return df.withColumn("sw_version", extract("title", VERSION_SHAPE, 0)).drop("__stem", "__rest", "__mark")


def squeeze(x) -> Column:
    """Unicode blanks collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def cell(x) -> Column:
    return F.replace(squeeze(x), F.lit("|"), F.lit("\\|"))


def heading_label(path) -> Column:
    """Heading parts over 80 characters cut to 79 and an ellipsis, joined; ``body`` where there are none."""
    parts = F.transform(_c(path), lambda p: F.when(F.length(p) > 80, F.concat(F.substring(p, 1, 79), F.lit("…"))).otherwise(p))
    return F.coalesce(F.nullif(F.array_join(parts, " > "), F.lit("")), F.lit("body"))


def normal_id(x) -> Column:
    return F.regexp_replace(F.upper(_c(x)), "[^A-Z0-9]", "")


def revision_key(rev) -> Column:
    """A < ... < Z < AA; no revision first."""
    return F.struct(F.length(_c(rev)).alias("n"), _c(rev).alias("r"))


def word_tokens(x) -> Column:
    """Index tokens: runs of letters, digits and private letters, lower-cased, without marks; a mark parts no run."""
    return F.regexp_extract_all(F.translate(F.lower(_c(x)), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def query_terms(x) -> Column:
    """Keyword-query terms: ASCII runs, in order, repeats kept."""
    return F.regexp_extract_all(_c(x), F.lit("[A-Za-z0-9]+"), F.lit(0))


def fuzzy_tokens(x, stop: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS)) if stop else found


def fragments(x) -> Column:
    """array<struct<prefix, number>> of identifier fragments, leading zeros dropped."""
    first = F.regexp_extract_all(_c(x), F.lit(FRAGMENT_SHAPE), F.lit(1))
    second = F.regexp_extract_all(_c(x), F.lit(FRAGMENT_SHAPE), F.lit(2))
    return F.transform(
        F.arrays_zip(first.alias("p"), second.alias("n")),
        lambda z: F.struct(F.upper(z["p"]).alias("prefix"), F.ltrim(z["n"], F.lit("0")).alias("number")),
    )


#: Letters that a pattern of ``lcs`` has at most: a sum of two such numbers stays within a long.
PATTERN_MOST = 62


def letters(x) -> Column:
    """The code points of a string, one by one."""
    return F.filter(F.split(_c(x), ""), lambda c: c != "")


def letter_mask(x) -> Column:
    """A bit for each letter (its number modulo 64) that a string holds."""
    one = F.lit(1).cast("long")
    return F.aggregate(letters(x), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(F.call_function("shiftleft", one, F.ascii(c) % 64)))


def pattern(x) -> Column:
    """A string of at most ``PATTERN_MOST`` letters as ``lcs`` takes it: its distinct letters, and the bits of their places."""
    chars = letters(x)
    places = F.transform(
        F.array_distinct(chars),
        lambda c: F.aggregate(chars, F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("at")),
                              lambda s, y: F.struct(F.when(c == y, s["bits"].bitwiseOR(s["at"])).otherwise(s["bits"]).alias("bits"), F.shiftleft(s["at"], 1).alias("at")), lambda s: s["bits"]),
    )
    return F.struct(F.array_distinct(chars).alias("of"), places.alias("bits"), F.length(_c(x)).alias("n"))


def lcs(p: Column, chars: Column) -> Column:
    """Length of the longest common subsequence of a ``pattern`` and letters: a whole row of the table is one long.

    A zero bit of ``v`` is a place where the row grows by one; each letter is a sum and some masks.
    """
    # what is carried out of the pattern's bits is cut off
    full = F.call_function("shiftleft", F.lit(1).cast("long"), p["n"]) - 1
    start = F.struct(p["of"].alias("of"), p["bits"].alias("bits"), full.alias("full"), full.alias("v"))

    def step(s, c):
        v, m = s["v"], F.coalesce(F.get(s["bits"], (F.array_position(s["of"], c) - 1).cast("int")), F.lit(0).cast("long"))
        row = (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(s["full"])
        return F.struct(s["of"].alias("of"), s["bits"].alias("bits"), s["full"].alias("full"), row.alias("v"))

    return p["n"] - F.aggregate(chars, start, step, lambda s: F.bit_count(s["v"]))


def indel_ratio(a, b) -> Column:
    """200 LCS / (|a| + |b|): 100 for equal strings."""
    a, b = _c(a), _c(b)
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    total = F.length(a) + F.length(b)
    found = F.when(F.length(short) <= PATTERN_MOST, lcs(pattern(short), letters(long_))).otherwise(lcs_of_long(a, b))
    return F.when(total == 0, F.lit(100.0)).when(F.length(short) == 0, F.lit(0.0)).otherwise(found * F.lit(200.0) / total)


def lcs_of_long(a, b) -> Column:
    """The same of two strings too long for a pattern: a row of the table is an array."""
    a, b = _c(a), _c(b)
    bs = F.sequence(F.lit(1), F.length(b))
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev, i):
        def step(cur, j):
            same = F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))
            return F.concat(
                cur, F.array(F.when(same, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.element_at(cur, -1))))
            )

        return F.aggregate(bs, F.array(F.lit(0)), step)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(a)), zero, row), -1)


def embed_text(doc_id, revision, title, section, text) -> Column:
    """A chunk with its provenance, as it is embedded."""
    head = F.concat(_c(doc_id), F.lit(" Rev "), F.coalesce(F.nullif(_c(revision), F.lit("")), F.lit("—")), F.lit(" — "), _c(title))
    return F.concat(head, F.when(_c(section) != "", F.concat(F.lit("\n§ "), _c(section))).otherwise(""), F.lit("\n---\n"), _c(text))
