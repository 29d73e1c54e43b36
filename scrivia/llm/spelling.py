"""Spelling variants by the rare-first q-gram prefix filter.

Words are runs of Latin letters (``noisy_runs`` is the reading of a run; without it every run
stands for itself) with at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.
A word's bigrams carry their positions and are ordered by how rare the bigram is among
all words (ties: the bigram, then its position; the order must not depend on positions, as an
edit shifts them).  One edit touches at most two bigrams, so of the *three* rarest bigrams
of either word at least one is met by the other's three, not more than one position off.  Only
these are joined.  The join's key also holds the shorter word's length and the two thirds of
the word that one edit must leave alone, its first, its last or its outer letters: that loses
no pair and parts a bigram's group into small ones.  Pairs met are verified by edit distance.

A word's form is its most frequent near word, if that is ``RATIO`` times as frequent; roots
follow forms to their end by doubling, as counts grow tenfold with each step.

Edge cases: null texts have no words; a null doc_id reads as an empty one; repeated rows
count again; runs of any length are read whole; ids are of any type; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import materialise, quoted, release, table

LETTER = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, NOISE = 7, 2, 10, 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a task looks into on average.
WORDS_A_TASK = 1 << 16
#: One edit touches at most two bigrams: the three rarest cannot all be touched.
PREFIX = 3


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    # lower() would change accented capitals, but is far quicker where there are none
    return F.when(run.rlike(r"[À-ÿ]"), F.translate(run, _UPPER, _LOWER)).otherwise(F.lower(run))


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 1) -> DataFrame:
    """(doc_id: string, run) of every maximal run, of ``least_length`` letters or more, of every whole text."""
    src = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("")).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return src.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))


def noisy_runs(found: DataFrame, every: int = NOISE) -> DataFrame:
    """Runs as read with a typing error: where ``every`` divides h, the CRC-32 of ``doc_id:run``, code point h % length is left out."""
    hashed = found.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run")).alias("h"), F.char_length("run").alias("len"))
    gone = F.expr("concat(substring(run, 1, cast(h % len as int)), substring(run, cast(h % len as int) + 2))")
    return hashed.select(F.when(F.col("h") % every == 0, gone).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs that count as words."""
    counted = found.where(F.char_length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def rare_bigrams(words: DataFrame, keep: int = PREFIX) -> DataFrame:
    """(word, len, odd, gram, pos): the ``keep`` rarest bigrams of each word with their positions.

    ``odd`` has a bit for each code point (modulo 64) that the word holds an odd number of times.
    """
    # by word, and in parts that follow their number: the window below needs no other shuffle
    dealt = words.repartition(1 + words.count() // WORDS_A_TASK, "word")
    letters = dealt.select("word", F.char_length("word").alias("len"), F.split("word", "").alias("c"))
    odd = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 64)))
    # over the array of letters: substring would read a word from its start for each position
    grams = F.transform(F.sequence(F.lit(0), F.col("len") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))
    each = letters.where("len > 1").select("word", "len", odd.alias("odd"), F.posexplode(grams).alias("pos", "gram"))
    # bigrams of an alphabet of 90 letters: 8,100 rows at most
    rarity = materialise(each.groupBy("gram").agg(F.count("*").alias("f")), "spelling-bigrams", parts=1)
    w = Window.partitionBy("word").orderBy("f", "gram", "pos")
    ranked = each.join(F.broadcast(rarity), "gram").withColumn("at", F.row_number().over(w))
    return ranked.where(F.col("at") <= keep).select("word", "len", "odd", "gram", "pos")


def _keyed(rare: DataFrame, lengths: list[Column]) -> DataFrame:
    """Rows with ``key`` for each length in ``lengths`` that the shorter word of a pair may have, and each of its ends."""
    each = rare.withColumn("short", F.explode(F.array(*lengths))).withColumn("c", F.expr("short div 3"))
    # an edit in the first third of the shorter word leaves what follows, one in the last third what comes before, another both outer thirds
    ends = F.array(F.expr("concat('<', left(word, short - c))"), F.expr("concat('>', right(word, short - c))"), F.expr("concat(left(word, c), '|', right(word, c))"))
    return each.withColumn("end", F.explode(ends)).withColumn("key", F.xxhash64("gram", "short", "end"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of the written ``words`` (word, at least three letters long) that differ by exactly one edit; each pair once."""
    rare = materialise(rare_bigrams(words), "spelling-rare")
    a = _keyed(rare, [F.col("len")]).select("key", F.col("pos").alias("pa"), F.col("odd").alias("oa"), F.col("len").alias("la"), F.col("word").alias("a"))
    b = _keyed(rare, [F.col("len"), F.col("len") - 1]).select("key", F.col("pos").alias("pb"), F.col("odd").alias("ob"), F.col("len").alias("lb"), F.col("word").alias("b"))
    met = a.join(b.hint("merge"), "key").where(F.abs(F.col("pa") - F.col("pb")) <= 1)
    # one edit changes how often at most two letters occur
    met = met.where(F.bit_count(F.col("oa").bitwiseXOR(F.col("ob"))) <= 2).where((F.col("lb") > F.col("la")) | (F.col("a") < F.col("b")))
    pairs = materialise(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct(), "spelling-pairs")
    release(rare)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the written ``forms`` (word, form), which hold no cycle."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialise(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(now)
        now = further
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the written ``words`` (word, n)."""
    pairs = near_pairs(words.select("word"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(pairs.select("b", "a")).join(counts, "near")
    # least: most occurrences, then first in code-point order
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("form"), F.max("near_n").alias("form_n"))
    held = F.col("form_n") >= ratio * F.col("n")
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("form")).alias("form"), F.when(held, F.col("form_n")).alias("form_n")
    )
    told = materialise(told, "spelling-forms")
    release(pairs)
    ended = roots(told.where("form is not null"))
    return told.join(ended, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialise(vocabulary(noisy_runs(runs(table(spark, sf_dir, "documents"), least_length=LEAST_LENGTH))), "spelling-words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


#: CRC-32 over the UTF-8 bytes, code points being below 256; near words meet at a common word with one letter less.
OP11_SQL = f"""WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
met AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))),
    lambda s, b: xor(s >> 8, {_crc_table()}[xor(s & 255, b) + 1]))) AS h FROM met),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT DISTINCT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM pairs JOIN words ON words.word = b GROUP BY a),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM told UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.root WHERE told.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN told ON told.word = chain.root WHERE told.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)"""
