"""Many questions at once where nearly every text scores something: scores of a block of texts, best ones kept.

The scores are as many as questions times texts by nature.  They never become rows: a task holds
the scores of some questions and one block of texts, or what bounds them, in an array of bounded size and gives each question's best.
Texts that one block has ahead of another are ahead of it in the end, so none of the ``k`` best is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions.text import fuzzy_tokens
from scrivia.operators import catalog
from scrivia.operators.content import K1, PER_DOC, B
from scrivia.operators.early_stop import WINDOW, Blocks, ranked, weights
from scrivia.storage import materialise, release

#: Token sets of a block of titles, chunk numbers of a block of chunks (whole windows), questions that a task has of titles (scores of chunks it holds of a quarter of them).
SETS, CHUNKS, ASKED = 65536, 128 * WINDOW, 1024
#: Different tokens whose similar words a task holds; numbers of an array made on the way.
TOKENS, CELLS = 4096, 1 << 22


class _Words:
    """The words of a block of titles, by length, and which of them resemble a token."""

    def __init__(self, words: list):
        import numpy as np

        self.letters, self.counts = _table(words)
        self.lengths = self.counts.sum(axis=1)
        self.at = np.ascontiguousarray(self.letters.T)
        # product with ``_levels`` of tokens: letters in common, at most
        self.levels = np.concatenate([*(self.counts >= i for i in (1, 2, 3)), np.maximum(self.counts - 3, 0)], axis=1, dtype=np.float32, casting="unsafe")

    def near(self, tokens: list, floor: float) -> dict:
        """token -> (places of words, similarity) where it is ``floor`` or more."""
        import numpy as np

        found: dict = {}
        for t in tokens:
            if len(t) > 62:
                row = _cells(self.letters, self.counts, self.lengths, t, floor)
                at = row.nonzero()[0]
                found[t] = (at.astype(np.int32), row[at])
        short = [t for t in tokens if len(t) <= 62]
        if not short:
            return found
        letters, counts = _table(short)
        n = counts.sum(axis=1)
        # at least once, twice, three times in both; beyond three, what the word has more
        of = np.concatenate([counts >= 1, counts >= 2, counts >= 3, counts > 3], axis=1)
        both = of.any(axis=0) & self.levels.any(axis=0)
        left = np.concatenate([self.levels[:, both], np.stack([self.lengths, np.ones(len(self.lengths))], axis=1)], axis=1, dtype=np.float32, casting="unsafe")
        right = np.concatenate([of[:, both], np.stack([np.full(len(n), -floor / 200), -floor / 200 * n], axis=1)], axis=1, dtype=np.float32, casting="unsafe")
        slack = 1e-5 * (self.lengths[-1] + n.max())
        step = min(max(1, CELLS // len(self.lengths)), 1 << 14)
        for i in range(0, len(short), step):
            some = slice(i, i + step)
            pairs = np.flatnonzero(left @ right[some].T >= -slack)
            for t, got in zip(short[some], self._pairs(pairs, letters[some], n[some], floor)):
                found[t] = got
        return found

    def _pairs(self, pairs, letters, n, floor: float):
        """For each token those of the ``pairs`` (word times tokens plus token) that reach ``floor``."""
        import numpy as np

        word, of = (x.astype(np.int32) for x in np.divmod(pairs, len(n)))
        kind = np.uint32 if letters.shape[1] <= 31 else np.uint64  # one bit is carried
        bits = np.zeros((len(n), 37), kind)
        for j in range(letters.shape[1]):
            has = np.flatnonzero(letters[:, j] < 36)
            bits[has, letters[has, j]] |= kind(1 << j)
        bits, base, size = bits.ravel(), of * 37, self.lengths[word]
        ones = np.array([(1 << int(x)) - 1 for x in n], kind)
        full = ones[of]
        v = full.copy()
        for first in range(0, len(word), 1 << 14):
            some = slice(first, first + (1 << 14))
            # words come by length: the last ones have another letter
            for j, a in enumerate(np.searchsorted(size[some], np.arange(size[some][-1]), "right")):
                rest = slice(first + a, some.stop)
                m = bits.take(base[rest] + self.at[j].take(word[rest], mode="clip"), mode="clip")
                x = v[rest]
                u = x & m
                v[rest] = ((x + u) | (x ^ u)) & full[rest]
        r = (n[of] - np.bitwise_count(v)) * 200.0 / (n[of] + size)
        kept = np.flatnonzero(r >= floor)
        kept = kept[np.argsort(of[kept].astype(np.int16), kind="stable")]
        word, r = word[kept].astype(np.int32), r[kept]
        ends = np.searchsorted(of[kept], np.arange(len(n) + 1))
        return [(word[a:b], r[a:b]) for a, b in zip(ends, ends[1:])]


def _table(words: list):
    """Letters of words by number, 36 where a word has ended, and how often each occurs."""
    import numpy as np

    number = np.full(256, 36, np.int8)
    number[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = range(36)
    held = np.array(words, "S")
    letters = number[held.view(np.uint8).reshape(len(words), -1)]
    return letters, np.stack([(letters == i).sum(axis=1) for i in range(36)], axis=1)


def _cells(codes, counts, lengths, token: str, floor: float):
    """Similarity of ``token`` to each word (``codes``: letters by number, ``counts``: of each letter), 0 below ``floor``."""
    import numpy as np

    n, out = len(token), np.zeros(len(lengths))
    own = np.bincount([int(c, 36) for c in token], minlength=36)
    some = np.flatnonzero(own)
    # no more letters in common than both have
    most = np.minimum(counts[:, some], own[some]).sum(axis=1, dtype=np.int64)
    at = np.flatnonzero(most * 200.0 >= floor * (n + lengths))
    if not len(at):
        return out
    kind = np.uint64 if n <= 62 else object  # Python's own numbers have no end
    bits = np.zeros(37, kind) if kind is np.uint64 else np.array([0] * 37, object)
    for i, c in enumerate(token):
        bits[int(c, 36)] |= kind(1 << i) if kind is np.uint64 else 1 << i
    full = kind((1 << n) - 1) if kind is np.uint64 else (1 << n) - 1
    v = np.full(len(at), full, kind)
    for j in range(int(lengths[at].max())):
        m = bits[codes[at, j]]
        u = v & m
        v = ((v + u) | (v - u)) & full
    common = n - (np.bitwise_count(v).astype(np.int64) if kind is np.uint64 else np.array([x.bit_count() for x in v]))
    r = common * 200.0 / (n + lengths[at])
    out[at] = np.where(r >= floor, r, 0.0)
    return out


def _first(scores, groups, k: int, each: int):
    """Columns of the best of ``scores`` (0: none), ties to smaller columns, at most ``each`` of a group, until ``k`` are found."""
    import numpy as np

    rounded = np.round(scores, 9)
    held = np.flatnonzero(scores > 0)
    take = 8 * k
    while True:
        if len(held) > take:
            cut = np.partition(rounded[held], len(held) - take)[len(held) - take]
            some = held[rounded[held] >= cut]
        else:
            some = held
        found, seen = [], {}
        for c in some[np.argsort(-rounded[some], kind="stable")]:
            g = groups[c]
            seen[g] = seen.get(g, 0) + 1
            if seen[g] <= each:
                found.append(c)
                if len(found) == k:
                    return found
        if len(some) == len(held):
            return found
        take *= 8


def nearest_titles(c: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, score): by titles, what may be among the ``k`` best of ``queries`` (q, query), as ``catalog.matches`` scores them.

    Titles of equal token sets score alike, so such a set is scored once, and its ``k`` first documents stand for all.
    A task takes a block of sets, which share their longest words where they can, and a group of questions; a set is scored only if what its words score one by one,
    which is no less in sum, reaches the ``k``-th best.
    """
    titles = c.select("doc_id", F.explode(F.array_distinct(F.transform("revisions", lambda r: r["title"]))).alias("text"))
    sets = titles.select("doc_id", F.array_sort(F.array_distinct(fuzzy_tokens("text"))).alias("ts")).where(F.size("ts") > 0).distinct()
    place = F.row_number().over(Window.partitionBy("ts").orderBy("doc_id"))
    sets = sets.withColumn("place", place).where(F.col("place") <= k).groupBy("ts").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    loose = materialise(sets, "catalog-sets")
    longest = F.array_max(F.transform("ts", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    dealt = loose.repartitionByRange(max(1, -(-loose.count() // SETS)), longest, "ts").withColumn("block", F.spark_partition_id())
    sets = materialise(dealt, "catalog-blocks")
    release(loose)
    numbers = materialise(sets.select("block").distinct(), "catalog-numbers")
    asked = queries.select("q", fuzzy_tokens("query", stop=True).alias("tokens")).where(F.size("tokens") > 0)
    asked = materialise(asked, "catalog-asked")
    spark = c.sparkSession
    blocks = max(1, numbers.count())
    groups = max(1, -(-asked.count() // ASKED), -(-3 * spark.sparkContext.defaultParallelism // blocks))
    held = sets.crossJoin(spark.range(groups).select(F.col("id").alias("part")))
    every = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(groups))).crossJoin(numbers)
    floor = catalog.FLOOR

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: tuple = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.take(pc.sort_indices(pc.list_element(left["docs"], 0)))
            first, docs = pc.list_element(left["docs"], 0).to_pylist(), left["docs"].combine_chunks()
            sizes = pc.list_value_length(left["ts"]).to_numpy().astype(np.int64)
            flat = pc.list_flatten(left["ts"]).combine_chunks().dictionary_encode()
            words = flat.dictionary.to_pylist()
            order = np.argsort([len(w) for w in words], kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            block = _Sets(_Words([words[i] for i in order]), number[flat.indices.to_numpy()], sizes, first)
            asks = sorted(zip(right["q"].to_pylist(), right["tokens"].to_pylist()))
            near: dict = {}
            for some in _batched(asks, TOKENS):
                wanted = sorted({t for _, tokens in some for t in tokens})
                near = {t: near[t] for t in wanted if t in near}
                near |= block.words.near([t for t in wanted if t not in near], floor)
                for q, tokens in some:
                    at, scores = block.best(tokens, near, k)
                    # sets with k first documents ahead of them add nothing, whatever other documents they have
                    got: dict = {}
                    for i in _ahead(scores, [first[s] for s in at], k):
                        for d in docs[int(at[i])].as_py():
                            got[d] = max(got.get(d, 0.0), scores[i])
                    for d in sorted(got, key=lambda d: (-round(got[d], 9), d))[:k]:
                        for x, y in zip(out, (q, d, got[d])):
                            x.append(y)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.float64()))], names=["q", "doc_id", "score"])

    sides = [x.repartition(blocks * groups, "block", "part").groupBy("block", "part") for x in (held, every)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "q long, doc_id string, score double")


def _batched(asks: list, most: int):
    """Questions in turn, together until they have ``most`` different tokens."""
    some, seen = [], set()
    for q, tokens in asks:
        if some and len(seen.union(tokens)) > most:
            yield some
            some, seen = [], set()
        some.append((q, tokens))
        seen.update(tokens)
    if some:
        yield some


class _Sets:
    """A block of token sets, by first document: words by place (``flat``, ``sizes`` a set)."""

    def __init__(self, words: _Words, flat, sizes, first: list):
        import numpy as np

        self.words, self.flat, self.sizes, self.first = words, flat, sizes, first
        self.starts = np.cumsum(sizes) - sizes
        self.column = np.full(len(words.lengths), -1)

    def best(self, tokens: list, near: dict, k: int):
        """(sets, scores): all sets that score as the one with which ``k`` different first documents are found, or more; others may be there too."""
        import numpy as np

        weight: dict = {}
        for t in tokens:
            weight[t] = weight.get(t, 0) + len(t)
        weight = {t: n for t, n in weight.items() if len(near[t][0])}
        if not weight:
            return np.zeros(0, np.int64), np.zeros(0)
        total = sum(map(len, tokens))
        word = np.concatenate([near[t][0] for t in weight])
        r = np.concatenate([near[t][1] for t in weight])
        token = np.repeat(np.arange(len(weight)), [len(near[t][0]) for t in weight])
        n = np.array(list(weight.values()), np.float64)
        alone = np.bincount(word, n[token] * r, len(self.column))
        most = np.add.reduceat(alone[self.flat], self.starts) / total
        ahead, scores, least, size = np.zeros(0, np.int64), np.zeros(0), 0.0, 8 * k
        left = np.flatnonzero(most > 0)
        while len(left):
            some = left
            if len(left) > size:
                some = left[np.argpartition(-most[left], size)[:size]]
            # a set's bound and its score are rounded differently
            ahead = np.concatenate([ahead, some])
            scores = np.concatenate([scores, self._scores(some, word, r, token, n) / total])
            order = np.argsort(ahead)
            ahead, scores = ahead[order], scores[order]
            found = _first(scores, [self.first[s] for s in ahead], k, 1)
            if len(found) == k:
                least = round(scores[found[-1]], 9)
            if some is left:
                break
            waiting = np.ones(len(most), bool)
            waiting[ahead] = False
            left = left[waiting[left] & (most[left] >= least - 1e-6)]
            size *= 4
        return ahead, scores

    def _scores(self, sets, word, r, token, n):
        """Sums over the tokens of the best similarity among a set's words, times ``n``."""
        import numpy as np

        out = np.zeros(len(sets))
        ends = np.cumsum(self.sizes[sets])
        a = 0
        while a < len(sets):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS // len(n), "right")))
            sizes = self.sizes[sets[a:b]]
            starts = np.cumsum(sizes) - sizes
            at = self.flat[np.repeat(self.starts[sets[a:b]] - starts, sizes) + np.arange(sizes.sum())]
            # only what is near to these sets' words
            some, place = np.unique(at, return_inverse=True)
            self.column[some] = np.arange(len(some))
            column = self.column[word]
            held = np.flatnonzero(column >= 0)
            cells = np.zeros((len(n), len(some)))
            cells[token[held], column[held]] = r[held]
            self.column[some] = -1
            best = np.maximum.reduceat(cells[:, place], starts, axis=1)
            out[a:b] = (n[:, None] * best).sum(axis=0)
            a = b
        return out


def _ahead(row, first: list, k: int) -> list:
    """Columns up to the one with which ``k`` different first documents are found: each but the best of a document is passed over, its others kept."""
    best = _first(row, first, k, 1)
    if len(best) < k:
        return [i for i in range(len(row)) if row[i] > 0]
    last = round(row[best[-1]], 9)
    return [i for i in (row >= last - 1e-9).nonzero()[0] if (round(row[i], 9), -i) >= (last, -best[-1])]


def nearest(c: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q, doc_id, score): what ``catalog.matches`` has of ``queries`` (q, query), but only documents that may be among a query's ``k`` best (score to nine places, then doc_id)."""
    ids = c.select("doc_id", "type")
    whole, parts = catalog.by_identifier(c, queries)
    first = ids.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("doc_id"))).where(F.col("place") <= k)
    by_type = first.join(catalog.type_scores(c.sparkSession, queries), "type").select("q", "doc_id", "score")
    every = whole.unionAll(parts).unionAll(nearest_titles(c, queries, k)).unionAll(by_type)
    return every.groupBy("q", "doc_id").agg(F.max("score").alias("score"))


def best_chunks(index: Blocks, figures: DataFrame, queries: DataFrame, k: int, eligible: DataFrame) -> DataFrame:
    """(q, rank, chunk_id, doc_id, revision, score): the answers of ``early_stop.top_k``, each posting of the terms asked for shuffled once.

    Whether any chunk of the whole collection has all of a query's terms is known in the end only:
    a block gives its chunks with all terms, shown or not, and where it has none, those with any.
    """
    asked = materialise(weights(queries, index.blocks.select("term", "window", "n"), figures), "batch-asked")
    of = lambda number: F.expr(f"{number} div {CHUNKS}")
    words = index.blocks.join(asked.select("term").distinct(), "term", "left_semi").withColumn("block", of(f"(window * {WINDOW})"))
    words = words.select("block", "term", F.transform("entries", lambda e: (e["number"] % CHUNKS).cast("int")).alias("at"), F.col("entries.tf").alias("tf"), F.col("entries.dl").alias("dl"))
    shown = index.directory.join(eligible.select("doc_id", "revision"), ["doc_id", "revision"], "left_semi")
    shown = shown.select(of("number").alias("block"), "chunk_id", "doc_id", "revision", (F.col("number") % CHUNKS).cast("int").alias("place"))
    blocks = materialise(index.directory.select(of("number").alias("block")).distinct(), "batch-blocks")
    held = words.unionByName(shown, allowMissingColumns=True)

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: dict = {n: [] for n in ("q", "chunk_id", "doc_id", "revision", "score", "every")}
        post = left.filter(pc.is_valid(left["term"]))
        docs = left.filter(pc.is_valid(left["place"])).select(["chunk_id", "doc_id", "revision", "place"]).to_pandas().sort_values("chunk_id")
        place, group = docs.place.to_numpy(np.int64), docs.doc_id.tolist()
        ids, names, revisions = docs.chunk_id.tolist(), group, docs.revision.tolist()
        ask = right.select(["q", "term", "w", "need", "avgdl"]).to_pandas()
        if post.num_rows and len(ask):
            terms = post["term"].to_pandas()
            sizes = pc.list_value_length(post["at"]).to_numpy()
            at, tf, dl = (pc.list_flatten(post[n]).to_numpy() for n in ("at", "tf", "dl"))
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / ask.avgdl.iloc[0]))
            # a term's entries side by side
            code, vocabulary = terms.factorize()
            code = np.repeat(code, sizes)
            order = np.argsort(code, kind="stable")
            at, gain = at[order], gain[order]
            ends = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
            span = {t: (ends[i], ends[i + 1]) for i, t in enumerate(vocabulary)}
            ask = ask[ask.term.isin(span)]
            qs = ask.q.unique()
            for first in range(0, len(qs), ASKED // 4):
                part = qs[first : first + ASKED // 4]
                mine = ask[ask.q.isin(part)]
                row = {q: i for i, q in enumerate(part)}
                need = dict(zip(mine.q, mine.need))
                scores, matched = np.zeros((len(part), CHUNKS)), np.zeros((len(part), CHUNKS), np.int32)
                for q, t, w in zip(mine.q, mine.term, mine.w):
                    a, b = span[t]
                    scores[row[q], at[a:b]] += w * gain[a:b]
                    matched[row[q], at[a:b]] += 1
                for q, i in row.items():
                    all_of = matched[i] == need[q]
                    every = bool(all_of.any())
                    rest = np.where(all_of, scores[i], 0.0) if every else scores[i]
                    found = _first(rest[place], group, k, PER_DOC)
                    if every and not found:  # chunks with all terms, but none that is shown
                        for n, x in zip(out, (q, None, None, None, 0.0, True)):
                            out[n].append(x)
                    for c in found:
                        for n, x in zip(out, (q, ids[c], names[c], revisions[c], rest[place[c]], every)):
                            out[n].append(x)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    every = asked.crossJoin(blocks)
    sides = [x.repartition("block").groupBy("block") for x in (held, every)]
    rows = sides[0].cogroup(sides[1]).applyInArrow(run, "q long, chunk_id string, doc_id string, revision string, score double, every boolean")
    rows = rows.withColumn("of_all", F.max("every").over(Window.partitionBy("q"))).where((F.col("every") == F.col("of_all")) & F.col("chunk_id").isNotNull())
    best = ranked(rows.select("q", "chunk_id", "doc_id", "revision", "score"), k)
    return best.select("q", "rank", "chunk_id", "doc_id", "revision", (-F.col("score")).alias("score"))
