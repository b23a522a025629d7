"""Operator 13: spelling variants among the frequent words of a corpus, by edit-matrix rows over sorted lists."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved

#: Letters of a word, A-Z lower-cased.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Words of a range of a sorted list, and the most ranges of both lists, which every task that deals words out knows.
RANGE, MAX_RANGES = 8192, 4096
#: Code points of a range's lower bound.
CUT = 1024
#: Queries of a range that meet it in one task; ranges with more are copied.
QUERIES = 8 * RANGE
_FAR = 2


def _lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _counted(min_chars: int, drop_one_in: int | None):
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")  # greedy, so a run is maximal

    def told(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.id, batch.text, strict=True):
                if not text:
                    continue
                found = Counter(runs.findall(_lower_az(text)))
                if drop_one_in:
                    seed = zlib.crc32(f"{doc or ''}:".encode())
                    for word, n in list(found.items()):
                        h = zlib.crc32(word.encode(), seed)
                        if h % drop_one_in == 0:
                            at = h % len(word)
                            found[word] -= n
                            found[word[:at] + word[at + 1 :]] += n
                total.update(found)
                if len(total) > 200_000:
                    yield told(total)
                    total = Counter()
        yield told(total)

    return run


def vocabulary(
    docs: DataFrame, min_chars: int = 6, min_count: int = 5, drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, of min_chars code points and min_count occurrences at least.

    With drop_one_in, a run loses one code point where the unsigned CRC-32 h of
    `<id>:<run>` is a multiple of it: that at h % length, which plants errors
    that repeat between runs of the query. Null ids are empty there.
    """
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = d.mapInPandas(_counted(min_chars, drop_one_in), "word string, n long").where((F.col("n") > 0) & (F.length("word") >= min_chars))
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared_start(length: int) -> int:
    """Two words one edit apart share so many code points at their beginning or at their end, told from the length of either."""
    return (length - 1) // 2


def ranges_of_near(key: str, cuts: list[str]) -> set[int]:
    """Ranges of the sorted list (cuts: their lower bounds, the first empty) that may hold keys one edit from `key` which share its first half."""
    at = lambda s: bisect_right(cuts, s) - 1
    found = set()
    for i in range(shared_start(len(key)), len(key) + 1):
        low, high = at(key[:i]), at(key[:i] + "\U0010ffff")
        if low == high:  # all edits from here on stay in this range
            found.add(low)
            break
        found.add(at(key[:i] + key[i + 1 :]))
        for c in LETTERS:
            found.add(at(key[:i] + c + key[i + 1 :]))
            found.add(at(key[:i] + c + key[i:]))
    return found


def _dealt(cuts: tuple[list[str], list[str]]):
    """Rows (side, part, query, key, n): each word as a member of its range, and as a query of the ranges that may hold near ones, in both lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n in zip(batch.word, batch.n, strict=True):
                for side, key in enumerate((word, word[::-1])):
                    out.append((side, bisect_right(cuts[side], key) - 1, False, key, n))
                    out += [(side, part, True, key, n) for part in ranges_of_near(key, cuts[side])]
            yield pd.DataFrame(out, columns=["side", "part", "query", "key", "n"])

    return run


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words with two zeros after each, where each begins, lengths)."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(w + "\0\0" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return codes, np.cumsum(size + 2) - size - 2, size


class SortedList:
    """Distinct words in rising order. Words that share a prefix are neighbours, so the prefixes of a length are ranges, told by adjacent common prefixes."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.codes, self.begin, self.size = _flat(words)
        both = np.minimum(self.size[1:], self.size[:-1]) + 1  # the zero after the shorter one differs
        at = np.cumsum(both) - both
        inside = np.arange(int(both.sum())) - np.repeat(at, both)
        pair = np.repeat(np.arange(n - 1), both)
        differ = self.codes[self.begin[pair] + inside] != self.codes[self.begin[pair + 1] + inside]
        first = np.where(differ, inside, np.iinfo(np.int64).max)
        self.lcp = np.concatenate(([-1], np.minimum.reduceat(first, at))) if n > 1 else np.full(n, -1)
        #: by length of prefix: (first word, word after the last, code point, number of the prefix without it times 2^21 plus the code point)
        self.levels = [(np.zeros(1, dtype=np.int64), np.full(1, n), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        while len(self.levels) <= d:
            k = len(self.levels)
            edge = np.flatnonzero(self.lcp < k)
            longer = self.size[edge] >= k
            start, stop = edge[longer], np.append(edge[1:], len(self.words))[longer]
            code = self.codes[self.begin[start] + k - 1]
            parent = np.searchsorted(self.levels[-1][0], start, side="right") - 1
            self.levels.append((start, stop, code, (parent << 21) | code))
        return self.levels[d]


def near_words(words: SortedList, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All (query, word) one edit apart, as indices, of which the query's first shared_start code points are the word's.

    All queries walk down the list together, a code point of the words a step.
    A walker stands for a query and a prefix that a range of the list shares;
    it holds the prefix's row of the edit matrix in a band of three cells,
    which all words of the range reuse, and ends where the row exceeds one edit,
    so the range is skipped, or where the query itself is all that is left.
    """
    codes, begin, size = _flat(keys)
    same = {w: i for i, w in enumerate(words.words)}
    own = np.fromiter((same.get(k, -1) for k in keys), dtype=np.int64, count=len(keys))
    half = (size - 1) // 2
    q, node = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    left, here, right = np.full(len(keys), _FAR, dtype=np.int8), np.zeros(len(keys), dtype=np.int8), np.ones(len(keys), dtype=np.int8)
    found = []
    d = 0
    while len(q):
        start, stop, code, named = words.level(d + 1)
        if not len(start):
            break
        first = np.searchsorted(named, node << 21)
        last = np.searchsorted(named, (node + 1) << 21)
        exact = d < half[q]
        if exact.any():
            want = (node << 21) | codes[begin[q] + np.minimum(d, size[q])]
            at = np.searchsorted(named, want)
            hit = (at < len(named)) & (named[np.minimum(at, len(named) - 1)] == want)
            first, last = np.where(exact, at, first), np.where(exact, np.where(hit, at + 1, at), last)
        n = last - first
        walker = np.repeat(np.arange(len(q)), n)
        node = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)
        q, left, here, right = q[walker], left[walker], here[walker], right[walker]
        c, length, base = code[node], size[q], begin[q]
        # a place after the query's end is a zero, which no letter equals; far places are masked below
        place = lambda j: codes[base + np.clip(j, 0, length)]  # noqa: B023, E731
        one = np.int8(1)
        new_left = np.minimum(here + one, left + (place(d - 1) != c))
        new_here = np.minimum(np.minimum(right + one, here + (place(d) != c)), new_left + one)
        new_right = np.minimum(right + (place(d + 1) != c), new_here + one)
        left = np.where(d > length, _FAR, np.minimum(new_left, _FAR)).astype(np.int8)
        here = np.where(d + 1 > length, _FAR, np.minimum(new_here, _FAR)).astype(np.int8)
        right = np.where(d + 2 > length, _FAR, np.minimum(new_right, _FAR)).astype(np.int8)
        d += 1
        word = start[node]
        edits = np.select([length == d - 1, length == d, length == d + 1], [left, here, right], _FAR)
        ends = (words.size[word] == d) & (edits == 1)
        found.append((q[ends], word[ends]))
        alone = (stop[node] - word == 1) & (word == own[q])
        on = (np.minimum(np.minimum(left, here), right) < _FAR) & ~alone
        q, node, left, here, right = q[on], node[on], left[on], here[on], right[on]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(words: SortedList, counts: np.ndarray, rank: np.ndarray, keys: list[str], side: int) -> pd.DataFrame:
    """(word, n_near, best_n, best) of the queries that have near words in the list."""
    q, w = near_words(words, keys)
    if side:  # words that also share the first half are found in the other list
        fresh = np.fromiter((keys[i][-h:] != words.words[j][-h:] for i, j in zip(q.tolist(), w.tolist(), strict=True) for h in (shared_start(len(keys[i])),)), dtype=bool, count=len(q))
        q, w = q[fresh], w[fresh]
    order = np.lexsort((rank[w], -counts[w], q))
    q, w = q[order], w[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    turned = (lambda s: s[::-1]) if side else (lambda s: s)
    return pd.DataFrame({
        "word": pd.Series([turned(keys[i]) for i in q[head].tolist()], dtype=object), "n_near": np.diff(head, append=len(q)), "best_n": counts[w[head]],
        "best": pd.Series([turned(words.words[j]) for j in w[head].tolist()], dtype=object),
    })


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by side, part, copy, query, key: a range's members come first and are held, its queries pass by in batches."""
    range_id, words, counts, index = None, [], [], None
    for batch in batches:
        keys = batch[["side", "part", "copy", "query"]].to_numpy().astype(np.int64)
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)], strict=True):
            if a == b:
                continue
            *this, query = keys[a].tolist()
            if this != range_id:
                range_id, words, counts, index = this, [], [], None
            if not query:
                words += batch.key.iloc[a:b].tolist()
                counts += batch.n.iloc[a:b].tolist()
                continue
            if index is None:
                rank = np.argsort(np.argsort(np.array([w[::-1] for w in words], dtype=object), kind="stable"), kind="stable") if this[0] else np.arange(len(words))
                index = SortedList(words), np.array(counts, dtype=np.int64), rank
            if words:
                yield _best(*index, batch.key.iloc[a:b].tolist(), this[0])


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct, written) that have near ones: how many, and the one of largest n, the first of equal ones.

    Words one edit apart share their first or their last half. So each word
    looks among those that share the first half in the sorted list of words,
    and among those that share the last in the list of words read backwards.
    Both lists are cut into ranges, whose bounds every task knows; a word
    goes to the ranges that may hold near ones, and ranges that many words
    ask are copied. No pairs leave a task.
    """
    spark = words.sparkSession
    lists = words.select(F.lit(0).alias("side"), F.col("word").alias("key")).unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("key")))
    n_ranges = max(1, min(MAX_RANGES, -(-2 * words.count() // RANGE)))
    bounds = lists.repartitionByRange(n_ranges, "side", "key").groupBy("side", F.spark_partition_id().alias("p")).agg(F.min(F.substring("key", 1, CUT)).alias("low"))
    cuts: tuple[list[str], list[str]] = ([], [])
    for r in bounds.orderBy("side", "low").collect():  # two rows for each of at most MAX_RANGES ranges
        cuts[r.side].append(r.low if cuts[r.side] else "")
    dealt = saved(words.mapInPandas(_dealt((cuts[0] or [""], cuts[1] or [""])), "side int, part int, query boolean, key string, n long"))
    asked = dealt.groupBy("side", "part").agg(F.greatest(F.lit(1), F.ceil(F.count_if("query") / QUERIES)).alias("copies"))
    copied = dealt.join(F.broadcast(asked), ["side", "part"])
    copies = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("key"), "copies"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    copied = copied.select("side", "part", "query", "key", "n", F.explode(copies).alias("copy"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, 2 * n_ranges))
    met = copied.repartition(parts, "side", "part", "copy").sortWithinPartitions("side", "part", "copy", "query", "key")
    near = met.mapInPandas(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best"))).alias("b")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to (word, form, written): where the forms of forms end. Pointers double in each round; a form occurs several times as often as its word, so there are few."""
    links = forms.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        further = links.select(F.col("word").alias("to"), F.col("to").alias("far"))
        after = saved(links.join(further, "to", "left").select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
        links = after.select("word", "to")
        if after.where("moved").isEmpty():
            return forms.join(links, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, times: int = 5, drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word of vocabulary(): word, n, n_near, form, form_n, root.

    Two words are near if one inserted, deleted or replaced code point makes
    them equal. A word's form is its near word of largest n, the first in
    code-point order among equal ones, if that n is `times` the word's at
    least; root follows forms to the last.

    Null and empty texts have no words, repeated rows count again, long texts
    are read whole and long words are words. Extra columns are ignored; an
    empty table gives none.
    """
    words = saved(vocabulary(docs, min_chars, min_count, drop_one_in, id_col, text_col))
    both = words.join(near_counts(words), "word", "left")
    big = F.col("best_n") >= times * F.col("n")
    forms = saved(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(big, F.col("best")).alias("form"), F.when(big, F.col("best_n")).alias("form_n")))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
