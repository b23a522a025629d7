"""Operator 13 against all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from seatrack.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute(rows, times=5, drop=199):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def edits(r, word):
    at, c = r.randrange(len(word) + 1), r.choice("abcxyzéÿ÷")
    return r.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


def sample(seed, n_words=60):
    r = random.Random(seed)
    heads = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 12))) for _ in range(n_words)] + ["aaaaaaaa", "ababababab", "straße", "Émilie×Ünal"]
    pool = []
    for w in heads:
        once = edits(r, w)
        pool += [w] * r.choice([5, 30, 200]) + [once] * r.choice([1, 5, 20]) + [edits(r, once)] * r.choice([2, 5]) + [edits(r, w).upper()] * 6
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i * 97 : (i + 1) * 97]) + r.choice(["", ".", "1x"]), "w", "n", "k") for i in range(len(pool) // 97 + 1)]
    return [*rows, (None, "nobody " * 9 + "nobodys " * 50, "w", "n", "k"), (3, None, "w", "n", "k"), (4, "", "w", "n", "k"), *rows[:3]]


@pytest.mark.parametrize("size", [8192, 16])
def test_variants(spark, size, monkeypatch):
    """One range for all words, and ranges so small that most words ask several."""
    monkeypatch.setattr(spelling, "RANGE", size)
    monkeypatch.setattr(spelling, "QUERIES", 2 * size)
    rows = sample(1)
    got = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(5), drop_one_in=199)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_search_is_whole_in_any_list():
    r = random.Random(7)
    for alphabet, length in (("ab", 7), ("abc", 9), ("a", 40), ("aéÿ", 70)):
        words = {"".join(r.choice(alphabet) for _ in range(r.randint(6, length))) for _ in range(400)}
        words |= {w for x in list(words)[:150] if len(w := edits(r, x)) >= 6}
        words = sorted(words)
        want = {(a, b) for a in words for b in words if one_edit(a, b)}
        got = []
        for side in (0, 1):
            turned = sorted(w[::-1] for w in words) if side else words
            q, w = spelling.near_words(spelling.SortedList(turned), turned)
            pairs = [(turned[i][::-1], turned[j][::-1]) if side else (turned[i], turned[j]) for i, j in zip(q, w, strict=True)]
            got += [p for p in pairs if side == 0 or p[0][: spelling.shared_start(len(p[0]))] != p[1][: spelling.shared_start(len(p[0]))]]
        assert len(got) == len(set(got)) and set(got) == want
        # queries that are not in the list
        odd = [edits(r, w) for w in words[:200]]
        odd = [w for w in odd if len(w) >= 6]
        q, w = spelling.near_words(spelling.SortedList(words), odd)
        assert {(odd[i], words[j]) for i, j in zip(q, w, strict=True)} == {(a, b) for a in odd for b in words if one_edit(a, b) and a[: (len(a) - 1) // 2] == b[: (len(a) - 1) // 2]}


def test_ranges_that_a_word_asks():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(900)})
    cuts = ["", *words[20::20]]
    home = lambda w: spelling.bisect_right(cuts, w) - 1
    for a in words[::7]:
        asked = spelling.ranges_of_near(a, cuts)
        k = spelling.shared_start(len(a))
        assert {home(b) for b in words if one_edit(a, b) and a[:k] == b[:k]} <= asked
    assert max(len(spelling.ranges_of_near(w, cuts)) for w in words) < len(cuts)


def test_long_words_repeats_and_empty(spark):
    long = "x" * 30000
    rows = [(i, f"{long} {long}y {'abcdef' if i else 'abcdeg'} {long[:-3]}zzz", "w", "n", "k") for i in range(6)]
    rows += [(9, "abcdef " * 30 + "abcdex " * 5 + "abcdeg " * 30, "w", "n", "k")] * 2
    got = sorted(map(tuple, spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows, drop=1 << 40)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}" if i < 37 else None) for i in range(38)] + [("other", None)]
    got = {r.word: r.root for r in spelling.with_roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{w: "w037" for w, _ in chain[:-1]}, "other": "other"}


def test_counts_of_one_word_in_many_documents(spark):
    rows = [(i, "Counted counted", "w", "n", "k") for i in range(400)]
    n = defaultdict(int)
    for w, *_, k, _, _ in brute(rows):
        n[w] += k
    assert {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(rows, SCHEMA), drop_one_in=199).collect()} == dict(n)
