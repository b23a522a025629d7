"""Operator 11 against a plain parser, and the row after each row against a sorted list."""

import hashlib
import random

import numpy as np
import pytest

from seatrack.llm import parse_fingerprint as pf
from seatrack.llm.base import mixed

SCHEMA = "doc_id long, text string, part string, guest string, tie string"
M = (1 << 64) - 1


def mix(x):
    return int(mixed(np.array([x & M], dtype=np.uint64))[0])


def labels_of(names):
    for bits in (32 if max(names) < 1 << 32 else 64, 8, 8, 8):
        out = []
        for i, x in enumerate(names):
            before = names[i - 1] if i else x ^ 1
            k = min(bit for bit in range(64) if (x ^ before) >> bit & 1)
            assert k < bits
            out.append(2 * k + (x >> k & 1))
        names = out
    return names


def levels_of(text):
    """Names of all levels, one symbol after the other."""
    found, names = [], [ord(c) for c in text]
    for level in range(pf.LEVELS):
        if level and names:
            symbols = []
            for x in names:
                if symbols and symbols[-1][0] == x:
                    symbols[-1][1] += 1
                else:
                    symbols.append([x, 1])
            names = [mix(x + n * int(pf._RUN)) if n > 1 else x for x, n in symbols]
            lab = labels_of(names)
            start = [i for i in range(len(names)) if i == 0 or i < len(names) - 1 and lab[i] > lab[i - 1] and lab[i] > lab[i + 1]]
            phrases = [names[a:b] for a, b in zip(start, [*start[1:], len(names)], strict=True)]
            names = [mix(sum(mix(x + (i + 1) * int(pf._STEP)) for i, x in enumerate(p)) + len(p) * int(pf._RUN) + level) for p in phrases]
        found.append(names)
    return found


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ne", "ti", "or", "éla", "su", "ING", "x1", "中", "😀"]) for _ in range(r.randint(1, 4))) for _ in range(n))


TEXTS = ["", "a", "aaaa", "ab", "aaaaaaaaaabbbbbbbbbbbbbab", "é\u0000😀", prose(1, 3), prose(2, 40), prose(3, 300), "ab" * 700, "x" * 5000, prose(4, 40).upper() + "zzzzzzzz" + prose(5, 9)]


def test_parse_equals_a_plain_one():
    counts, sketch = pf.sketches(TEXTS)
    for text, n, s in zip(TEXTS, counts, sketch, strict=True):
        names = levels_of(text)
        assert n.tolist() == [len(x) for x in names]
        for level in range(1, pf.LEVELS):
            least = {}
            for x in names[level]:
                least[x % pf.BINS] = min(x >> 32, least.get(x % pf.BINS, 1 << 32))
            assert s[level].tolist() == [least[b] & 0xFFF if b in least else -1 for b in range(pf.BINS)]
    alone = [pf.sketches([t]) for t in TEXTS]
    assert all((a[0][0] == n).all() and (a[1][0] == s).all() for a, n, s in zip(alone, counts, sketch, strict=True))


def test_labels_differ_between_neighbours():
    r = np.random.default_rng(1)
    names = r.integers(0, 1 << 63, 20000, dtype=np.uint64)
    lab = pf.coin_toss(names, np.array([0, 77, 5000]))
    assert lab.max() <= 5 and (lab[1:] != lab[:-1]).all()


def test_equal_substrings_share_interior_names():
    """A passage gives the same names wherever it stands, but for a few at its edges."""
    passage = prose(9, 400)
    for before in ("", "q", prose(10, 7), prose(11, 50) * 3):
        inside = levels_of(before + passage + prose(12, 5))
        for level, names in enumerate(levels_of(passage)):
            edge = 12
            if len(names) > 2 * edge:
                core = names[edge:-edge]
                assert any(inside[level][i : i + len(core)] == core for i in range(len(inside[level])))


def test_likeness():
    texts = [prose(20, 300), prose(20, 300), prose(21, 300), "", prose(22, 2)]
    counts, sketch = pf.sketches(texts)
    near = lambda i, j: float(pf.likeness(counts[[i]], sketch[[i]], counts[[j]], sketch[[j]])[0])
    assert near(0, 1) == 1.0 and near(0, 2) < 0.2 and near(3, 3) == 1.0 and near(0, 3) == 0.0 and near(4, 3) == 0.0
    back = pf.read_back(pf.written(counts, sketch))
    assert (back[0] == counts).all() and (back[1] == sketch).all()
    # the share of a text that stays is told from fingerprints alone
    for share in (0.25, 0.5, 0.75, 0.9):
        got = []
        for seed in range(20):
            a, b = prose(100 + seed, 500), prose(200 + seed, 500)
            c, s = pf.sketches([a, a[: int(len(a) * share)] + b[: len(a) - int(len(a) * share)]])
            got.append(pf.likeness(c[:1], s[:1], c[1:], s[1:])[0])
        assert np.mean(got) == pytest.approx(share / (2 - share), abs=0.08)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        c, s = pf.sketches([text, edited, after])
        near = lambda j: float(pf.likeness(c[:1], s[:1], c[j : j + 1], s[j : j + 1])[0])  # noqa: B023, E731
        w = pf.written(c, s)
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), w[0], w[1], near(1), near(2)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_fingerprints(spark, parts, monkeypatch):
    monkeypatch.setattr(pf, "_PORTION", 500)
    rows = [(i * 3, TEXTS[i % len(TEXTS)] + ("" if i < 12 else prose(i, i % 30)), "p", "g", "t") for i in range(60)]
    rows += [(None, "nobody", "p", "g", "t"), (500, None, "p", "g", "t"), (501, prose(77, 30000), "p", "g", "t")]
    random.Random(3).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, pf.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_ties_repeats_and_few_rows(spark):
    rows = [(7, f"tie {i % 4}", "p", "g", "t") for i in range(50)] + [(None, None, "p", "g", "t")] * 3
    got = pf.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 53 and len({r.fingerprint for r in got}) == 5
    one = pf.fingerprints(spark.createDataFrame([(1, "abcdefgh", "p", "g", "t")], SCHEMA)).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abcdefab").hexdigest())]
    none = pf.fingerprints(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "doc_id"
