"""Operator 12 against a trie of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

from seatrack.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x string, last string"


def brute(rows, group=5, longest=8):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % (longest + 1)
        first = c - (abs(c) % group) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(turns.get(first, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def sample(seed=1):
    """Chats that share openings and whole texts, some of one turn, some of 70, with nulls and ids below zero."""
    r = random.Random(seed)
    texts = ["", None, "hello", "é" * 3, "yes", "no", "long " * 400]
    rows = []
    for c in [*range(-12, 60), 1000, 2**40]:
        n = r.choice([1, 1, 2, 3, 5, 8, 9, 17, 26])
        same = r.random() < 0.5
        for t in range(n):
            role = None if r.random() < 0.1 else ("user", "assistant")[t % 2]
            text = texts[t % 7] if same else r.choice(texts)
            rows.append((c, None if t == 0 and c % 3 == 0 else t, role, text, "d", "x", "l"))
    rows += [(None, 0, "user", "nobody's", "d", "x", "l")]
    r.shuffle(rows)
    return rows


def test_trie(spark, monkeypatch):
    """Blocks of three turns, chained over stretches of four blocks."""
    monkeypatch.setattr(conversation_trie, "STRETCH", 4)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(conversation_trie.conversation_trie(df, width=3)) == brute(rows)


def test_no_turns_and_no_conversations(spark):
    none = conversation_trie.conversation_trie(spark.createDataFrame([], SCHEMA))
    assert none.isEmpty() and none.columns[0] == "conv_id"
    # ids whose own turns all fall away and whose group has no first conversation
    bare = [c for c in range(1, 300) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:30]
    rows = [(c, t, "user", f"{t}", "d", "x", "l") for c in bare for t in range(2)]
    got = found(conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 30


def test_hot_nodes_and_one_long_conversation(spark, monkeypatch):
    """A third are copies, all open alike, and one conversation holds most rows; hot parents go by broadcast, others by the join."""
    monkeypatch.setattr(conversation_trie, "HOT_SHARE", 0.05)
    r = random.Random(2)
    rows = [(c, t, "user", "same" if c % 3 == 0 or t == 0 else f"{r.randrange(40)}", "d", "x", "l") for c in range(90) for t in range(10)]
    rows += [(5000, t, "user", f"{t % 50}", "d", "x", "l") for t in range(40)]
    rows += rows[:40]  # a repeated row is another turn
    got = found(conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert got == brute(rows)
