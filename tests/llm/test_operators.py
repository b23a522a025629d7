"""The numbered operators against brute force on small fixtures, with the cases that tables of a real corpus hold."""

import hashlib
import pathlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrack.llm import base, decontaminate, exact_dedup, jaccard_join, language, line_dedup, lm_score, mixing, near, preferences, substring_dedup, token_counts
from seatrack.llm.base import jaccard, shingles, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, items string, carried string, row string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def az(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ne", "ti", "or", "éla", "su", "ING", "x1"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LINE = "This very line is in many of the documents, Forty characters at least."


def rows():
    out = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "  \n\t\n", None, "a"), (4, "!!! ... 123", "en", "b"),
        (5, prose(5, 60), "en", "a"), (6, prose(5, 60), "en", "a"), (7, prose(5, 60).upper(), "en", "b"), (5, prose(5, 60), "en", "a"),
        (None, prose(9, 40), "fr", "c"), (None, prose(10, 40), "fr", "c"), (None, None, None, None), (8, prose(8, 30000), "en", "a"),
        (9, "İstanbul ÉCOLE <|endoftext|> don't we'll 12½ " + "z" * 3000 + " é  ﬁ 中文字 ＡＢ", "fr", "b"),
    ]
    for i in range(10, 30):
        out.append((i, f"{prose(i, 30)}\n {LINE}\t\n{prose(i + 100, 20)}" + (f"\n{LINE.upper()}" if i % 3 == 0 else ""), "en", "abc"[i % 3]))
    model = prose(1000, 200).split(" ")
    for i in range(30, 50):
        r = random.Random(i)
        words = list(model)
        for _ in range(i % 10):
            words[r.randrange(len(words))] = prose(i * 7 + _, 1)
        out.append((i, " ".join(words), "de", "d"))
    return [(*x, None if x[1] is None else len(x[1]), "k", "s", "i", "c", "r") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    words = prose(8, 30000).split(" ")
    items = [(0, " ".join(words[500:530])), (1, " ".join(words[29000:29004]).upper()), (2, None), (3, "!!"), (None, " ".join(words[700:712])), (0, " ".join(words[500:530])), (4, prose(12, 14))]
    return spark.createDataFrame(items, "item_id long, text string")


def text_of(r):
    return r["text"]


def test_token_counts(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert Counter(map(tuple, token_counts.token_counts(docs, path).collect())) == want
    assert token_counts.token_counts(none, path).count() == 0
    odd = ["a<|startoftext|>b", "<|ENDOFTEXT|>", "''s !'s 'Sabc", "x̀ ́y", "İİ", "a\x1cb\x85c", "²³¼ µª", "ΩΩ ΣΑΣ"]
    made = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(made, path).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(odd)}


def brute_lines(data):
    held = defaultdict(set)
    keys = []
    for r in data:
        lines = (r[1] or "").split("\n")
        keys.append([(x, az(x.strip(" \t\n\x0b\x0c\r"))) for x in lines])
        for _, k in keys[-1]:
            if len(k) >= 40:
                held[k].add(r[0])
    common = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= 5}
    out = []
    for r, ks in zip(data, keys, strict=True):
        kept = [x for x, k in ks if k not in common or common[k] == r[0]]
        out.append((r[0], len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_of_hot_keys(spark):
    line = "A line that every single document holds, long enough"
    data = [(i, "\n".join([line, f"{line} {i % 7}", f"own {i} " * 8, line.upper() + " " * (i % 3)])) for i in range(300)]
    made = spark.createDataFrame([*data, (7, data[7][1]), (None, line)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(made).collect())
    assert got == brute_lines([*data, (7, data[7][1]), (None, line)])
    assert sum(r[2] == 0 for r in got) == 1


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == brute_lines(rows())
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())
    assert line_dedup.dedup_lines(none).count() == 0


def test_mix(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    by = defaultdict(lambda: [0, 0, 0.0])
    of = {}
    for r in rows():
        of.setdefault(r[0], set()).add(r[3])
        by[r[3]][0] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total = sum(v[0] for v in by.values())
    names = sorted((k for k in by if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    for _ in range(len(names) + 1):
        left = total - sum(3 * by[k][0] for k in names if k not in free)
        target = {k: left * weight[k] / sum(weight[x] for x in free) if k in free else 3 * by[k][0] for k in names}
        over = {k for k in free if target[k] > 3 * by[k][0]}
        if not over:
            break
        free -= over
    assert {(r.source_size, round(r.target, 4)) for r in got} == {(by[k][0], round(target[k], 4)) for k in names}
    assert all(0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(rows())
    taken = defaultdict(int)
    for r in mixing.mix(docs, carry=True).collect():
        taken[r.carried.source] += r.taken
    assert all(abs(taken[k] - target[k]) <= 0.05 * target[k] + 2 for k in names)
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    clashing = docs.withColumn("mix_size", F.lit("x")).withColumn("size", F.lit("y"))
    assert sorted(mixing.mixture(clashing).columns) == sorted([*clashing.columns, "mix_taken", "mix_target"])
    assert {r.size for r in mixing.mixture(clashing).collect()} == {"y"}
    assert [r.taken for r in mixing.mix(docs.where("doc_id < 3")).collect()] == [0, 0]


def test_apportionment_is_highest_quotients(spark):
    r = random.Random(3)
    for seats in (1, 7, 40, 333):
        shares = [r.choice([0.0, 1.0, 3.0, 5.5, 40.0, 1000.0]) * r.random() for _ in range(25)]
        df = spark.createDataFrame([(i, x, seats) for i, x in enumerate(shares)], "key long, share double, seats long")
        got = {x.key: x.quota for x in mixing._apportioned(df, "seats", "share", ["key"], [], ["key"]).collect()}
        quotients = sorted(((-x / (2 * k + 1), i, k) for i, x in enumerate(shares) if x > 0 for k in range(seats)))[:seats]
        assert got == {i: Counter(q[1] for q in quotients)[i] for i in range(25)}


def test_language(spark, docs, none):
    letters = {"aa": "abcde", "bb": "defgh", "cc": "çßéab"}
    data = []
    for i in range(300):
        lang = list(letters)[i % 3]
        r = random.Random(i)
        data.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7))) for _ in range(60)), lang if i % 17 else None))
    data += [(None, "abc abd", "aa"), (900, None, "aa"), (901, "12 ?!", "bb"), (902, "", None)]
    made = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = language.identify_languages(made, language.fit_languages(made)).collect()
    got = {r.doc_id: r for r in found}
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(got[i].lang_pred == list(letters)[i % 3] for i in range(300) if got[i].held_out) >= 0.98 * sum(got[i].held_out for i in range(300))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in found)
    filters = language.fit_languages(docs)
    assert language.identify_languages(docs, filters).count() == len(rows())
    assert language.identify_languages(none, language.fit_languages(none)).count() == 0
    assert {r.lang_pred for r in language.identify_languages(docs, language.fit_languages(none)).collect()} == {"und"}
    stay = language.keep_identified(docs, filters)
    assert stay.columns == docs.columns and 0 < stay.count() < len(rows())


def test_filters_beyond_one_word():
    r = np.random.default_rng(1)
    own = {f"l{i:03}": r.integers(0, 2**63, 50, dtype=np.uint64) for i in range(130)}
    f = language.LanguageFilters.build(own)
    assert f.slots.shape[1] == 3 and len(f.false_positive) == 130


def test_exact_groups(spark, docs, none, monkeypatch):
    data = rows()
    groups = defaultdict(list)
    for r in data:
        groups[az(r[1])].append(r[0])

    def told(frame):
        got = frame.collect()
        assert len(got) == len(data)
        want = Counter()
        for text, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)

    told(exact_dedup.exact_groups(docs))
    monkeypatch.setattr(exact_dedup, "MIN_HOT", 2)  # every group of three is split into runs
    told(exact_dedup.exact_groups(docs))
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_contamination(docs, none, bench, monkeypatch):
    windows = defaultdict(set)
    for r in bench.collect():
        w = WORD.findall(az(r.text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    want = Counter()
    for r in rows():
        w, hit, items = WORD.findall(az(r[1])), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[g] - {None}
        want[(r[0], len(w), len(hit), tuple(sorted(map(str, items))))] += 1
    for limit in (10**6, 0):  # broadcast and shuffled join
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", limit)
        got = decontaminate.contamination(docs, bench)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(n for k, n in want.items() if not k[2])


def brute_links(data, threshold=0.8):
    sets = {}
    for _, text in data:
        s = frozenset(tuple(w[i : i + 5]) for w in [WORD.findall(az(text))] if w for i in range(max(1, len(w) - 4)))
        if s:
            sets[s] = None
    keys = list(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[:i] if len(a & b) / len(a | b) >= threshold}, keys


def test_similar_documents(spark, docs, none):
    data = rows()
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == len(data)
    links, keys = brute_links([r[:2] for r in data])
    root = {k: k for k in keys}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    of = {}
    for r in data:
        w = WORD.findall(az(r[1]))
        if w and r[0] is not None:
            of[r[0]] = find(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    classes = {r.doc_id: r.class_id for r in got if r.doc_id in of}
    assert all((classes[a] == classes[b]) == (of[a] is of[b]) for a in of for b in of)
    assert sum(r.kept for r in got) == len(set(map(id, map(find, keys)))) + sum(not WORD.findall(az(r[1])) for r in data)
    assert jaccard_join.similar_documents(none).count() == 0
    names = {c: F.lit("x") for c in ("lost_id", "lost_hash", "id", "key", "node", "root", "text_hash", "carried", "spans", "cut_id")}
    clashing = docs.withColumns(names)
    assert jaccard_join.drop_similar(clashing).columns == clashing.columns and jaccard_join.drop_similar(clashing.limit(0)).count() == 0
    assert substring_dedup.remove_passages(clashing.where("doc_id > 9")).columns == clashing.columns
    stay = jaccard_join.drop_similar(docs)
    assert stay.columns == docs.columns and stay.where("doc_id between 30 and 49").count() == len({id(of[i]) for i in range(30, 50)})


def test_classes_that_hang_on_one_text(spark, monkeypatch):
    """Copies that are like their model but not like each other, next to texts that share a frame and are like nobody."""
    monkeypatch.setattr(near, "BLOCK", 8)
    model, data = prose(70, 300).split(" "), []
    data.append((100, " ".join(model)))
    for i in range(1, 120):
        r, words = random.Random(i), list(model)
        for at in r.sample(range(5, 295), 5 if i <= 60 else 22):
            words[at] = f"w{i}x{at}"
        data.append((100 + i, " ".join(words)))
    got = {r.doc_id: r for r in jaccard_join.similar_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()}
    links, keys = brute_links(data)
    near_model = [i for i in range(100, 161) if jaccard(shingles(word_hashes(data[0][1])), shingles(word_hashes(data[i - 100][1]))) >= 0.8]
    assert len(near_model) > 55 and len(links) < 90
    assert {got[i].class_id for i in near_model} == {100}
    assert all(got[i].class_id == i for i in range(161, 220) if got[i].n_links == 0) and got[100].n_links >= len(near_model) - 1


def framed_texts(n_model, n_frame, n_pairs, size=100):
    """Copies of one model that are not like each other, texts that share a frame below the threshold, and pairs of 0.8 or more among these."""
    model, data = prose(71, size).split(" "), []
    for i in range(n_model + n_frame):
        r, words = random.Random(500 + i), list(model if i < n_model else prose(72, size).split(" "))
        for at in r.sample(range(2, size // 5), 2 if i < n_model else 3) if i else []:
            words[at * 5] = f"w{i}x{at}"
        data.append(words)
    for i in range(n_model, n_model + n_pairs):
        data.append([*data[i][:-1], f"end{i}"])
    return [(i, " ".join(x)) for i, x in enumerate(data)]


def brute_classes(data):
    """Least id of each text's component under Jaccard of 0.8 or more."""
    sets, least = {i: shingles(word_hashes(t)) for i, t in data}, {i: i for i, _ in data}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    for _ in data:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least, links


def test_no_pair_of_a_large_run_is_lost(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    data = framed_texts(60, 90, 30)
    least, links = brute_classes(data)
    assert len(links) >= 80 and len(set(least.values())) > 60
    made = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    # prefixes of one hash in 40 trees: a pair at the threshold meets with probability 1 - 1e-28
    got = {r.doc_id: r.class_id for r in jaccard_join.similar_documents(made, trees=40, depth=1).collect()}
    assert got == least


def test_no_paragraph_of_a_large_bucket_is_lost(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    data = framed_texts(60, 90, 30)
    got = {r.doc_id: r.n_removed_words for r in substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    # the changed last word goes only with its paragraph
    assert all(got[i] == 100 for i in range(150, 180))


@pytest.mark.parametrize("block", [64, 512])
def test_every_link_is_counted(spark, monkeypatch, block):
    """A class of many links, most of them not with a pivot, and pairs just above the threshold, which few of the links are."""
    monkeypatch.setattr(near, "BLOCK", block)
    frame = prose(90, 39)
    data = [(i, f"{frame} end{i}") for i in range(300)]
    for i in range(100):
        both = prose(9000 + i, 179)
        data += [(1000 + 2 * i + k, f"{both} {' '.join(f'w{i}x{k}x{at}' for at in range(21))}") for k in range(2)]
    _, links = brute_classes(data[300:])
    assert len(links) == 100 and jaccard(*(shingles(word_hashes(data[i][1])) for i in (0, 1))) > 0.9
    got = {r.doc_id: r.n_links for r in jaccard_join.similar_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: 299 if i < 300 else 1 for i, _ in data}


def test_forest_depth():
    k = near.matched_depth(jaccard_join.THRESHOLD, jaccard_join.TREES, jaccard_join.DEPTH, jaccard_join.TARGET_RECALL)
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= jaccard_join.TARGET_RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard_join.TREES
    bands, rows = substring_dedup.tuned_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= substring_dedup.TARGET_RECALL and bands * rows <= substring_dedup.MAX_HASHES and rows > 1


def test_prefixes_shorten_until_the_recall_told_from_links(spark):
    many = spark.createDataFrame([(0.95, 8.0)] * 999 + [(0.8, 8.0)], "similarity double, at double")
    none = many.limit(0)
    told = near.estimated_recall(many, 12, [4, 6, 8], 0.8)
    assert told[4] > told[6] > told[8] > near.estimated_recall(none, 12, [8], 0.8)[8] == near.meeting(0.8, 12, 8)
    p = lambda s, k: 1 - (1 - s**k) ** 12
    want = (999 * p(0.95, 6) / p(0.95, 8) + p(0.8, 6) / p(0.8, 8) + p(0.8, 6)) / (999 / p(0.95, 8) + 1 / p(0.8, 8) + 1)
    assert told[6] == pytest.approx(want)


def test_batched_hashes_agree_with_single_ones():
    texts = ["", "one", "two words", "a b c d", "a b c d e", prose(3, 50), None, "x " * 9]
    parts = [list((t or "").encode().lower().translate(base.WORD_BYTES).split()) for t in texts]
    values, found = base.shingles_of(*base.hashes_of(parts))
    at = np.cumsum(found) - found
    for t, p, n in zip(texts, at, found, strict=True):
        assert sorted(set(values[p : p + n].tolist())) == shingles(word_hashes(t)).tolist()
    signs = base.minhashes_of(values, found, 8)
    whole = base.minhashes_of(values[at[5] : at[5] + found[5]], found[5:6], 8)
    assert (signs[5] == whole[0]).all() and not signs[0].any()
    assert list(base.portions([3, 9, 1, 1, 1], 4)) == [(0, 1), (1, 2), (2, 5)] and list(base.portions([])) == []


def test_recall_among_texts_of_one_frame(spark):
    """600 texts share a frame and are just below the threshold to each other; each has one partner just above it."""
    frame, data = prose(60, 504), []
    for i in range(600):
        data.append((i, f"{frame} {prose(700 + i // 2, 10)} {prose(2000 + i, 58)}"))
    least, links = brute_classes(data)
    assert 290 <= len(links) <= 310
    # many partitions, so that the group is dealt out
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    got = {r.doc_id: r.class_id for r in jaccard_join.similar_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(12)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.97 * len(links) and all(least[got[i]] == least[i] for i in got)


def test_components(spark):
    r = random.Random(2)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("h", f"s{i}") for i in range(50)] + [(f"r{r.randrange(60)}", f"r{r.randrange(60)}") for _ in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.root for x in near.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    named = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == named
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in named for b in named)


def test_substring_dedup(spark, docs, none):
    passage = prose(777, 60)
    near_copy = passage.split(" ")
    near_copy[30] = "changed"
    data = [(i, f"{prose(2000 + i, 50)} {passage} {prose(3000 + i, 40)}\n{prose(4000 + i, 60)}") for i in range(6)]
    data += [(100 + i, prose(5000 + i, 150)) for i in range(30)]
    data += [(200, f"{prose(1, 30)}\n{passage}"), (201, f"{prose(2, 30)}\n{' '.join(near_copy)}\n{prose(3, 30)}"), (300, None), (None, ""), (301, passage * 2)]
    made = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(made).collect()}
    assert len(got) == len(data) and got[0].n_spans == 0
    assert all(got[i].n_removed_words >= 30 and got[i].n_removed_words <= 62 for i in range(1, 6))
    assert got[200].n_removed_words >= 30 and got[201].n_removed_words == 60
    assert all(got[100 + i].n_removed_words == 0 for i in range(30))
    assert substring_dedup.repeated_passages(none).count() == 0
    odd = defaultdict(list)
    for r in substring_dedup.repeated_passages(docs).collect():
        odd[r.doc_id].append(r)
    assert sum(map(len, odd.values())) == len(rows()) and [odd[i][0].n_removed_words for i in (1, 2, 3, 4)] == [0] * 4
    assert odd[8][0].n_words == 30000 and odd[8][0].n_removed_words == 0  # a very long text
    assert len(odd[5]) == 2 and odd[5][0] == odd[5][1] and odd[5][0].n_removed_words == 0  # repeated rows are one document
    assert odd[6][0].n_removed_words == 60 and odd[7][0].n_removed_words == 0 and len(odd[None]) == 3  # É is not é
    cut = {r.doc_id: r.text for r in substring_dedup.remove_passages(made.where("doc_id is not null")).collect()}
    assert cut[0] == data[0][1] and " ".join(near_copy) not in cut[201] and cut[300] is None


def brute_removed(data):
    """Word places that go from each document: paragraphs like one of another cluster's first document, and 20-word windows that an earlier document holds."""
    words, lines, windows = {}, [], {}
    for i, t in sorted(data):
        at, words[i] = 0, []
        for line in (t or "").split("\n"):
            w = WORD.findall(az(line))
            if len(w) >= 20:
                lines.append((i, at, w))
            at += len(w)
            words[i] += w
    gone = {i: set() for i in words}
    sets = [shingles(word_hashes(" ".join(w))) for _, _, w in lines]
    root = list(range(len(lines)))
    for _ in range(len(lines)):
        before = list(root)
        for x in range(len(lines)):
            for y in range(x):
                if root[x] != root[y] and jaccard(sets[x], sets[y]) >= 0.8:
                    root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    for r in set(root):
        of = [lines[k] for k in range(len(lines)) if root[k] == r]
        least = min(i for i, _, _ in of)
        for i, at, w in of:
            if i != least:
                gone[i] |= set(range(at, at + len(w)))
    for i in sorted(words):
        for p in range(len(words[i]) - 19):
            if windows.setdefault(tuple(words[i][p : p + 20]), i) != i:
                gone[i] |= set(range(p, p + 20))
    return gone


def test_removed_words_by_brute_force(spark):
    """Paragraphs, near copies, passages and texts of few words that repeat by chance, null and empty texts."""
    data, few = [(900, None), (901, "")], prose(50_000, 9).split(" ")
    for i in range(70):
        r = random.Random(i)
        parts = [prose(51_000 + i * 3 + k, r.randrange(5, 60)) for k in range(2)]
        near = prose(52_000 + r.randrange(6), 90).split(" ")
        for at in range(10, 10 + r.randrange(3)):
            near[at] = f"w{i}"
        shared = prose(53_000 + r.randrange(8), 70).split(" ")
        begin = r.randrange(40)
        parts.append(" ".join(near))
        parts.append(f"{prose(54_000 + i, 12)} {' '.join(shared[begin : begin + r.randrange(15, 30)])} {prose(55_000 + i, 12)}")
        parts.append(" ".join(r.choice(few) for _ in range(60)))
        r.shuffle(parts)
        data.append((i, "\n".join(parts)))
    want = brute_removed(data)
    got = {x.doc_id: {p for s in x.spans for p in range(s["first"], s["stop"])} for x in substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()}
    assert got == want and sum(map(len, want.values())) > 3000


def test_every_shared_passage_is_found(spark):
    """Passages of 20, 21, 51 and 60 words at random places of differing texts, also in lines of one to five words; each shared word goes from the later document."""
    r, data, want = random.Random(11), [], {}
    for i in range(240):
        words = prose(90_000 + i, r.choice([20, 21, 51, 60])).split(" ")
        cut = r.randrange(1, 6) if i % 2 else 10**6
        passage = "\n".join(" ".join(words[at : at + cut]) for at in range(0, len(words), cut))
        for j in (0, 1):
            before = prose(91_000 + 2 * i + j, r.randrange(30))
            data.append((2 * i + j, f"{before} {passage} {prose(92_000 + 2 * i + j, r.randrange(30))}"))
            want[2 * i + j] = (len(before.split()), len(before.split()) + len(words))
    # two documents share more with each other than with the first one, by the same anchors
    long = prose(95_000, 60).split(" ")
    data += [(1000, f"{prose(1, 9)} {' '.join(long[15:45])} {prose(2, 9)}"), (1001, f"{prose(3, 9)} {' '.join(long)}"), (1002, f"{prose(4, 9)} {' '.join(long)}")]
    want |= {1001: (24, 54), 1002: (9, 69)}
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect()}
    assert all(got[i] == [] for i in (*range(0, 480, 2), 1000))
    for i in (*range(1, 480, 2), 1001, 1002):
        a, b = want[i]
        assert any(x <= a and b <= y and y - x <= b - a + 2 for x, y in got[i]), (i, got[i], want[i])


def brute_losses(data, targets):
    """(n, loss_target, loss_background) of each document by plain counts without its own, and the conditional distribution of one model."""
    seqs = [[*WORD.findall(az(t)), None] if WORD.findall(az(t)) else [] for _, t in data]
    out = []
    for k, seq in enumerate(seqs):
        losses = []
        for background in (False, True):
            rest = [s for i, s in enumerate(seqs) if i != k and (background or data[i][0] in targets)]
            one, two = Counter(w for s in rest for w in s), Counter(p for s in rest for p in zip(s, s[1:], strict=False))
            share = min(1.0, sum(len(s) for i, s in enumerate(seqs) if i != k and data[i][0] in targets) / max(sum(one.values()), 1))
            if background:  # its counts shrink to the target's size
                one, two = Counter({w: c * share for w, c in one.items()}), Counter({w: c * share for w, c in two.items()})
            total, loss = sum(one.values()), 0.0
            p_one = lambda w: (one[w] + lm_score.UNSEEN / lm_score.VOCABULARY) / (total + lm_score.UNSEEN)  # noqa: B023, E731
            for i, w in enumerate(seq[:-1]):
                p = p_one(w)
                if i:
                    p = (two[seq[i - 1], w] + lm_score.PRIOR * p) / (one[seq[i - 1]] + lm_score.PRIOR)
                loss -= np.log2(p)
            for u in list(one)[:3]:  # the model sums to 1 after every word
                if u is not None:
                    after = sum((two[u, w] + lm_score.PRIOR * p_one(w)) / (one[u] + lm_score.PRIOR) for w in one)
                    after += (lm_score.VOCABULARY - len(one)) * lm_score.PRIOR * lm_score.UNSEEN / lm_score.VOCABULARY / (total + lm_score.UNSEEN) / (one[u] + lm_score.PRIOR)
                    assert after == pytest.approx(1.0)
            losses.append(loss / (len(seq) - 1) if seq else None)
        out.append((max(len(seq) - 1, 0), *losses))
    return out


def test_lm_score(spark, docs, none):
    good = [(i, prose(i, 40)) for i in range(25)]
    other = [(100 + i, " ".join(f"zz{random.Random(i * 99 + k).randrange(40)}" for k in range(60))) for i in range(25)]
    data = [*good, *other, (3, good[3][1]), (800, good[9][1]), (None, None), (500, ""), (None, good[4][1])]
    made = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "block", "h1", "key", "target", "score")})
    ids = spark.createDataFrame([(i,) for i in (*range(18), 17, 900, None)], "doc_id long")
    want = Counter((i, n, None if a is None else round(a, 8), None if b is None else round(b, 8)) for (i, _), (n, a, b) in zip(data, brute_losses(data, set(range(18))), strict=True))
    for size in (10**6, 700):  # one block and many
        got = lm_score.cross_entropy_difference(made.repartition(3), ids, block_bytes=size).collect()
        assert Counter((r.doc_id, r.n_tokens, r.loss_target and round(r.loss_target, 8), r.loss_background and round(r.loss_background, 8)) for r in got) == want
    assert max(r.score for r in got if r.doc_id is not None and r.doc_id < 25) < min(r.score for r in got if r.doc_id is not None and 100 <= r.doc_id < 125)
    # own counts are held out: a text that occurs once gains nothing by being a target
    assert {r.doc_id: r.score for r in got}[500] is None
    assert lm_score.cross_entropy_difference(none, ids).count() == 0
    odd = lm_score.cross_entropy_difference(docs, ids.limit(0)).collect()
    assert {r.score for r in odd} == {0.0, None}  # without a target
    assert len(odd) == len(rows()) and {r.n_tokens for r in odd if r.doc_id == 8} == {30000} and len({tuple(r) for r in odd if r.doc_id == 5}) == 1
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in lm_score.good_documents(labels).collect()} == {1, None}


def test_preferences(spark):
    turns = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "é?"), (1, 3, "assistant", "Yes"), (2, 0, "user", "Hi"), (2, 1, "assistant", "No"),
             (3, 0, "user", "alone"), (70, 0, None, "x"), (70, 1, "assistant", None), (None, 0, "assistant", "lost"), (5, 0, "assistant", "No"), (5, None, "system", "s")]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.chosen_id: r for r in preferences.preference_rows(preferences.pair_with_other_reply(preferences.conversations_as_rows(made))).collect()}
    assert set(got) == {1, 2, 5, 70}
    one = got[1]
    assert one.prompt == "<|user|>\nHi\n<|assistant|>\nHello\n<|user|>\né?\n" and one.prompt_turns == 3
    assert one.chosen == "<|assistant|>\nYes\n" and one.rejected == "<|assistant|>\nNo\n"
    assert [one.chosen[s.start : s.start + s.length] for s in one.chosen_mask] == ["Yes"]
    assert got[2].chosen == "" and got[2].prompt_turns == 2  # the neighbour replies the same
    assert got[5].prompt == "<|system|>\ns\n" and got[5].rejected == "<|assistant|>\nYes\n"
    assert got[70].prompt_turns == 2 and got[70].prompt.startswith("<||>\nx\n")
    rest = spark.createDataFrame([], made.schema)
    assert preferences.preference_rows(preferences.pair_with_other_reply(preferences.conversations_as_rows(rest))).count() == 0
    pair = preferences.conversations_as_rows(made.where("conv_id in (1, 3)"))
    apart = pair.alias("a").join(pair.alias("b"), F.expr("a.conv_id = 1 and b.conv_id = 3")).select(F.struct("a.*").alias("chosen"), F.struct("b.*").alias("rejected"))
    assert preferences.preference_rows(apart).first().prompt == ""


def test_set_hashes_agree_with_sets():
    x, y = prose(1, 100), prose(1, 90)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (WORD.findall(az(x)), WORD.findall(az(y)))]
    assert jaccard(shingles(word_hashes(x)), shingles(word_hashes(y))) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))


def test_stages_on_empty_and_odd_tables(spark, docs, none, bench):
    filters = language.fit_languages(docs)
    assert language.keep_identified(none, filters).collect() == [] and language.keep_identified(docs, language.fit_languages(none)).collect() == []
    assert exact_dedup.drop_exact_copies(none).collect() == [] and decontaminate.drop_contaminated(none, bench).collect() == []
    assert substring_dedup.remove_passages(none).collect() == []
    told = lambda frame: Counter(tuple(r) for r in frame.collect())
    data = Counter(rows())
    assert told(decontaminate.drop_contaminated(docs, bench.limit(0))) == data
    clean = told(decontaminate.drop_contaminated(docs, bench))
    assert clean == Counter({r: n for r, n in data.items() if r[0] not in (8, 12)})  # item 4 is from document 12
    kept = told(language.keep_identified(docs, filters))
    assert not {1, 2, 3, 4} & {r[0] for r in kept} and all(data[r] == n for r, n in kept.items()) and any(r[0] is None for r in kept) and 8 in {r[0] for r in kept}
    best = {}
    for r in rows():
        best[az(r[1])] = max(best.get(az(r[1]), (-1,)), (-1 if r[0] is None else r[0],))
    left = exact_dedup.drop_exact_copies(docs).collect()
    assert Counter((az(r.text), -1 if r.doc_id is None else r.doc_id) for r in left) == Counter((t, i) for t, (i,) in best.items())
    assert left[0].asDict().keys() == set(docs.columns) and all(data[tuple(r)] for r in left)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    plain = [(r[0], r[1], r[2], r[3], r[4]) for r in rows()]
    made = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    words = prose(8, 30000).split(" ")
    spark.createDataFrame([(0, " ".join(words[500:530]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert 8 not in ids and not {1, 2, 3, 4} & set(ids) and len(ids) == len(set(ids))
    assert all(r.mix_taken > 0 for r in out)
    assert 2 <= len(corpus_pipeline.STAGES) <= 5


def test_substring_dedup_leaves_no_shuffle_files(spark):
    def files():
        return set(pathlib.Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    made = spark.createDataFrame([(i, f"{prose(6000 + i, 30)} {prose(6999, 40)}") for i in range(8)], "doc_id long, text string")
    there, own = files(), spark.conf.get(setting, None)
    found = substring_dedup.repeated_passages(made)
    late = time.time() + 10
    while (left := files() - there) and time.time() < late:  # executors delete them a moment after a query has ended
        time.sleep(0.1)
    assert not left and spark.conf.get(setting, None) == own
    assert [r.n_removed_words >= 40 for r in sorted(found.collect())] == [False] + [True] * 7
    assert files() - there  # those of the caller's query, outside the operator
    with pytest.raises(ZeroDivisionError):
        base.frees_shuffles(lambda docs: 1 // 0)(made)
    assert spark.conf.get(setting, None) == own
