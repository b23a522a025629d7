"""Operator 8: cross-entropy difference between a target and a background bigram model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD_BYTES, hashes_of, mixed, portions

#: Weight of the unigram estimate inside a bigram's.
PRIOR = 20.0
#: The shared vocabulary: a word never seen has 1 / VOCABULARY of the weight UNSEEN inside the unigram estimate.
VOCABULARY, UNSEEN = 2.0**24, 1000.0
#: Bytes of text in a block, about; the number of blocks grows with the table.
BLOCK_BYTES = 8 << 20
#: The event that ends each document with a word, and the key of a model's total.
_END, _TOTAL = np.uint64(2**63 + 1), np.uint64(0)


def _events(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, unigram key, bigram key or _TOTAL for a first word, is a word) of each event; even keys are unigrams, odd ones bigrams."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    parts = [hashes_of([r.translate(WORD_BYTES).split() for r in raws[a:b]]) for a, b in portions([len(r) for r in raws], 1 << 18)]
    del raws
    hashes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    some = np.flatnonzero(n)
    doc = np.repeat(some.astype(np.int32), n[some] + 1)
    ends = np.cumsum(n[some] + 1) - 1
    word = np.ones(len(doc), dtype=bool)
    word[ends] = False
    ids = np.full(len(doc), _END, dtype=np.uint64)
    ids[word] = hashes
    one = np.maximum(mixed(ids) << np.uint64(1), np.uint64(2))
    two = np.zeros(len(doc), dtype=np.uint64)
    two[1:] = mixed(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) | np.uint64(1)
    two[ends[:-1] + 1] = _TOTAL
    two[:1] = _TOTAL
    return doc, one, two, word


def _part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each 64-bit key: n_parts ranges of equal width, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, their lowest bytes first, then the next ones; bytes that are 0 in all are left out."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = np.flatnonzero(planes.any(axis=1))
    return planes[: used[-1] + 1 if len(used) else 1].tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def _is_target(docs: pd.DataFrame, told: pd.DataFrame) -> np.ndarray:
    named = set(zip(told.h1.tolist(), told.h2.tolist(), strict=True))
    return np.fromiter((x in named for x in zip(docs.h1.tolist(), docs.h2.tolist(), strict=True)), dtype=bool, count=len(docs))


def _tallied(keys: np.ndarray, *groups: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, how often each occurs, and how often where each of `groups` is true."""
    keys, place = np.unique(keys, return_inverse=True)
    return [keys, np.bincount(place, minlength=len(keys)), *[np.bincount(place[g], minlength=len(keys)) for g in groups]]


def _all_keys(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Distinct keys of a block in order; unigrams and bigrams have keys of their own, and _TOTAL comes first."""
    return np.unique(np.concatenate((np.array([_TOTAL]), np.unique(one), np.unique(two))))


def _count(n_parts: int):
    """Counts of a block's events over all its documents and over its target documents, packed, a row for each part of the keys that has any; key 0 has all events. Keys are told by the steps between them."""

    def run(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["block", "part", "n", "steps", "own", "of_target"], dtype=object)
        doc, one, two, _ = _events(docs.text)
        target, follows = _is_target(docs, told)[doc], two != _TOTAL
        singles = _tallied(one, target)
        pairs = _tallied(two[follows], target[follows])
        all_events = np.array([_TOTAL]), np.array([len(doc)]), np.array([target.sum()])
        del one, two, doc
        keys, own, of_target = (np.concatenate(x) for x in zip(all_events, singles, pairs, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, own, of_target = keys[order], own[order], of_target[order]
        part = _part_of(keys, n_parts)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        split = lambda x: np.split(x, first[1:])
        steps = [_packed(np.diff(k, prepend=_TOTAL)) for k in split(keys)]
        return pd.DataFrame({"block": docs.block.iloc[0], "part": part[first], "n": np.diff(first, append=len(keys)), "steps": steps, "own": [_packed(x) for x in split(own)], "of_target": [_packed(x) for x in split(of_target)]})

    return run


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of the events of a part, for each block in the order of its keys."""
    keys = [np.cumsum(_unpacked(k, n), dtype=np.uint64) for k, n in zip(rows.steps, rows.n, strict=True)]
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    cut = np.cumsum(rows.n.to_numpy())[:-1]
    out = {"block": rows.block, "part": rows.part, "n": rows.n}
    for name, c in (("background", "own"), ("target", "of_target")):
        counts = np.concatenate([_unpacked(x, n) for x, n in zip(rows[c], rows.n, strict=True)])
        total = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
        out[name] = [_packed(x) for x in np.split(total[place], cut)]
    return pd.DataFrame(out)


def _own_counts(doc: np.ndarray, place: np.ndarray, n_events: np.ndarray, n_keys: int) -> np.ndarray:
    """How often the document of each event has that event, counted for a few documents at a time."""
    own, ends = np.empty(len(place), dtype=np.int32), np.cumsum(n_events)
    for first, stop in portions(n_events.tolist(), 1 << 18):
        events = slice(ends[first] - n_events[first], ends[stop - 1])
        _, at, count = np.unique(doc[events].astype(np.int64) * n_keys + place[events], return_inverse=True, return_counts=True)
        own[events] = count[at]
    return own


def _losses(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """n_tokens and both losses of a block's documents. told: the target documents, and totals of the block's events in the order of its keys."""
    if not len(docs):
        return pd.DataFrame({"id": docs.id, "nameless": docs.nameless, "n_tokens": [], "loss_target": [], "loss_background": []})
    is_target = _is_target(docs, told[told.n.isna()])
    told = told[told.n.notna()].sort_values("part")
    totals = [np.concatenate([_unpacked(x, int(n)) for x, n in zip(told[c], told.n, strict=True)]).astype(np.int64) for c in ("background", "target")]
    del told
    doc, one, two, word = _events(docs.text)
    follows = np.flatnonzero(two != _TOTAL)
    n = np.bincount(doc, minlength=len(docs))  # events of each document, its end too
    words = np.maximum(n - 1, 0)
    members, known = (np.ones(len(docs), dtype=bool), is_target), _all_keys(one, two)
    if len(known) != len(totals[0]):
        raise ValueError("the block's documents differ from those that were counted")

    def others(events: np.ndarray) -> list[np.ndarray]:
        """For both models: how often documents other than its own have each event."""
        keys, place = np.unique(events, return_inverse=True)
        place = place.astype(np.int32)
        own = _own_counts(doc, place, n, len(keys))
        where = np.searchsorted(known, keys)
        return [total[where][place] - own * of[doc] for of, total in zip(members, totals, strict=True)]

    singles, pairs = others(one), others(two)
    del one, two
    out = {"id": docs.id.to_numpy(), "nameless": docs.nameless.to_numpy(), "n_tokens": words}
    sizes = []
    for of, total in zip(members, totals, strict=True):
        sizes.append(total[0] - n * of)
    # the larger model's counts shrink to the size of the smaller one's
    share = np.divide(sizes[1], sizes[0], out=np.ones(len(docs)), where=sizes[0] > 0)
    for name, scale, uni, bi, size in zip(("background", "target"), (share, np.ones(len(docs))), singles, pairs, sizes, strict=True):
        scale, size = scale[doc], (size * scale)[doc]
        p = (uni * scale + UNSEEN / VOCABULARY) / (size + UNSEEN)
        p[follows] = (bi[follows] * scale[follows] + PRIOR * p[follows]) / (uni[follows - 1] * scale[follows] + PRIOR)
        loss = np.bincount(doc[word], weights=-np.log2(p[word]), minlength=len(docs))
        out[f"loss_{name}"] = np.divide(loss, words, out=np.full(len(docs), np.nan), where=words > 0)
    return pd.DataFrame(out)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: `id_col`, n_tokens, loss_target, loss_background, score = loss_target - loss_background in bits a word.

    The target model counts the documents that target_ids(`id_col`) names, the
    background model all documents. Both are interpolated bigram models over
    one vocabulary, with an event that ends each document, and sum to 1 after
    every word. Every word and bigram is counted, however rare, and a document
    is scored without its own counts (a copy of it still counts). The models
    are matched in size: the background's counts are multiplied by target
    events / background events, so both outweigh the shared prior alike, as
    with a background sample of the target's size, but without its chance.

    Documents are dealt to blocks of bounded size. A block counts its events;
    counts meet by event, and the totals of its events return to each block in
    the order in which it sent them. So neither a model nor a
    task grows with the table, and each text is shuffled once. Events are named
    by 64-bit hashes.

    A low score is closer to the target than to the background. Null texts and
    texts without a word have 0 tokens and null losses and score. Rows that
    repeat get equal results; null ids stay null and are never targets. Without
    a target neither model knows a word, and scores are 0. Extra columns are ignored; an empty table
    gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    volume = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n_blocks = volume // block_bytes + 1
    named = [F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2")]
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_blocks)).alias("block")
    # without nulls, ids keep their type in pandas; rows without an id are dealt by their text
    d = docs.select(F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("id"), F.col(id_col).isNull().alias("nameless"), F.col(text_col).alias("text"))
    d = d.select(F.when(F.col("nameless"), F.pmod(F.xxhash64("text"), F.lit(n_blocks))).otherwise(block).alias("block"), "id", "nameless", *[F.when(~F.col("nameless"), h).otherwise(0).alias(n) for h, n in zip(named, ("h1", "h2"), strict=True)], "text")
    good = target_ids.select(F.col(id_col).cast(kind).alias("id")).where("id is not null").distinct()
    good = good.select(block, *named)
    n_parts = min(4 * n_blocks + 4, 1 << 20)
    counted = d.groupBy("block").cogroup(good.groupBy("block")).applyInPandas(_count(n_parts), "block long, part int, n int, steps binary, own binary, of_target binary")
    told = counted.groupBy("part").applyInPandas(_totals, "block long, part int, n int, background binary, target binary")
    told = told.select("*", *[F.lit(0).cast("long").alias(h) for h in ("h1", "h2")])
    told = told.unionByName(good.select("*", F.lit(0).alias("part")), allowMissingColumns=True)
    found = d.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_losses, f"id {kind}, nameless boolean, n_tokens long, loss_target double, loss_background double")
    told = found.select(F.when(~F.col("nameless"), F.col("id")).alias(id_col), "n_tokens", *[F.when(F.col("n_tokens") > 0, F.col(c)).alias(c) for c in ("loss_target", "loss_background")])
    return told.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def good_documents(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id_col` of the documents labelled with quality 1; labels of one id count once, by their largest quality."""
    return labels.where("quality = 1").select(id_col).distinct()
