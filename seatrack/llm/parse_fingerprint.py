"""Operator 11: document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import mixed, saved

#: Levels of names: 0 are the code points, each further one names phrases of two to ten names of the level below.
LEVELS = 5
#: What a level's likeness counts: a phrase of a higher level covers about three of the level below.
WEIGHTS = np.array([0.25, 1.0, 2.0, 4.0, 8.0])
#: Bins of a level's sketch; a bin keeps 12 bits of the least name that falls in it.
BINS = 64
#: Level 0 is sketched for shorter texts only, where the others have few phrases.
SHORT = 64
#: A higher level takes part in a likeness from so many phrases in one of the two texts.
LEAST = 4
_PORTION = 1 << 20
_STEP, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _toss_table() -> np.ndarray:
    """Next label of each (label before, label) below 128: the lowest bit where they differ, doubled, plus the label's own bit there."""
    before, here = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = before ^ here
    bit = np.where(differ == 0, 7, np.bitwise_count((differ & -differ) - 1))
    return (2 * bit + ((here >> bit) & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()


def coin_toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, unlike between neighbours, that depend on a name and the four before it only. `first`: where texts begin; neighbours differ."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ names.dtype.type(1)
    differ = names ^ before
    bit = np.minimum(np.bitwise_count((differ - names.dtype.type(1)) & ~differ), names.dtype.itemsize * 8 - 1)
    labels = 2 * bit + ((names >> bit.astype(names.dtype)) & names.dtype.type(1)).astype(np.uint8)
    for _ in range(3):
        pair = np.empty(len(labels), dtype=np.uint16)
        pair[1:] = labels[:-1]
        pair[first] = labels[first] ^ 1
        pair = (pair << 7) | labels
        labels = _TOSS[pair]
    return labels


def _parsed(names: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of phrases, where texts begin among them): phrases begin at a text's start and at local maxima of the labels; runs of one name are one symbol."""
    change = np.empty(len(names), dtype=bool)
    change[0] = True
    np.not_equal(names[1:], names[:-1], out=change[1:])
    change[first] = True
    if not change.all():
        at = np.flatnonzero(change)
        run = np.diff(at, append=len(names)).astype(np.uint64)
        symbols = names[at].astype(np.uint64)
        names = np.where(run > 1, mixed(symbols + run * _RUN), symbols)
        first = np.searchsorted(at, first)
    labels = coin_toss(names, first)
    start = np.zeros(len(names), dtype=bool)
    start[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(first[1:], len(names)) - 1
    start[last] = False
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(at, append=len(names))
    place = np.arange(len(names), dtype=np.uint64) - np.repeat(at.astype(np.uint64), size)
    total = np.add.reduceat(mixed(names.astype(np.uint64) + (place + np.uint64(1)) * _STEP), at)
    return mixed(total + size.astype(np.uint64) * _RUN + np.uint64(level)), np.searchsorted(at, first)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of names, sketch) of each text and level: shapes (texts, LEVELS) and (texts, LEVELS, BINS); an empty bin is -1.

    Memory is about 40 bytes for each code point of `texts`.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    counts, low = np.zeros((len(texts), LEVELS), dtype=np.int64), np.full((len(texts), LEVELS, BINS), 1 << 32, dtype=np.int64)
    held = np.flatnonzero(sizes)
    names = np.frombuffer(b"".join(raw), dtype="<u4")
    first = (np.cumsum(sizes) - sizes)[held]
    for level in range(LEVELS if len(held) else 0):
        if level:
            names, first = _parsed(names, first, level)
        n = np.diff(first, append=len(names))
        counts[held, level] = n
        some = n < SHORT if level == 0 else np.ones(len(held), dtype=bool)
        owner = np.repeat(np.where(some, held, -1), n)
        mine = owner >= 0
        value = mixed(names[mine].astype(np.uint64) + np.uint64(level)) if level == 0 else names[mine]
        bins = owner[mine] * (LEVELS * BINS) + level * BINS + (value % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(low.reshape(-1), bins, (value >> np.uint64(32)).astype(np.int64))
    return counts, np.where(low == 1 << 32, -1, low & 0xFFF).astype(np.int16)


def likeness(counts_a: np.ndarray, sketch_a: np.ndarray, counts_b: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Weighted mean over levels of the share of equal bins among those that one of the two fills: the Jaccard similarity of the levels' names. Two empty texts are alike."""
    filled = ((sketch_a >= 0) | (sketch_b >= 0)).sum(axis=2)
    same = ((sketch_a == sketch_b) & (sketch_a >= 0)).sum(axis=2)
    most = np.maximum(counts_a, counts_b)
    weight = np.where(most >= LEAST, WEIGHTS, 0.0)
    weight[:, 0] = np.where(most[:, 0] < SHORT, WEIGHTS[0], 0.0)
    share = np.where(filled > 0, same / np.maximum(filled, 1), 1.0)
    return (weight * share).sum(axis=1) / weight.sum(axis=1)


def written(counts: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: for each level its number of names and, where it is sketched, three hex digits a bin, --- for an empty one."""
    hexes = np.array([f"{i:03x}" for i in range(1 << 12)] + ["---"])
    digits = hexes[sketch]
    return [
        ",".join(f"{n:x}:" + ("".join(d) if n and (level or n < SHORT) else "") for level, (n, d) in enumerate(zip(c.tolist(), s, strict=True)))
        for c, s in zip(counts, digits, strict=True)
    ]


def read_back(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """counts and sketches of written fingerprints, for likeness()."""
    counts, sketch = np.zeros((len(fingerprints), LEVELS), dtype=np.int64), np.full((len(fingerprints), LEVELS, BINS), -1, dtype=np.int16)
    for i, text in enumerate(fingerprints):
        for level, part in enumerate(text.split(",")):
            n, digits = part.split(":")
            counts[i, level] = int(n, 16)
            if digits:
                sketch[i, level] = [-1 if digits[k : k + 3] == "---" else int(digits[k : k + 3], 16) for k in range(0, 3 * BINS, 3)]
    return counts, sketch


def edited_text(text: str, following: str) -> str:
    """The text whose last quarter of code points is replaced by as many first ones of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(ids: list, texts: list[str], following: str) -> pd.DataFrame:
    after = [*texts[1:], following]
    edited = [edited_text(a, b) for a, b in zip(texts, after, strict=True)]
    counts, sketch = sketches([*texts, following])
    counts_e, sketch_e = sketches(edited)
    return pd.DataFrame({
        "id": pd.Series(ids, dtype=object), "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": written(counts[:-1], sketch[:-1]), "edited_fingerprint": written(counts_e, sketch_e),
        "near_edited": likeness(counts[:-1], sketch[:-1], counts_e, sketch_e), "near_next": likeness(counts[:-1], sketch[:-1], counts[1:], sketch[1:]),
    })


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part, guests last: every text meets the one after it; a part's first guest follows its last text."""
    ids, texts, size, part = [], [], 0, None
    for batch in batches:
        for key, guest, doc, text in zip(batch.part, batch.guest, batch.id, batch.text, strict=True):
            text = text or ""
            if texts and (guest or (key == part and size >= _PORTION)):
                yield _rows(ids, texts, text)
                ids, texts, size = [], [], 0
            if not guest:
                ids.append(doc)
                texts.append(text)
                size += len(text)
                part = key


def _with_followers(docs: DataFrame) -> DataFrame:
    """(part, guest, id, text) sorted inside partitions: each part is a range of (id, hash of the text), its guest the first row of the next part."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = saved(docs.select("id", tie.alias("tie")))
    key = F.struct("id", "tie")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by the texts, not by the few bytes of their ids
    firsts = slim.repartitionByRange(n_parts, "id", "tie").groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect()  # a row for each partition
    kind = docs.schema["id"].dataType
    cuts = sorted(((r.k["id"], r.k["tie"]) for r in firsts), key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]))
    if not cuts:
        cuts = [(None, 0)]
    table: Column = F.array(*[F.struct(F.lit(i).cast(kind).alias("id"), F.lit(t).cast("long").alias("tie")) for i, t in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, (len(cuts) - 1).bit_length())))])
    own = docs.select("id", "text", tie.alias("tie"))
    # binary search among the cuts
    here = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s < len(cuts)) & (F.get(table, at + s) <= key), at + s).otherwise(at))
    own = own.withColumn("here", here)
    one = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    places = F.when(F.get(table, F.col("here")) == key, F.array(one(F.col("here"), False), one(F.pmod(F.col("here") - 1, F.lit(len(cuts))), True)))
    own = own.select("id", "text", "tie", F.explode(places.otherwise(F.array(one(F.col("here"), False)))).alias("p")).select("p.*", "id", "text", "tie")
    return own.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("part", "guest", "id", "tie").drop("tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Locally consistent parsing: coin tossing gives each name of a text a label
    by the few names before it, phrases begin where labels have local maxima,
    and a phrase is named by its names. Five levels of names are sketched, so
    equal substrings share the names inside them wherever they stand, and equal
    texts have equal fingerprints. The edited text is that of edited_text with
    the row after it by rising id; near_edited and near_next are likeness().

    Null texts are empty: they have no names, and two of them are alike.
    Null ids come first; rows of one id are ordered by a hash of the text, and
    the row after the last is the first, which may be the row itself. Repeated
    rows stay. Extra columns are ignored; an empty table gives none.

    Every text is sent once, to the part that holds its range of ids and texts;
    a part's first row also goes to the part before it. A task holds texts of
    about a million code points, or one text.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_followers(d).mapInPandas(_stream, out).withColumnRenamed("id", id_col)
