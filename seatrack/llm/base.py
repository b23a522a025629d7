"""Shared pieces of the training-data operators: scratch tables, text rules, word hashes."""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = r"[\x20\x09-\x0D]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: spark.checkpoint.dir, or a subfolder of the warehouse where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        # executors share the warehouse too; a temporary folder of the driver's machine they may not see
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared scratch folder and reads it again, which cuts the lineage.

    A lost executor costs the readers nothing. The folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/seatrack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def frees_shuffles(step: Callable) -> Callable:
    """step(docs, ...) that returns a frame, during which Spark deletes the shuffle files of each of its queries when that query ends.

    Else they stay until the driver happens to collect its garbage. Each query
    is planned anew and writes its result, so no later one reads its shuffles.
    The session's own setting holds again once step has returned, for its frame too.
    """

    @functools.wraps(step)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = conf.get(_FREES, None)
        conf.set(_FREES, "true")
        try:
            out = step(docs, *args, **kwargs)
        finally:
            conf.unset(_FREES) if before is None else conf.set(_FREES, before)
        return out.select("*")  # a frame keeps the setting under which it was made

    return run


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def words_az(text: Column) -> Column:
    """Array of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(lower_az(text), _NOT_WORD), "")


def count_blank_separated(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, _BLANK), ""))).cast("long")


#: bytes -> bytes: A-Z to a-z, other ASCII but digits and letters to a blank, the rest unchanged.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
SHINGLE = 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words, in order; there are at least `size` words."""
    n = len(hashes) - size + 1
    total = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        total = mixed(total + hashes[j : j + n] * _MIX[j % 5])
    return total


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(size, len(hashes))))


def portions(sizes: list[int], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges [first, stop) of items that have about `limit` bytes together, one item at least."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def hashes_of(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(one 64-bit hash for each word of all parts, words of each part)."""
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = itertools.chain.from_iterable(parts)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=int(counts.sum())), counts


def shingles_of(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all texts in a row, repeats included; shingles of each text), as shingles() makes them for one text."""
    found = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first, at = np.cumsum(counts) - counts, np.cumsum(found) - found
    values = np.zeros(int(found.sum()), dtype=np.uint64)
    if len(hashes) >= size:
        text = np.repeat(np.arange(len(counts)), counts)
        values[np.repeat(counts >= size, found)] = grams(hashes, size)[text[: len(text) - size + 1] == text[size - 1 :]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            words = hashes[first[short][:, None] + np.arange(n)]
            total = np.full(len(short), np.uint64(n), dtype=np.uint64)
            for j in range(n):
                total = mixed(total + words[:, j] * _MIX[j % 5])
            values[at[short]] = total
    return values, found


def minhashes_of(values: np.ndarray, found: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """`count` 32-bit minimum hashes of each text that has a shingle, big-endian; a row of zeros for one without."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, count, dtype=np.uint64)
    out = np.zeros((len(found), count), dtype=">u4")
    some = found > 0
    if len(values):
        at = (np.cumsum(found) - found)[some]
        for k in range(count):
            out[some, k] = np.minimum.reduceat((values * a[k] + b[k]) >> np.uint64(32), at)
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted sets; 0 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0
