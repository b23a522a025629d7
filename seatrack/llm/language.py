"""Operator 5: language by character n-grams in bit-sliced Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import mixed

#: Labelled documents of each language that the filters are built from, in expectation.
SAMPLE_DOCS = 4_000
#: An n-gram enters a language's filter if at least this share of its sampled documents hold it (and two of them).
MIN_SHARE = 0.02
SIZES = (1, 2, 3, 4)
SLOT_BITS = 20
PROBES = 2
HELD_OUT_OF = 5


def _letters(text: str) -> np.ndarray:
    """Code points of the text in lower case; what is no letter is a blank, and blanks never follow each other."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    seen = np.unique(points)
    letter = np.fromiter((chr(int(c)).isalpha() for c in seen), dtype=bool, count=len(seen))
    points = np.where(letter[np.searchsorted(seen, points)], points, np.uint64(32)) if len(points) else points
    points = np.concatenate(([np.uint64(32)], points, [np.uint64(32)]))
    return points[~((points == 32) & (np.concatenate(([False], points[:-1] == 32))))]


def ngrams(text: str) -> np.ndarray:
    """64-bit hashes of all n-grams of the text, with repeats; none if it has no letter."""
    points = _letters(text)
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64)
    grams = []
    for n in SIZES:
        if len(points) >= n:
            total = np.full(len(points) - n + 1, np.uint64(n), dtype=np.uint64)
            for j in range(n):
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - n + 1 + j])
            grams.append(total)
    return np.concatenate(grams)


@dataclass
class LanguageFilters:
    """languages[i] owns bit i % 64 of word i // 64 of each slot."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def _probes(grams: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(2**SLOT_BITS - 1)
        return [((grams >> np.uint64(SLOT_BITS * i)) & mask).astype(np.int64) for i in range(PROBES)]

    @classmethod
    def build(cls, per_language: dict[str, np.ndarray]) -> LanguageFilters:
        names = sorted(per_language)
        slots = np.zeros((2**SLOT_BITS, -(-max(1, len(names)) // 64)), dtype=np.uint64)
        fill = np.zeros(len(names))
        for i, name in enumerate(names):
            for at in cls._probes(per_language[name]):
                slots[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
            fill[i] = np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
        return cls(names, slots, fill**PROBES)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of n-grams it knows, corrected for false positives."""
        grams = ngrams(text or "")
        if not len(grams):
            return "und", 0.0
        if not self.languages:
            return "und", 0.0
        hits = np.zeros(len(self.languages))
        for at in range(0, len(grams), 1 << 18):
            part = grams[at : at + (1 << 18)]
            masks = self.slots[(probes := self._probes(part))[0]]
            for more in probes[1:]:
                masks = masks & self.slots[more]
            for i in range(len(hits)):
                hits[i] += np.count_nonzero(masks[:, i // 64] & (np.uint64(1) << np.uint64(i % 64)))
        n = len(grams)
        real = np.clip((hits - n * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive), 0, n)
        best = int(np.argmax(real))
        return self.languages[best], float(real[best] / n)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Filters from about `sample_docs` documents of each language, chosen by a hash of the id, outside the held-out fold.

    The n-grams that reach the driver are bounded by n-grams in a document / MIN_SHARE for each language.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("out")).where(
        "not out and id is not null and text is not null and lang is not null"
    )
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))]) if sizes else None
    if share is None:
        return LanguageFilters.build({})
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for at in range(0, len(part), 200):
                    found = [np.unique(ngrams(t)) for t in part.text[at : at + 200]]
                    values, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": n, "docs": 0})
                yield pd.DataFrame({"lang": [lang], "gram": [0], "n": [0], "docs": [len(part)]})

    counted = sample.select("lang", "text").mapInPandas(grams, "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sampled = {k: min(n, sample_docs) for k, n in sizes.items()}
    least = F.create_map(*[x for k, n in sampled.items() for x in (F.lit(k), F.lit(float(max(2 if n > 3 else 1, n * MIN_SHARE))))])
    kept = counted.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toPandas()
    learned = {k: np.zeros(0, dtype=np.uint64) for k in sizes}
    learned |= {k: v.gram.to_numpy().astype(np.uint64) for k, v in kept.groupby("lang")}
    return LanguageFilters.build(learned)


def identify_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: `id_col`, held_out, lang_pred, score and, with `carry`, the whole row as `carried`.

    Null texts and texts without a letter are `und` with score 0. Ties go to
    the first language by name. Repeated rows get equal results; a null id is
    never held out and never learned from. An empty table gives none; with
    nothing to learn from, every row is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**SLOT_BITS words of 64 languages each
    d = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.struct(*([F.col("*")] if carry else [F.col(text_col)])).alias("carried"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = d.withColumn("p", predict(F.col("carried")[text_col]))
    return found.select(F.col("id").alias(id_col), "held_out", "p.lang_pred", "p.score", *(["carried"] if carry else []))


def keep_identified(docs: DataFrame, filters: LanguageFilters, min_score: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose language was found with at least `min_score`.

    Null and empty texts, and texts without a letter, have no language and go,
    however long texts are read whole. Rows that repeat stay or go together;
    a null id changes nothing. Columns of any name come back as they were. An
    empty table, or filters without a language, give none.
    """
    found = identify_languages(docs, filters, carry=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("carried.*")
