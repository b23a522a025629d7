"""Operator 6: paragraphs, and passages inside them, that repeat across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD_BYTES, frees_shuffles, grams, hashes_of, minhashes_of, mixed, portions, saved, shingles_of
from .near import meeting, similar_classes

THRESHOLD = 0.8
#: A pair at the threshold shares a band with at least this probability.
TARGET_RECALL = 0.995
#: Minimum hashes of a paragraph that the bands may use together.
MAX_HASHES = 24
#: A shorter paragraph is never a candidate.
MIN_PARAGRAPH_WORDS = 20
#: Runs of this many words that an earlier document holds too are cut.
MIN_PASSAGE = 20
#: Anchors are hashes of ANCHOR words; each window of MIN_PASSAGE words has the least of its anchors, so equal windows have equal ones.
ANCHOR = 8
#: Multipliers (odd, with their inverses modulo 2**64) of the two halves of a run's 128-bit hash.
_BASES = [(np.uint64(r), np.uint64(pow(r, -1, 2**64)), np.uint64(seed)) for r, seed in ((0x9E3779B97F4A7C15, 1), (0xD6E8FEB86659FD93, 2))]
_DOC, _LINE, _RUN, _AGAIN = 0, 1, 2, 3


def tuned_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, so the fewest chance meetings, whose bands reach the recall with `most` hashes or fewer; one row a band if none does."""
    best = None
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if meeting(threshold, b, rows) >= recall), None)
        best = (bands, rows) if bands else best
    return best or (most, 1)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each word."""
    flat = raw.translate(WORD_BYTES)
    inside = np.frombuffer(flat, dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return hashes_of([flat.split()])[0], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a hash of each run of words [first, stop)."""
    out = []
    for base, inverse, seed in _BASES:
        up, down = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(len(hashes), x, dtype=np.uint64)))) for x in (base, inverse))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(hashes + seed) * up[:-1])))
        out.append(mixed((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def stretches(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first word, word after the last) of each run of windows of MIN_PASSAGE words with one anchor; line ends count for nothing.

    hashes: the words of all texts in a row, `counts` of each; places count from the first word of all.
    """
    if len(hashes) < MIN_PASSAGE:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    least, width = grams(hashes, ANCHOR), 1
    wanted = MIN_PASSAGE - ANCHOR + 1
    while width < wanted:  # minimum over `width` grams, doubled
        step = min(width, wanted - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(text[: len(least)] == text[MIN_PASSAGE - 1 :])
    if not len(whole):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    least, at = least[whole], text[whole]
    fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(whole)) - 1
    return at[first], least[first].view(np.int64), whole[first], whole[last] + MIN_PASSAGE


def _units(bands: int, rows: int):
    """For each document: itself (_DOC: words, paragraphs, and 1 in `rest` if its id is null), its paragraphs that are candidates (_LINE, with key and signature) and its stretches (_RUN, or _AGAIN if an earlier one of the document has its anchor; with anchor and rest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.text]
            for a, b in portions([len(r) for r in raws]):
                lines = [r.split(b"\n") for r in raws[a:b]]
                n_lines = np.fromiter(map(len, lines), dtype=np.int64, count=b - a)
                hashes, in_line = hashes_of([x.translate(WORD_BYTES).split() for ls in lines for x in ls])
                doc_of_line = np.repeat(np.arange(b - a), n_lines)
                n_words = np.bincount(doc_of_line, weights=in_line, minlength=b - a).astype(np.int64)
                begin = np.cumsum(n_words) - n_words
                ids, same = batch.id.to_numpy()[a:b], batch.doc_key.to_numpy()[a:b]

                def told(doc, kind, first, stop, anchor=None, rest=None, key=None, signature=None):
                    none = pd.Series([pd.NA] * len(doc), dtype="Int64")
                    return pd.DataFrame({
                        "id": ids[doc], "doc_key": same[doc], "kind": np.full(len(doc), kind, dtype=np.int8) if np.isscalar(kind) else kind, "first": first, "stop": stop,  # noqa: B023
                        "anchor": none if anchor is None else anchor, "rest": none if rest is None else rest, "key": key, "signature": signature,
                    })

                yield told(np.arange(b - a), _DOC, n_words, n_lines, rest=batch.nameless.to_numpy()[a:b].astype(np.int64))
                long = in_line >= MIN_PARAGRAPH_WORDS
                starts = (np.cumsum(in_line) - in_line)[long]
                signs = minhashes_of(*shingles_of(hashes[np.repeat(long, in_line)], in_line[long]), bands * rows)
                keys = [xxhash.xxh3_128_digest(hashes[p : p + n].tobytes()) for p, n in zip(starts.tolist(), in_line[long].tolist(), strict=True)]
                doc = doc_of_line[long]
                first = starts - begin[doc]
                yield told(doc, _LINE, first, first + in_line[long], key=keys, signature=[s.tobytes() for s in signs])
                doc, anchor, first, stop = stretches(hashes, n_words)
                rest = run_hashes(hashes, first, stop)[1]
                order = np.lexsort((anchor, doc))
                again = np.zeros(len(doc), dtype=bool)
                again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
                yield told(doc, np.where(again, _AGAIN, _RUN).astype(np.int8), first - begin[doc], stop - begin[doc], anchor, rest)

    return run


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merge(found: pd.Series) -> pd.Series:
    return found.map(lambda spans: [{"first": a, "stop": b} for a, b in merged_spans([(s["first"], s["stop"]) for s in spans])])


@frees_shuffles
def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, n_words, n_paragraphs, n_removed_words, n_spans, spans (word positions first, stop).

    Paragraphs are the lines of the text. Those of MIN_PARAGRAPH_WORDS words or
    more are banded by MinHash over five-word shingles, with bands tuned for
    the recall; colliding ones meet their bucket's pivot and then, block by
    block, all whose clusters still differ; exact Jaccard verifies them and
    components cluster them. A cluster found in two or more documents stays in
    the least of them, by id, and goes from the others. Every run of
    MIN_PASSAGE words that a document before it holds too goes, wherever it
    begins or lines end: windows of that length meet by their anchors, and
    those not settled by whole stretches are compared one by one.

    Null and empty texts have one paragraph without words, and nothing goes.
    Rows that repeat id and text are one document, with equal result rows.
    Null ids rank as 0, told apart by their texts. Extra columns are ignored;
    an empty table gives none.
    """
    bands, rows = tuned_bands(threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    # without nulls, ids keep their type in pandas
    nil = F.lit("0").cast(kind)
    d = docs.select(F.coalesce(F.col(id_col), nil).alias("id"), F.col(id_col).isNull().alias("nameless"), F.xxhash64(id_col, text_col).alias("doc_key"), F.col(text_col).alias("text"))
    units = saved(d.mapInPandas(_units(bands, rows), f"id {kind}, doc_key long, kind byte, first int, stop int, anchor long, rest long, key binary, signature binary"))
    lines = units.where(F.col("kind") == _LINE)
    place = F.struct("id", "doc_key")

    def asked_texts(spans: DataFrame) -> DataFrame:
        """(id, doc_key, text, spans) of the documents that spans(doc_key, span) name, each once."""
        asked = spans.groupBy(F.col("doc_key").alias("asked_key")).agg(F.collect_set("span").alias("spans"))
        # rows that repeat a document are equal, so any of them will do
        return d.join(asked, d.doc_key == asked.asked_key).dropDuplicates(["doc_key"]).select("id", "doc_key", "text", "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.text, batch.spans, strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                _, starts, ends = _words(raw)
                out += [(s["node"], raw[starts[s["first"]] : ends[s["stop"] - 1]].decode("utf-8", "replace")) for s in spans]
            yield pd.DataFrame(out, columns=["node", "text"])

    # one node for each sequence of words, with a place where it is found
    nodes = lines.groupBy("key").agg(
        F.first("signature").alias("signature"), F.min(F.struct("doc_key", "first", "stop")).alias("at"), F.max("doc_key").alias("high")
    )
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "signature", "at", (F.col("at.doc_key") < F.col("high")).alias("several")))

    def texts_of(named: DataFrame) -> DataFrame:
        spans = nodes.select("node", "at").join(named, "node").select("at.doc_key", F.struct("node", "at.first", "at.stop").alias("span"))
        return asked_texts(spans).mapInPandas(cut, "node long, text string")

    roots, _ = similar_classes(nodes, texts_of, bands, rows, TARGET_RECALL, threshold)
    # a paragraph can go if another document has its words, or words like them
    clusters = nodes.select("node", "key", "several").join(roots, "node", "left").where("several or root is not null").select("key", F.coalesce("root", "node").alias("cluster"))
    clusters = lines.select("id", "doc_key", "first", "stop", "key").join(clusters, "key").drop("key")

    def lost_of(rows: DataFrame, *key: str) -> DataFrame:
        # written, so that the grouping's shuffle is gone before the join has its own
        shared = saved(rows.groupBy(*key).agg(F.min(place).alias("keep"), F.max("doc_key").alias("high"), F.min("doc_key").alias("low")).where("low <> high").select(*key, F.col("keep.doc_key").alias("keep_key")))
        return rows.join(shared, [*key]).where("doc_key <> keep_key").select("doc_key", "first", "stop")

    # runs whose anchor is in several documents; of the stretches of one anchor, each distinct one stays in its least document
    runs = units.where(F.col("kind") >= _RUN)
    span = (F.shiftleft(F.col("first").cast("long"), 32) + F.col("stop")).alias("span")
    shared = saved(runs.where(F.col("kind") == _RUN).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    # the shared anchors are few beside the runs, which need no sorting then
    met = saved(runs.select("id", "doc_key", span, "anchor", "rest").join(shared.hint("shuffle_hash"), "anchor"))
    heads = met.groupBy("anchor", "rest").agg(F.min(place).alias("keep")).select("anchor", "rest", F.col("keep.doc_key").alias("keep_key"))
    # what a first stretch shares with a different one of its anchor is asked below
    differ = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("differing"))
    heads = heads.join(differ, F.col("anchor") == F.col("differing"), "left").select("anchor", "rest", "keep_key", F.col("differing").isNotNull().alias("differ"))
    told = saved(met.join(heads, ["anchor", "rest"]).where("doc_key <> keep_key or differ").select("doc_key", "span", (F.col("doc_key") != F.col("keep_key")).alias("lost")))
    lost_runs = told.where("lost").select("doc_key", F.shiftright("span", 32).cast("int").alias("first"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int").alias("stop"))
    left = told.where("not lost").select("doc_key", "span")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.text]
            for a, b in portions([len(r) for r in raws]):
                hashes, counts = hashes_of([r.translate(WORD_BYTES).split() for r in raws[a:b]])
                asked = [np.asarray(x, dtype=np.int64) for x in batch.spans[a:b]]
                spans, doc = np.concatenate(asked), np.repeat(np.arange(b - a), [len(x) for x in asked])
                first = spans >> 32
                n = (spans & 0xFFFFFFFF) - MIN_PASSAGE + 1 - first
                doc, first = np.repeat(doc, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = first + (np.cumsum(counts) - counts)[doc]
                one, two = run_hashes(hashes, begin, begin + MIN_PASSAGE)
                yield pd.DataFrame({"id": batch.id.to_numpy()[a:b][doc], "doc_key": batch.doc_key.to_numpy()[a:b][doc], "first": first, "stop": first + MIN_PASSAGE, "one": one, "two": two})

    opened = saved(asked_texts(left).mapInPandas(windows, f"id {kind}, doc_key long, first int, stop int, one long, two long"))
    lost = lost_of(clusters, "cluster").unionByName(lost_runs).unionByName(lost_of(opened, "one", "two"))
    lost = lost.groupBy(F.col("doc_key").alias("lost_key")).agg(F.collect_set(F.struct("first", "stop")).alias("lost"))
    lost = lost.select("lost_key", F.pandas_udf(_merge, "array<struct<first:int,stop:int>>")("lost").alias("spans"))
    about = units.where(F.col("kind") == _DOC).select(F.when(F.col("rest") == 0, F.col("id")).alias("id"), "doc_key", F.col("first").alias("n_words"), F.col("stop").alias("n_paragraphs"))
    out = about.join(lost, about.doc_key == lost.lost_key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:int,stop:int>>")))
    removed = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["stop"] - s["first"])
    return out.select(F.col("id").alias(id_col), "n_words", "n_paragraphs", removed.alias("n_removed_words"), F.size("spans").alias("n_spans"), "spans")


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text, cut):
        if text is None or cut is None or not len(cut):
            return text
        raw = text.encode("utf-8", "surrogatepass")
        _, starts, ends = _words(raw)
        kept, at = [], 0
        for s in cut:
            kept.append(raw[at : starts[s["first"]]])
            at = ends[s["stop"] - 1]
        return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")

    return pd.Series([one(t, c) for t, c in zip(texts, spans, strict=True)], dtype=object)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns whatever their names, with the repeated passages cut out of the text; ids must be unique.

    A text without any stays as it is, null and empty ones too. An empty table gives none.
    """
    carried = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("carried"))
    spans = repeated_passages(docs, id_col=id_col, text_col=text_col).where("n_spans > 0").select(F.col(id_col).alias("cut_id"), "spans")
    both = carried.join(spans, carried.id.eqNullSafe(spans.cut_id), "left")
    without = F.pandas_udf(_without, "string")
    return both.select(*[without("text", "spans").alias(c) if c == text_col else F.col(f"carried.`{c}`") for c in docs.columns])
