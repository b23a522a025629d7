"""Operator 10: documents with similar five-word shingle sets, by a MinHash LSH forest."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD_BYTES, hashes_of, minhashes_of, portions, saved, shingles_of
from .near import links_within_classes, similar_classes

THRESHOLD = 0.8
TREES = 12
DEPTH = 8
TARGET_RECALL = 0.995


def _signatures(trees: int, depth: int):
    @F.pandas_udf("key binary, signature binary")
    def sign(texts: pd.Series) -> pd.DataFrame:
        keys, signatures = [], []
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for first, stop in portions([len(r) for r in raws]):
            hashes, counts = hashes_of([r.translate(WORD_BYTES).split() for r in raws[first:stop]])
            signs = minhashes_of(*shingles_of(hashes, counts), trees * depth)
            at = 0
            for n, s in zip(counts.tolist(), signs, strict=True):
                keys.append(xxhash.xxh3_128_digest(hashes[at : at + n].tobytes()) if n else None)
                signatures.append(s.tobytes() if n else None)
                at += n
        return pd.DataFrame({"key": keys, "signature": signatures})

    return sign


def _signed_and_classes(d: DataFrame, threshold: float, trees: int, depth: int, recall: float, counted: bool) -> tuple[DataFrame, DataFrame]:
    """From d(id, text, ...): its rows with row, key and signature, and for each distinct text its class, and its links if they are `counted`."""
    signed = d.withColumn("row", F.monotonically_increasing_id()).withColumn("s", _signatures(trees, depth)("text"))
    signed = saved(signed.select(*d.columns, "row", "s.key", "s.signature"))
    copies = signed.where("key is not null").groupBy("key").agg(
        F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.first("signature").alias("signature"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    )
    copies = saved(copies.select(F.col("first.row").alias("node"), "key", "copy_id", "n_copies", "signature"))

    def texts_of(named: DataFrame) -> DataFrame:
        return signed.select(F.col("row").alias("node"), "text").join(named, "node")

    roots, held = similar_classes(copies, texts_of, trees, depth, recall, threshold)
    classes = copies.drop("signature").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if counted:
        classes = classes.join(links_within_classes(roots, held, threshold), "node", "left")
    n_links = F.coalesce("n", F.lit(0).cast("long")) if counted else F.lit(None).cast("long")
    classes = classes.withColumn("n_links", n_links)
    heads = classes.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "node")).alias("best"))
    return signed, classes.join(heads, "root").select("key", "class_id", "copy_id", "n_copies", "n_links", F.col("best.node").alias("kept_row"))


def similar_documents(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = TARGET_RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: `id_col`, class_id, copy_id, n_copies, n_links, kept.

    Texts with the same words in the same order are copies: copy_id is their
    least id, n_copies their number, and they enter the forest once. In every
    tree, rows that share a prefix of their signature meet, the full prefix
    first and then ever shorter ones until the recall told from the links found
    reaches the target. Links are verified by exact Jaccard and joined to
    classes, and all pairs whose classes still differ are compared, block by
    block, in the runs of 24 prefixes and further pieces of four values each:
    a pair at the threshold shares one of them with 0.99999. class_id is the
    least id of its component and `kept` marks one row of each class. n_links
    is the number of other texts that the text is linked to, with all pairs
    inside a class compared.

    Words and shingles follow op9's word rule; a text of fewer than five words
    is one shingle. Texts without a word (null, empty) are like nothing: each
    row is its own class, is kept, and has n_copies 1. Rows that repeat an id
    are copies or not by their texts, and of equal rows one is kept. Null ids
    rank below none: the least id that is not null names the class. Extra
    columns are ignored; an empty table gives none.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed, classes = _signed_and_classes(d, threshold, trees, depth, recall, True)
    told = classes.withColumnRenamed("key", "told")
    return signed.select("row", "id", "key").join(told, F.col("key") == F.col("told"), "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("told").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("told").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.col("told").isNull() | (F.col("row") == F.col("kept_row"))).alias("kept"),
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, of which one of each class stays.

    Every row without a word (null, empty) stays, of repeated rows one does.
    Null ids come last when the least id stays. An empty table gives none.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("carried"))
    signed, classes = _signed_and_classes(d, THRESHOLD, TREES, DEPTH, TARGET_RECALL, False)
    lost = signed.select("row", "key").join(classes, "key").where("row <> kept_row").select(F.col("row").alias("lost_row"))
    stay = signed.join(lost, F.col("row") == F.col("lost_row"), "left_anti")
    return stay.select(*[F.col("text").alias(c) if c == text_col else F.col(f"carried.`{c}`") for c in docs.columns])
