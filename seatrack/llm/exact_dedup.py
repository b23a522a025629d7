"""Operator 7: exact duplicates by sorting whole normalised contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import lower_az, saved

#: A text with more than this share of all rows is hot; there are at most 1 / share of them, so their table can be broadcast.
HOT_SHARE = 1e-3
#: Rows of a hot text in one run of the sort, as a share of all rows.
RUN_SHARE = 2.5e-4
MIN_HOT = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: `id_col`, keep_id, group_size, kept, text_sha256 and, with `carry`, the whole row as `carried`.

    Rows are range-partitioned by sampled splitters on the head of the
    normalised text and its digest, sorted by the whole normalised text, and
    neighbours are compared in full. Of equal texts the row with the largest id
    stays. Texts with more than HOT_SHARE of the rows are split into several
    sorted runs first; the heads of the runs are merged afterwards.

    Null counts as the empty text, and all empty texts are equal. Rows that
    repeat both id and text are copies of each other: one of them stays. A null
    id is below all others; where all ids of a group are null, keep_id is null
    and one row stays. An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.struct(*([F.col("*")] if carry else [F.col(text_col)])).alias("carried"))
    body = F.coalesce(F.col("carried")[text_col], F.lit(""))
    norm = lower_az(body)
    keyed = d.withColumn("text_sha256", F.sha2(norm, 256)).withColumn("head", F.substring(norm, 1, 32))
    counts = keyed.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    hot = saved(
        counts.where(F.col("n") > max(MIN_HOT, total * HOT_SHARE)).select(
            F.col("text_sha256").alias("hot_sha"), F.ceil(F.col("n") / max(MIN_HOT / 4, total * RUN_SHARE)).alias("runs")
        )
    )
    keyed = keyed.join(F.broadcast(hot), F.col("text_sha256") == F.col("hot_sha"), "left").withColumn(
        "run", F.when(F.col("runs").isNull(), F.lit(-1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("runs")))
    )
    # the clustering of the window is met by the range partitioning, so no second shuffle follows
    ranged = keyed.drop("hot_sha", "runs").repartitionByRange("head", "text_sha256", "run").withColumn("norm", norm)
    equal = Window.partitionBy("head", "text_sha256", "run", "norm")
    marked = (
        ranged.withColumn("keep_id", F.max("id").over(equal))
        .withColumn("group_size", F.count(F.lit(1)).over(equal))
        .withColumn("at", F.row_number().over(equal.orderBy(F.desc_nulls_last("id"))))
        .drop("norm", "head")
    )
    out = [F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", *([F.col("carried")] if carry else [])]
    if hot.isEmpty():
        return marked.withColumn("kept", F.col("at") == 1).select(*out)
    heads = marked.where((F.col("run") >= 0) & (F.col("at") == 1)).select("text_sha256", "keep_id", "group_size", "run")
    merged = heads.groupBy("text_sha256").agg(
        F.max(F.struct("keep_id", "run")).alias("first"), F.sum("group_size").alias("all_rows")
    )
    both = marked.join(F.broadcast(merged), "text_sha256", "left")
    split = F.col("first").isNotNull()
    return (
        both.withColumn("kept", (F.col("at") == 1) & (~split | (F.col("run") == F.col("first.run"))))
        .withColumn("keep_id", F.when(split, F.col("first.keep_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.when(split, F.col("all_rows")).otherwise(F.col("group_size")))
        .select(*out)
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns: of those with equal texts, the one with the largest id.

    Null counts as the empty text, so one of all null and empty texts stays.
    Of rows that repeat id and text, or that all lack an id, one stays; a null
    id is below all others. Columns of any name come back as they were. An
    empty table gives none.
    """
    return exact_groups(docs, id_col, text_col, carry=True).where("kept").select("carried.*")
