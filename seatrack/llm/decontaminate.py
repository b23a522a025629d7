"""Operator 9: benchmark passages in training documents, by exact word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved, words_az

WINDOW = 10
#: The window table is broadcast only up to this many windows and bytes; beyond, the same join is a shuffle.
MAX_BROADCAST_WINDOWS = 2_000_000
MAX_BROADCAST_BYTES = 256_000_000


def _windows(words, size):
    return F.when(
        F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    )


def _window_hashes(words, size):
    """One 64-bit hash for each window, without building its string."""
    return F.when(
        F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: gram, n_words, items (ids as sorted strings).

    An item of fewer words than the window, but not none, is one window; a null
    or empty item has none. A null item id marks hits but is listed nowhere.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_az(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n_words", F.least(F.size("words"), F.lit(window)))
    return (
        items.select("item", "n_words", F.explode(_windows(F.col("words"), F.col("n_words"))).alias("gram"))
        .groupBy("gram", "n_words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """Per row: `id_col`, n_words, n_hit, items (array), spans (array of start, length in words) and, with `carry`, the whole row as `carried`.

    Words are runs of other than ASCII non-alphanumerics, A-Z lower-cased. A
    word inside any occurrence of a window is hit. Windows meet by a hash and
    are then compared as whole strings, so no hash can be wrong.

    Null and empty texts have no words. Rows that repeat id and text get equal
    rows each; rows with a null id are told apart by their texts. Extra columns
    are ignored unless carried. Empty tables give an empty result or no hits.
    """
    grams = benchmark_windows(benchmark, window, text_col="text").withColumn("gram_hash", F.xxhash64(F.split("gram", " ")))
    grams = saved(grams)
    about = grams.agg(F.count(F.lit(1)), F.sum(F.octet_length("gram")), F.collect_set("n_words")).first()
    small = about[0] <= MAX_BROADCAST_WINDOWS and (about[1] or 0) <= MAX_BROADCAST_BYTES
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.struct(*([F.col("*")] if carry else [F.col(text_col)])).alias("carried"))
    words = words_az(F.col("carried")[text_col])
    hits = None
    for size in sorted(about[2] or []):  # at most `window` different sizes
        own = grams.where(F.col("n_words") == size).select("gram_hash", "gram", "items")
        at = d.select("id", "text_hash", words.alias("words")).select(
            "id", "text_hash", F.posexplode(_window_hashes(F.col("words"), F.lit(size))).alias("start", "gram_hash")
        )
        found = at.join(F.broadcast(own) if small else own, "gram_hash").select("id", "text_hash", "start", F.lit(size).alias("length"), "gram", "items")
        hits = found if hits is None else hits.unionByName(found)
    spot = "array<struct<start:int,length:int,gram:string,items:array<string>>>"
    sized = d.select("id", "text_hash", F.coalesce(F.size(words), F.lit(0)).alias("n_words"), "carried")
    sized = sized.withColumn("n_words", F.greatest(F.col("n_words"), F.lit(0)).cast("long"))
    if hits is None:
        found = sized.withColumn("met", F.array().cast(spot))
    else:
        per_doc = hits.groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
            F.collect_set(F.struct("start", "length", "gram", "items")).alias("met")
        )
        found = sized.join(per_doc, (F.col("text_hash") == F.col("hit_hash")) & F.col("id").eqNullSafe(F.col("hit_id")), "left")
    # a text without hits is not split again; the outer array binds the words of the others once
    same = F.transform(F.array(words), lambda w: F.filter("met", lambda s: F.array_join(F.slice(w, s["start"] + 1, s["length"]), " ") == s["gram"]))[0]
    whole = ["carried"] if carry else []
    found = found.select("id", *whole, "n_words", F.coalesce(F.when(F.col("met").isNotNull(), same), F.array().cast(spot)).alias("met")).select(
        "id", *whole, "n_words",
        F.array_sort(F.transform("met", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda s: s["items"])))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return found.select(F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), "items", "spans", *whole)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark window.

    Null and empty texts hold none and stay; long texts are read whole. Rows
    that repeat stay or go together, those without an id by their own text.
    Columns of any name come back as they were. Without benchmark items all
    rows stay; an empty table gives none.
    """
    return contamination(docs, benchmark, window, carry=True).where("n_hit = 0").select("carried.*")
