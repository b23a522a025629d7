"""Operator 3: lines that many documents share are kept in one document only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved

#: A key with this share of the common lines is hot; there are at most 1 / share of them, so their hashes can be broadcast.
HOT_SHARE = 1e-3
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends and with A-Z lower-cased (bytes.lower changes nothing else)."""
    return line.strip(_BLANK).lower()


def _hash_if_long(line: bytes, min_chars: int) -> bytes | None:
    key = line_key(line)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_lines(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                ids, keys = [], []
                for key, text in zip(batch.id[at : at + 1000], batch.text[at : at + 1000], strict=True):
                    found = {_hash_if_long(x, min_chars) for x in (text or "").encode().split(b"\n")} - {None}
                    ids += [key] * len(found)
                    keys += found
                yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "key": pd.Series(keys, dtype=object)})

    return run


def _reassemble(min_chars: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                out = []
                part = batch.iloc[at : at + 1000]
                for key, text, lost in zip(part.id, part.text, part.lost, strict=True):
                    raw = (text or "").encode()
                    n, dropped = raw.count(b"\n") + 1, 0
                    if lost is not None and len(lost):
                        lost = {bytes(x) for x in lost}
                        kept = [x for x in raw.split(b"\n") if _hash_if_long(x, min_chars) not in lost]
                        dropped, raw = n - len(kept), b"\n".join(kept)
                    out.append((key, n, dropped, hashlib.sha256(raw).hexdigest(), *([raw.decode()] if texts else [])))
                yield pd.DataFrame(out, columns=["id", "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if texts else [])]).astype({"id": object})

    return run


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, texts: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: `id_col`, n_lines, n_dropped, kept_sha256 and, with `texts`, kept_text.

    A line's key drops ASCII white space at the ends and lower-cases A-Z. A key
    of at least `min_chars` code points found in at least `min_docs` documents
    keeps its lines in the largest id holding it only; a repeated line inside
    that document stays repeated. The remaining lines keep their order.

    Null and empty texts are one empty line. Rows that repeat an id are one
    document for counting, yet each row gives a result row. Rows with a null id
    are together one document, below all others. If only they hold a key,
    nothing is dropped. Extra columns are ignored; an empty table gives none.

    Line hashes have 128 bits. Counting is combined before the shuffle, so a
    line in a third of all documents is one row for each task. In the joins the
    rows of hot keys are dealt over all partitions, and their few keys are sent
    to each.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    lines = d.mapInPandas(_long_lines(min_chars), f"id {kind}, key binary")
    # rows of a key bound its documents from above, which leaves few keys for the exact count
    often = saved(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(often.where(F.col("n") >= total * HOT_SHARE).select("key", F.lit(True).alias("hot")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(F.lit(0).cast("long")).alias("part")
    dealt = lines.join(hot, "key", "left").select("id", "key", part)
    everywhere = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    sent = lambda keys: keys.join(hot, "key", "left").select(*keys.columns, F.explode(everywhere).alias("part"))
    held = dealt.join(sent(often.select("key")), ["key", "part"]).distinct()
    common = (
        held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep")
    )
    lost = (
        held.join(sent(common), ["key", "part"]).where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id").agg(F.collect_set("key").alias("lost"))
    ).withColumnRenamed("id", "lost_id")
    out = f"id {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts
    return (
        d.join(lost, d.id.eqNullSafe(lost.lost_id), "left").select("id", "text", "lost")
        .mapInPandas(_reassemble(min_chars, texts), out).withColumnRenamed("id", id_col)
    )
