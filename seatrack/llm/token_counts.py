"""Operator 1: exact token counts from pre-token frequencies, without any token ids in Spark rows."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved

#: A pre-token with at least this share of all occurrences is frequent; there can be no more than 1 / share of them.
FREQUENT_SHARE = 1e-6
#: Longer pre-tokens are broadcast by their digest, which bounds the broadcast table's bytes.
FREQUENT_BYTES = 64
#: In these characters every Unicode version agrees on letters, numbers, lower case and composition.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-ȠȢ-ȳ]*")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        _loaded[path] = t, regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    return _loaded[path]


def pretokens(text: str | None, path: str) -> Counter:
    """Pre-tokens of a text as the tokenizer file's own rules split it, special strings kept whole."""
    tokenizer, special = _tokenizer(path)
    found: Counter = Counter()
    parts = special.split(text or "") if special else [text or ""]
    for i, part in enumerate(parts):
        if i % 2:
            found[part] += 1
        elif _PLAIN.fullmatch(part):
            found.update(_PIECES.findall(part.lower()))
        elif part:
            flat = tokenizer.normalizer.normalize_str(part)
            found.update(flat[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(flat))
    return found


def _name(piece: str) -> str:
    """The pre-token, or a digest where it is long; no pre-token holds a line feed."""
    if len(piece) <= FREQUENT_BYTES // 4 or len(raw := piece.encode()) <= FREQUENT_BYTES:
        return piece
    return "\n" + hashlib.md5(raw, usedforsecurity=False).hexdigest()


def _totals(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.text:
                seen.update(pretokens(text, path))
            yield pd.DataFrame({"piece": list(seen), "n": list(seen.values())})

    return run


def _per_document(path: str, frequent):
    """A row (row, id, n_bytes, key, n): first the pieces of a document's frequent pre-tokens, then each other pre-token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frequent.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                out: list = []
                part = batch.iloc[at : at + 500]
                for row, key, text in zip(part.row, part.id, part.text, strict=True):
                    total, rest = 0, []
                    for piece, freq in pretokens(text, path).items():
                        if (n := known.get(_name(piece))) is None:
                            rest.append((row, None, None, piece, freq))
                        else:
                            total += n * freq
                    # this key meets no pre-token and spreads evenly
                    out.append((row, key, len((text or "").encode()), f"\n{row}", total))
                    out += rest
                yield pd.DataFrame(out, columns=["row", "id", "n_bytes", "piece", "n"]).astype({"id": object, "n_bytes": "Int64"})

    return run


def _lengths(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, _ = _tokenizer(path)
        for batch in batches:
            found = tokenizer.encode_batch_fast(list(batch.piece), add_special_tokens=False)
            yield batch.assign(n_pieces=[len(x.ids) for x in found])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_bytes, n_tokens.

    Distinct pre-tokens are counted over the whole corpus and each one is
    encoded once. Frequent pre-tokens (at most 1 / FREQUENT_SHARE of them by
    construction) are looked up by broadcast; the tail is joined by a shuffle
    of (row, pre-token, frequency).

    Null and empty texts have 0 bytes and 0 tokens. Repeated ids and repeated
    rows keep one result row each; a null id stays null. Extra columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    totals = d.select("text").mapInPandas(_totals(tokenizer_path), "piece string, n long")
    pieces = saved(
        totals.groupBy("piece").agg(F.sum("n").alias("n")).mapInPandas(_lengths(tokenizer_path), "piece string, n long, n_pieces long")
    )
    total = pieces.agg(F.sum("n")).first()[0] or 0
    is_frequent = F.col("n") >= max(2, total * FREQUENT_SHARE)
    name = F.when(F.octet_length("piece") <= FREQUENT_BYTES, F.col("piece")).otherwise(F.concat(F.lit("\n"), F.md5("piece")))
    frequent = pieces.where(is_frequent).select(name.alias("piece"), "n_pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(frequent.piece, frequent.n_pieces.tolist(), strict=True)))
    tail = pieces.where(~is_frequent).select("piece", "n_pieces")
    kind = d.schema["id"].dataType.simpleString()
    per_doc = d.mapInPandas(_per_document(tokenizer_path, known), f"row long, id {kind}, n_bytes long, piece string, n long")
    return (
        per_doc.join(tail, "piece", "left")
        .groupBy("row")
        .agg(
            F.max("id").alias(id_col),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(1))).alias("n_tokens"),
        )
        .drop("row")
    )
