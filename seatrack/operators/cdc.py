"""Registry changes: parsing, the monotone guard, audit and online rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_TENANT = "00000000-0000-0000-0000-000000000000"
_UUID = r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
TABLES = ("vessels", "watchlist", "sanctions_flags")
_HIDDEN = ("entity_id", "feature_name", "lsn", "deleted")


def parse_envelopes(messages: DataFrame) -> DataFrame:
    """Kind (change, tombstone, skip, error), error, and the fields of a change. messages: seq, topic, key, value.

    Heartbeats and schema changes are skipped, an empty value is a tombstone.
    A change needs a known table, an operation c, u, d or r, an lsn and a key.
    """
    v = F.try_parse_json("value")
    wrapped = F.try_variant_get(v, "$.payload", "variant")
    body = F.coalesce(wrapped, v)
    get = lambda path, kind="string": F.try_variant_get(F.col("body"), path, kind)
    m = messages.withColumn("body", body).withColumn("op", get("$.op")).withColumn("event_table", get("$.source.table"))
    m = m.withColumn("lsn", get("$.source.lsn", "long")).withColumn("ts_ms", get("$.ts_ms", "long"))
    m = m.withColumn("before", get("$.before")).withColumn("after", get("$.after"))
    k = F.try_parse_json("key")
    m = m.withColumn("pk", F.coalesce(F.try_variant_get(k, "$.payload", "string"), F.try_variant_get(k, "$", "string")))
    skip = F.when(F.lower("topic").contains("heartbeat"), "heartbeat").when(F.lower("topic").contains("schema"), "schema_change").when(get("$.ddl").isNotNull(), "schema_change")
    error = (
        F.when(F.col("body").isNull(), "bad json").when(F.col("op").isNull() | ~F.col("op").isin("c", "u", "d", "r"), "unknown op")
        .when(F.col("event_table").isNull() | ~F.col("event_table").isin(*TABLES), "unknown table").when(F.col("lsn").isNull(), "missing lsn").when(F.col("pk").isNull(), "missing key")
    )
    empty = F.col("value").isNull() | (F.col("value") == "null")
    kind = F.when(skip.isNotNull(), "skip").when(empty, "tombstone").when(error.isNotNull(), "error").otherwise("change")
    return m.select("seq", "topic", kind.alias("kind"), skip.alias("skip_reason"), F.when(kind == "error", error).alias("error"), "event_table", "pk", "op", "lsn", "ts_ms", "before", "after")


def normalize_tenant(df: DataFrame) -> DataFrame:
    """tenant_id from key_tenant, before_tenant and after_tenant; they must agree and be UUIDs, or tenant_error says why. None is the zero UUID."""
    told = F.array_distinct(F.array_compact(F.array(*[F.lower(c) for c in ("key_tenant", "before_tenant", "after_tenant")])))
    first = F.coalesce(F.try_element_at(told, F.lit(1)), F.lit(NO_TENANT))
    error = F.when(F.size(told) > 1, "tenants differ").when(~first.rlike(_UUID), "no uuid")
    return df.withColumn("tenant_error", error).withColumn("tenant_id", F.when(error.isNull(), first))


def guard_verdicts(changes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Applied for each delivery (event_table, pk, op, lsn, seq, optional content_error): its guard exceeds that of every earlier one of the key.

    Snapshot rows have guard 0. Deliveries with a content error take no part.
    stored (event_table, pk, lsn) is what was applied before.
    """
    guard = F.when(F.col("op") == "r", F.lit(0).cast("long")).otherwise(F.col("lsn"))
    bad = F.coalesce(F.col("content_error"), F.lit(False)) if "content_error" in changes.columns else F.lit(False)
    c = changes.withColumn("guard_lsn", guard).withColumn("_bad", bad)
    w = Window.partitionBy("event_table", "pk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(~F.col("_bad"), F.col("guard_lsn"))).over(w)
    if stored is not None:
        c = c.join(stored.select("event_table", "pk", F.col("lsn").alias("_stored")), ["event_table", "pk"], "left")
        seen = F.greatest(seen, F.col("_stored"))
    c = c.withColumn("_seen", seen)
    return c.withColumn("applied", ~F.col("_bad") & (F.col("_seen").isNull() | (F.col("guard_lsn") > F.col("_seen")))).drop("_bad", "_seen", "_stored")


def reduce_state(changes: DataFrame) -> DataFrame:
    """C4: the row of the largest guard for each key, the earliest delivery on ties; a delete leaves a marker without content."""
    guard = F.when(F.col("op") == "r", F.lit(0).cast("long")).otherwise(F.col("lsn"))
    row = F.struct(guard.alias("lsn"), F.col("op") == "d", F.when(F.col("op") != "d", F.col("after")))
    best = changes.groupBy("event_table", "pk").agg(F.max_by(row, F.struct(guard, -F.col("seq"))).alias("s"))
    return best.select("event_table", "pk", F.col("s.lsn").alias("lsn"), F.col("s.col2").alias("deleted"), F.col("s.col3").alias("content"))


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored state and the state of a batch; the stored row wins on equal guards."""
    both = state.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    best = both.groupBy("event_table", "pk").agg(F.max_by(F.struct("lsn", "deleted", "content"), F.struct(F.col("lsn"), -F.col("_new"))).alias("s"))
    return best.select("event_table", "pk", "s.*")


def audit_rows(verdicts: DataFrame, batch_id: int) -> DataFrame:
    """A row for every delivery with its verdict and the images as delivered."""
    return verdicts.select(F.lit(batch_id).cast("long").alias("batch_id"), "seq", "event_table", "pk", "op", "lsn", "ts_ms", F.col("before").alias("before_json"), F.col("after").alias("after_json"), "applied")


def online_items(state: DataFrame) -> DataFrame:
    """Items keyed tenant:mmsi and feature name. state: event_table, pk (JSON with tenant_id, mmsi or id), lsn, deleted, content.

    A key without a vessel is a content error. Nulls in the content are left
    out, and content may not shadow the item's own fields.
    """
    k = lambda f: F.get_json_object("pk", f"$.{f}")
    mmsi = F.coalesce(k("mmsi"), F.substring_index(k("id"), ":", 1))
    name = F.when(F.col("event_table") == "vessels", "vessel_meta").when(F.col("event_table") == "watchlist", "watchlist").otherwise(F.concat(F.lit("sanctions:"), F.substring_index(k("id"), ":", -1)))
    content = F.map_filter(F.from_json(F.coalesce("content", F.lit("{}")), "map<string,string>"), lambda key, v: v.isNotNull() & ~key.isin(*_HIDDEN))
    ok = mmsi.rlike(r"^\d+$")
    return state.select(
        F.when(ok, F.concat_ws(":", F.coalesce(k("tenant_id"), F.lit(NO_TENANT)), mmsi)).alias("entity_id"), name.alias("feature_name"), "lsn", "deleted",
        content.alias("attributes"), (~F.coalesce(ok, F.lit(False))).alias("content_error"),
    )


def touched_keys(verdicts: DataFrame) -> DataFrame:
    """Keys that any delivery without a content error named, applied or not."""
    bad = F.coalesce(F.col("content_error"), F.lit(False)) if "content_error" in verdicts.columns else F.lit(False)
    return verdicts.where(~bad).select("event_table", "pk").distinct()


def batch_census(verdicts: DataFrame) -> DataFrame:
    """Counts of a parsed batch with verdicts (kind, op, applied)."""
    change = F.col("kind") == "change"
    return verdicts.agg(
        F.count_if(change).alias("events"), F.count_if(change & F.col("applied")).alias("applied"), F.count_if(change & ~F.col("applied")).alias("rejected"),
        F.count_if(change & (F.col("op") == "d")).alias("deletes"), F.count_if(F.col("kind") == "tombstone").alias("tombstones"),
        F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "skip").alias("skips"),
    )


def registry_rejects(changes: DataFrame) -> DataFrame:
    """The changes that may not be applied, with reject_reason: a row to be stored whose reason or regime is blank."""
    blank = [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", f"{c} is blank") for c in ("reason", "regime") if c in changes.columns]
    told = changes.withColumn("reject_reason", F.coalesce(*blank, F.lit(None).cast("string")))
    return told.where(~F.coalesce("deleted", F.lit(False)) & F.col("reject_reason").isNotNull())


def sanction_keys(df: DataFrame) -> DataFrame:
    """Regime stripped and lower-cased, and the flag's id mmsi:regime (null without a regime)."""
    out = df.withColumn("regime", F.lower(F.trim("regime")))
    return out.withColumn("id", F.concat(F.col("mmsi").cast("string"), F.lit(":"), F.col("regime")))


def _apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], deleted_by: list[str]) -> DataFrame:
    rest = [c for c in table.columns if c not in (*keys, "created_at", "updated_at")]
    gone = F.coalesce("deleted", F.lit(False))
    when = F.struct(*[F.col(c) for c in ("changed_at", "seq") if c in changes.columns])
    blank = [F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("reason", "regime") if c in table.columns]
    valid = changes.where(~gone)
    for b in blank:
        valid = valid.where(~b)
    # a delete reaches what was stored and all changes before it
    deletes = changes.where(gone).groupBy(*deleted_by).agg(F.max(when).alias("_d"))
    after = valid.join(deletes, deleted_by, "left").where(F.col("_d").isNull() | (when > F.col("_d")))
    new = after.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, F.xxhash64(*rest))).alias("n"), F.min("changed_at").alias("_first"), F.max("changed_at").alias("_last"))
    stored = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at", F.xxhash64(*rest))).alias("o"), F.min("created_at").alias("_made"), F.max("updated_at").alias("_moved"))
    both = stored.join(deletes, deleted_by, "left_anti").join(new, keys, "full_outer")
    fresh = F.col("n").isNotNull()
    return both.select(
        *keys, *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest],
        F.coalesce("_made", "_first").alias("created_at"), F.coalesce("_last", "_moved").alias("updated_at"),
    )


def upsert_registry(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key of the table after changes (its columns but created_at and updated_at, `deleted`, `changed_at`, optional `seq`).

    Changes count in the order of changed_at, then seq, then a hash of the row.
    Of repeated stored keys the row of the largest updated_at stays, with the
    earliest created_at. created_at stays unless the key was deleted before;
    updated_at moves; what registry_rejects tells is not applied.
    """
    return _apply_changes(table, changes, keys, keys)


def upsert_sanctions(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Sanction flags (mmsi, regime, id and more) after changes, as upsert_registry; a delete names a vessel and takes all its regimes."""
    return _apply_changes(sanction_keys(table), sanction_keys(changes), ["mmsi", "regime", "id"], ["mmsi"])


def list_registry(table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in the order of their keys."""
    return table.orderBy(*keys)
