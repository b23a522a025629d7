"""Position reports in: files, raw messages, provider envelopes, quarantine, landing, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTRACT = T.StructType([T.StructField(n, t) for n, t in (("mmsi", T.LongType()), ("t", T.StringType()), ("lat", T.DoubleType()), ("lon", T.DoubleType()), ("sog", T.DoubleType()), ("cog", T.DoubleType()))])
PROVIDER = "MessageType string, MetaData struct<MMSI:long,time_utc:string>, Message struct<PositionReport:struct<Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:double>>"
_FIELDS = ("lat", "lon", "sog", "cog", "heading")


def _number(v: Column, name: str) -> Column:
    """A JSON number as a double; null where the field is null, absent or of another kind."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{name}", "double"))


def _absent(v: Column, name: str) -> Column:
    got = F.try_variant_get(v, f"$.{name}", "variant")
    return got.isNull() | (F.schema_of_variant(got) == "VOID")


def parse_reports(df: DataFrame, col: str = "value") -> DataFrame:
    """Adds mmsi, t, lat, lon, sog, cog, heading and reject_reason, the first of what is wrong.

    An MMSI is a JSON integer or a string of ASCII digits, 0 to 999,999,999;
    booleans and decimals are none. Times need a zone. Positions are not held
    to ranges here, and further fields are ignored.
    """
    v = F.try_parse_json(F.col(col))
    out = df.withColumn("_v", v)
    v = F.col("_v")
    got = F.try_variant_get(v, "$.mmsi", "variant")
    kind = F.schema_of_variant(got)
    text = F.try_variant_get(v, "$.mmsi", "string")
    mmsi = F.when((kind == "BIGINT") | ((kind == "STRING") & text.rlike("^[0-9]{1,18}$")), text.try_cast("long"))
    mmsi = F.when(mmsi.between(0, 999_999_999), mmsi)
    stamp = F.try_variant_get(v, "$.t", "string")
    t = F.when(stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(stamp))
    out = out.select("*", mmsi.alias("mmsi"), t.alias("t"), *[_number(v, f).alias(f) for f in _FIELDS])
    optional = [F.when(F.col(f).isNull() & ~_absent(v, f), f) for f in ("sog", "cog", "heading")]
    reason = F.coalesce(F.when(v.isNull(), "json"), F.when(F.col("mmsi").isNull(), "mmsi"), F.when(F.col("t").isNull(), "t"), F.when(F.col("lat").isNull(), "lat"), F.when(F.col("lon").isNull(), "lon"), *optional)
    return out.withColumn("reject_reason", reason).drop("_v")


def _range_reason() -> Column:
    bad = lambda c, a, b: F.coalesce(~F.col(c).between(a, b), F.lit(False))
    return F.coalesce(F.col("reject_reason"), F.when(bad("lat", -90, 90), "lat"), F.when(bad("lon", -180, 180), "lon"), F.when(F.col("sog") < 0, "sog"), F.when(bad("cog", 0, 360), "cog"), F.when(bad("heading", 0, 360), "heading"))


def read_positions(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """JSON lines with strict ranges; blank lines are skipped.

    mode="fail" raises at the first bad row and names file, reason and text;
    mode="quarantine" keeps bad rows with their reject_reason.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where("trim(value) <> ''")
    out = parse_reports(lines).withColumn("reject_reason", _range_reason())
    if mode == "quarantine":
        return out
    fail = F.raise_error(F.concat_ws(" ", F.lit("bad report:"), "reject_reason", F.lit("in"), "file", F.substring("value", 1, 200)))
    return out.withColumn("mmsi", F.when(F.col("reject_reason").isNotNull(), fail.cast("long")).otherwise(F.col("mmsi"))).drop("reject_reason", "value", "file")


def parse_provider_envelope(df: DataFrame, col: str = "value") -> DataFrame:
    """S3: flat reports from the provider's PositionReport messages; heading 511 is unknown, other messages and broken ones go."""
    m = df.withColumn("_m", F.from_json(F.col(col), PROVIDER)).where("_m.MessageType = 'PositionReport'")
    p = "_m.Message.PositionReport"
    when = F.try_to_timestamp(F.regexp_replace("_m.MetaData.time_utc", r"^(\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d(?:\.\d{1,6})?)\d* \+0000 UTC$", "$1T$2Z"))
    out = m.select(F.col("_m.MetaData.MMSI").alias("mmsi"), when.alias("t"), F.col(f"{p}.Latitude").alias("lat"), F.col(f"{p}.Longitude").alias("lon"), F.col(f"{p}.Sog").alias("sog"), F.col(f"{p}.Cog").alias("cog"),
                   F.when(F.col(f"{p}.TrueHeading") != 511, F.col(f"{p}.TrueHeading")).alias("heading"))
    return out.where("mmsi is not null and t is not null and lat is not null and lon is not null")


def split_quarantine(parsed: DataFrame, raw: str = "value", at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad rows are reason, raw, quarantined_at and their dt partition. Bytes are decoded with replacement."""
    at = F.current_timestamp() if at is None else at
    text = F.col(raw).cast("string") if dict(parsed.dtypes)[raw] != "binary" else F.decode(raw, "UTF-8")
    bad = parsed.where("reject_reason is not null").select(F.col("reject_reason").alias("reason"), text.alias("raw"), at.alias("quarantined_at")).withColumn("dt", F.to_date("quarantined_at"))
    return parsed.where("reject_reason is null").drop("reject_reason"), bad


def land_raw(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends raw reports as gzip text files under ingest_date partitions."""
    dated = stream.select(F.col("value").cast("string").alias("value"), F.to_date(F.current_timestamp()).alias("ingest_date"))
    return dated.writeStream.format("text").partitionBy("ingest_date").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay_as_stream(spark: SparkSession, df: DataFrame, path: str, slice_seconds: int = 3600) -> DataFrame:
    """Writes df in slices of time, ordered by (t, mmsi), and streams them one file a trigger; the trigger sets the pace."""
    sliced = df.withColumn("slice", F.floor(F.unix_seconds("t") / slice_seconds))
    sliced.repartitionByRange("slice").sortWithinPartitions("slice", "t", "mmsi").write.partitionBy("slice").mode("overwrite").parquet(path)
    return spark.readStream.schema(sliced.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "false").parquet(path)


def read_extract(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """The raw extract by its pinned schema; days, where given, prune partitions of a t_day layout as well as rows."""
    df = spark.read.schema(EXTRACT).parquet(path)
    day = F.substring("t", 1, 10)
    if first_day:
        df = df.where(day >= first_day)
    return df.where(day <= last_day) if last_day else df


def read_lanes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, waypoints) of a lane file, each with the origin lat0, lon0: the mean of all lane points."""
    doc = spark.read.schema("lanes array<struct<id:string,name:string,nodes:array<array<double>>>>, waypoints array<struct<id:string,lonlat:array<double>>>").json(path, multiLine=True)
    lanes = doc.select(F.posexplode("lanes").alias("lane", "l")).select("lane", "l.id", F.posexplode("l.nodes").alias("i", "n")).select("lane", F.col("id").alias("lane_id"), "i", F.col("n")[0].alias("lon"), F.col("n")[1].alias("lat"))
    origin = lanes.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    w = Window.partitionBy("lane").orderBy("i")
    ends = lanes.select("lane", "lane_id", "i", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon")).where("b_lat is not null")
    segments = ends.select("lane_id", (F.col("lane") * 1_000_000 + F.col("i")).alias("ord"), "a_lat", "a_lon", "b_lat", "b_lon").crossJoin(F.broadcast(origin))
    marks = doc.select(F.explode("waypoints").alias("w")).select(F.col("w.id").alias("waypoint_id"), F.col("w.lonlat")[1].alias("lat"), F.col("w.lonlat")[0].alias("lon")).crossJoin(F.broadcast(origin))
    return segments, marks


def latest_manifest(df: DataFrame, order: str = "seq") -> DataFrame:
    """The manifest appended last, one row."""
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("m")).where("m is not null").select("m.*")


def incomplete_manifest(df: DataFrame, required: list[str]) -> DataFrame:
    """Manifests that lack a lineage field, with the missing names."""
    lack = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]))
    return df.withColumn("missing", lack).where(F.size("missing") > 0)
