"""Lake tables on Parquet: layout, upsert, compaction, drift windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 16
LAYOUT = {"positions": ["t_day", "mmsi_bucket"], "graph_nodes": [], "graph_edges": []}


def with_layout(df: DataFrame, table: str) -> DataFrame:
    """Adds the partition columns of a table: day of t and a hash bucket of the vessel for positions."""
    if table != "positions":
        return df
    return df.withColumn("t_day", F.to_date("t")).withColumn("mmsi_bucket", F.pmod(F.hash("mmsi"), F.lit(BUCKETS)))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def upsert_table(df: DataFrame, path: str, keys: list[str], partitions: list[str] | None = None) -> None:
    """Rows of df replace the stored rows of equal keys. A rerun changes nothing, and no rows write nothing. Of rows of df with equal keys the
    largest by its other columns is taken, so that reruns agree.

    Only partitions that df touches are rewritten, by dynamic overwrite; they
    are staged beside the table first, as a table can't be read while it is
    overwritten. Keys must lie in one partition each.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*df.columns) if rest else df.distinct()
    if not _exists(spark, path):
        (one.write.partitionBy(*partitions) if partitions else one.write).mode("overwrite").parquet(path)
        return
    stored = spark.read.parquet(path)
    if partitions:
        touched = one.select(*partitions).distinct()
        stored = stored.join(touched, partitions, "left_semi")
    merged = stored.join(one.select(*keys), keys, "left_anti").unionByName(one)
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    merged.write.parquet(staging)
    ready = spark.read.schema(merged.schema).parquet(staging)
    writer = ready.repartition(*partitions).write.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic") if partitions else ready.write
    writer.mode("overwrite").parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(staging)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


#: Types of numeric columns, decimals besides.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each data file."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def compact(spark: SparkSession, path: str, target: str, partitions: list[str] | None = None, files: int = 1) -> DataFrame:
    """Rewrites a table to `target` with few files for each partition; returns files and rows before and after."""
    df = spark.read.parquet(path)
    if partitions:
        df.repartition(*partitions).write.partitionBy(*partitions).mode("overwrite").parquet(target)
    else:
        df.coalesce(files).write.mode("overwrite").parquet(target)
    side = lambda p, name: file_counts(spark, p).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows")).withColumn("state", F.lit(name))
    return side(path, "before").unionByName(side(target, "after"))


def select_window(spark: SparkSession, path: str, reference: DataFrame, numeric: list[str], min_rows: int = 100, max_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(window, verdicts) of the newest acceptable parquet file below path: the reference's columns, enough rows, finite numbers, usable times.

    Files are read one after the other, the newest first, each with its own
    schema, and none after the first accepted one. verdicts (file, at, n,
    reject_reason, content_hash) has a row for each file read; the window is
    the accepted file's last max_rows rows by (t, mmsi). The hash tells whether
    a window's rows are those of another.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    told, window = [], None
    for f in listed.orderBy(F.desc("modificationTime"), F.desc("path")).toLocalIterator():  # names of files, as far as they are needed
        reason, n, digest = "schema", None, None
        try:
            df = spark.read.parquet(f.path)
        except Exception as e:  # noqa: BLE001  a file that is no table is a verdict, whatever it holds
            told.append((f.path, f.modificationTime, None, f"unreadable: {type(e).__name__}", None))
            continue
        kinds = dict(df.dtypes)
        if df.columns == reference.columns and all(kinds[c] in NUMBERS or kinds[c].startswith("decimal") for c in numeric):
            odd = F.lit(False)
            for c in numeric:
                odd |= F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
            no_time = F.try_to_timestamp(F.col("t").cast("string")).isNull()
            n, n_odd, n_no_time = df.agg(F.count(F.lit(1)), F.count_if(odd), F.count_if(no_time)).first()
            reason = "rows" if n < min_rows else "numbers" if n_odd else "times" if n_no_time else None
        if reason is None:
            order = [F.desc(F.try_to_timestamp(F.col("t").cast("string"))), *[F.desc(c) for c in ("mmsi",) if c in df.columns]]
            window = df.orderBy(*order, F.xxhash64(*df.columns)).limit(max_rows)
            digest = window.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))), 256)).first()[0]
        told.append((f.path, f.modificationTime, n, reason, digest))
        if window is not None:
            break
    verdicts = spark.createDataFrame(told, "file string, at timestamp, n long, reject_reason string, content_hash string")
    return (reference.limit(0) if window is None else window), verdicts
