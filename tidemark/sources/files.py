"""File sources, sinks and manifests (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def below(spark: SparkSession, root: str, path) -> Column:
    """The part of a file's path below the folder ``root``, so that files of one name in two folders stay apart;
    the name alone where the file is not below it (a pattern as root)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    # schemes are written file:/x or file:///x; readers give the path plain or with percent signs
    plain = F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    out = F.element_at(F.split(plain, "/"), -1)
    for start in {uri.getPath().rstrip("/") + "/", uri.getRawPath().rstrip("/") + "/"}:
        out = F.when(F.startswith(plain, F.lit(start)), F.substr(plain, F.lit(len(start) + 1))).otherwise(out)
    return out


def physical_rows(df: DataFrame, first: int = 1, columns: list[str] | None = None) -> DataFrame:
    """Adds ``file_path`` and ``row_number``: the row's position in its file, over split files as well.

    A row's place inside its split is its monotonically increasing id less the split's smallest; a
    split's offset is the running row count of the file's earlier splits.  Only split counts shuffle.
    """
    cols = columns or df.columns
    tagged = df.select(*cols, F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_start")).withColumn("_id", F.monotonically_increasing_id())
    splits = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = tagged.join(splits, ["_file", "_start"])
    return out.select(*cols, F.col("_file").alias("file_path"),
                      (F.col("_off") + F.col("_id") - F.col("_first") + first).alias("row_number"))


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """URL,label CSV.  Labels outside {0, 1} fail the job; rows count from 2 (line 1 is the header)."""
    raw = spark.read.schema("URL string, label int").csv(path, header=True, escape='"')
    out = physical_rows(raw, first=2)
    label = F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(F.raise_error(F.lit("label outside {0, 1}")))
    return out.select(F.col("URL").alias("raw_url"), label.cast("int").alias("label"), "file_path",
                      F.col("row_number").alias("source_row"))


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; CR, LF and CRLF end a line, undecodable bytes are replaced, blank lines dropped.
    ``row_number`` is the physical line, ``i`` the part of a line that CR splits."""
    text = spark.read.option("encoding", "UTF-8").text(path)
    lines = physical_rows(text).select("file_path", "row_number", F.posexplode(F.split("value", "\r")).alias("i", "line"))
    kept = lines.select("file_path", "row_number", "i", F.trim("line").alias("raw_url")).filter(F.length("raw_url") > 0)
    return kept


def read_labelled_lists(spark: SparkSession, files: dict[str, int]) -> DataFrame:
    """Union of URL lists (files or folders), each with a constant label; lines number from 1 per file."""
    out = None
    for path, label in files.items():
        part = read_url_lines(spark, path).withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def read_parquet(spark: SparkSession, path: str, columns: list[str], forbidden: tuple = (), predicate: Column | None = None) -> DataFrame:
    """Column allow-list scan; asking for a forbidden column is an error; the predicate reaches the reader."""
    bad = sorted(set(columns) & set(forbidden))
    if bad:
        raise ValueError(f"forbidden columns requested: {bad}")
    df = spark.read.parquet(path)
    return (df.filter(predicate) if predicate is not None else df).select(*columns)


def shard_offsets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a sharded Parquet folder with a running row number over the shards in name order."""
    rows = df.select(*columns, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("shard"),
                     F.col("_metadata.row_index").alias("shard_row"))
    per = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    # one row per file: metadata, not data
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("shard", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return rows.join(offsets, "shard").withColumn("global_row", F.col("_off") + F.col("shard_row")).drop("_off")


def ensure_column(df: DataFrame, name: str, default: str = "") -> DataFrame:
    """Optional column: blank where the schema lacks it or the value is null."""
    if name not in df.columns:
        return df.withColumn(name, F.lit(default))
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def path_keys(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Key columns from the parts of the file path (one regex group per name)."""
    p = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(p, pattern, i).alias(n) for i, n in enumerate(names, 1)])


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Idempotent re-run: only the partitions present in ``df`` are replaced, committed by the job."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(
        *partition).parquet(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> str:
    """Skip when complete, fail when a partial folder exists and ``force`` is off, else write."""
    spark = df.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")) and not force:
        return "skipped"
    if fs.exists(hpath) and not force:
        raise FileExistsError(f"partial output at {path}")
    write_parquet(df, path, mode="overwrite")
    return "written"


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path below the folder, bytes, sha256) per file.  Spark reads a file as one value, so files must be below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(below(spark, path, "path").alias("path"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def manifest_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that differ, with the reason: missing, unexpected, bytes or sha256."""
    a = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"))
    j = expected.join(a, "path", "full_outer")
    reason = (F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected")
              .when(F.col("bytes") != F.col("actual_bytes"), "bytes").when(F.col("sha256") != F.col("actual_sha256"), "sha256"))
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("path", "reason")


def canonical_text_hash(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each text file with CR and CRLF turned into LF."""
    t = spark.read.text(path, wholetext=True)
    return t.select(below(spark, path, F.col("_metadata.file_path")).alias("path"),
                    F.sha2(F.regexp_replace("value", "\r\n?", "\n").cast("binary"), 256).alias("sha256"))


def artifact_inventory(spark: SparkSession, path: str, include: str, roles: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """Files whose path matches ``include`` with a role by the first matching path pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    role = F.lit(other)
    for pattern, name in reversed(roles):
        role = F.when(F.col("path").rlike(pattern), name).otherwise(role)
    return files.filter(F.col("path").rlike(include)).select("path", F.col("length").alias("bytes"), role.alias("role"))


def schema_privacy(tables: dict[str, DataFrame], banned: list[str]) -> DataFrame:
    """One row per table: the banned columns it carries and whether it passes."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, ",".join(sorted(set(df.columns) & set(banned)))) for n, df in tables.items()]
    return spark.createDataFrame(rows, "table_name string, banned_columns string").withColumn(
        "passed", F.col("banned_columns") == "")
