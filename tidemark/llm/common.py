"""Helpers of the corpus operators: shared scratch tables, salted lookups, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch

WS_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes ``df`` below the shared checkpoint folder and reads it back: the lineage ends there, so a
    lost executor never recomputes what came before, and values drawn once (row ids) stay fixed.  With ``tidy`` Spark
    deletes the shuffle files of this write as it ends: nothing reads them again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, str(tidy or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Caps the Arrow batches that Python tasks receive, so that long texts cannot fill a worker."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], salt_by: list[str], salts: int = 64) -> DataFrame:
    """Left join of ``rows`` (a saved table) to ``lookup`` (unique on non-null ``keys``) by salted keys.

    The lookup is repeated only for the salts that a key really has, at most ``salts`` rows, so a key with
    a third of all rows is spread over ``salts`` tasks and a rare key costs one row per salt present.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    present = salted.select(*keys, "_salt").distinct()
    spread = present.join(lookup, keys)
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Cuts batches into runs of rows of about ``most`` characters (one row at least)."""
    for batch in batches:
        lengths = [len(x) if x else 0 for x in batch.column("text").to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if total + n > most and i > start:
                yield batch, start, i
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch, start, len(lengths)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``text`` by its compressed bytes ``blob``, for shuffles of whole texts."""
    codec = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        blobs = [codec.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(blobs, pa.binary())], [*names, "blob"])


def packed(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` compressed into ``blob``."""
    rest = [c for c in df.columns if c != "text"]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, "text").mapInArrow(pack, f"{fields}, blob binary")


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)
