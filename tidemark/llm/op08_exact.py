"""Exact dedup over an extendible-hash index kept in shared files.  DataFrame functions only.

Texts are equal when identical after deleting ASCII white space.  A row's key is the 64-bit hash of that
normalised text; a bucket is a prefix of the key's bits.  The directory doubles where a bucket holds more
than ``capacity`` distinct keys: a prefix at depth d is a bucket when it fits and its parent did not.
Index entries lie in files ordered by directory slot, one key range per owner task.  Where one key has
several byte strings, they form a chain.  Bytes are compared by grouping on them.

Copies collapse inside each map task before the one shuffle of texts (grouping by key and bytes combines
on the map side), and rows look their entry up by salted key, so a text with a third of all rows is spread.

Edge cases: null text counts as empty and all empty texts are equal; of repeated identical rows exactly one
is kept; a null doc_id sorts last; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, attach, save, tasks

CAPACITY = 4096
SPARE_BITS = 6


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, "")


def _key(norm: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - bits)


def _slot(bits: int, depth: int) -> Column:
    return F.shiftrightunsigned("key", bits - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bits: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """((slot, bucket, local_depth), bits of a slot): the directory of a table with one row per distinct ``key``.

    The finest depth follows from the number of keys, so the directory has a bounded number of slots per
    bucket.  Counts of all prefixes come from one histogram over the finest slots.
    """
    n = keys.count()
    depth = min(bits, max(0, (n // capacity).bit_length() + SPARE_BITS))
    hist = keys.groupBy(_slot(bits, depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = hist.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    prefix = F.expr(f"shiftright(slot, {depth} - depth)")
    sums = save(levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("n")), "op08-prefixes")
    full = sums.filter(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fit = sums.filter((F.col("n") <= capacity) | (F.col("depth") == depth)).withColumn(
        "parent", F.shiftright("prefix", 1))
    split = fit.join(full, ["depth", "parent"], "left_semi").select("depth", "prefix")
    buckets = split.union(fit.filter("depth = 0").select("depth", "prefix"))
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    size = F.expr(f"shiftleft(1L, {depth} - depth)")
    name = F.concat_ws("/", F.col("depth").cast("string"), F.hex("prefix"))
    return buckets.select(F.explode(F.sequence(first, first + size - 1)).alias("slot"), name.alias("bucket"),
                          F.col("depth").alias("local_depth")), depth


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth.

    ``bits`` shortens the key; it changes the chains, never the result.
    """
    spark = docs.sparkSession
    norm = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.char_length("text").alias("chars"), normalised(F.col("text")).alias("norm"))
    rows = save(norm.select("doc_id", "chars", _key(F.col("norm"), bits).alias("key"),
                            F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
                "op08-rows")

    # Bytes are compared here: one row per (key, byte string), combined in the map tasks.  A link of a chain is
    # named by its SHA-256; two byte strings under one name would fail the job instead of being merged.
    strings = norm.select(_key(F.col("norm"), bits).alias("key"), "norm").groupBy("key", "norm").agg(
        F.count(F.lit(1)).alias("n"))
    links = strings.groupBy("key", F.sha2("norm", 256).alias("name")).agg(F.count(F.lit(1)).alias("same"), F.sum("n").alias("n"))
    one = F.when(F.max("same") > 1, F.raise_error(F.lit("two byte strings share key and digest"))).otherwise(F.count(F.lit(1)))
    keys = save(links.groupBy("key").agg(one.alias("chain"), F.sum("n").alias("n")), "op08-keys")
    slots, depth = directory(keys, bits, capacity)
    index = keys.withColumn("slot", _slot(bits, depth)).join(slots, "slot").drop("slot")
    index = save(index.repartitionByRange(tasks(spark), "key").sortWithinPartitions("key"), "op08-index")
    found = attach(rows, index.select("key", "chain", "bucket", "local_depth"), ["key"], ["row"])
    found = save(found.withColumn("link", F.when(F.col("chain") > 1, F.col("text_sha256")).otherwise("")), "op08-found")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = found.groupBy("key", "link").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = attach(found, best, ["key", "link"], ["row"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                      (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "bucket", "local_depth")
