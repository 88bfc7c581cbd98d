"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  At most ``distance`` differing bits leave at least 8 - distance
bytes equal in place.  Postings are keyed by groups of positional bytes: the eight bytes make four blocks of
two, and two of the four blocks must be equal when two bits differ, so every pair of linked fingerprints
meets under at least one of six keys of four bytes.  For each pair that meets, the equal positional bytes are
tallied, pairs below the guaranteed minimum go, and the rest are verified by the count of differing bits.

A posting list of more than ``most`` distinct fingerprints is never paired.  Its members are linked exactly
through hubs: two values differ in at most two bits exactly when some value lies within one bit of both, so a
member is listed under itself and its 64 one-bit flips, and all members of a hub are linked to its smallest.
A hub holds at most 65 members, and rows grow in proportion to the members of crowded lists.

Only distinct fingerprints enter the search.  Components come from alternating star contractions on saved
tables.  Edge cases: null or blank texts have fingerprint zero and link like any other; texts of fewer words
than a shingle hash as a whole; repeated rows fall into one component; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, save

SEED = 42
SHINGLE = 3
DISTANCE = 2
MOST = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of every shingle of lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops[k - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(shingle), f"doc_id {kind}, fp long")


def _masks() -> list[int]:
    """Masks of the byte groups that serve as keys: all but ``DISTANCE`` of four blocks of two bytes."""
    return [sum(0xFFFF << 16 * i for i in kept) for kept in combinations(range(4), 4 - DISTANCE)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def shared_bytes(a: str, b: str):
    """Number of positional bytes that two fingerprints share."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return sum(F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8))


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of fingerprints (``fp``, distinct) within two bits."""
    masks = _masks()
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("group"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                                for i, m in enumerate(masks)])).alias("p")
    postings = distinct.select("fp", keyed).select("fp", "p.group", "p.key")
    counts = postings.groupBy("group", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least"))
    postings = save(postings, "op10-postings")
    counts = save(counts.filter("n > 1"), "op10-counts")

    short = postings.join(counts.filter(F.col("n") <= most).select("group", "key"), ["group", "key"])
    lists = short.groupBy("group", "key").agg(F.collect_list("fp").alias("fps"))
    left = lists.select("fps", F.explode("fps").alias("a"))
    pairs = left.select("a", F.explode(F.filter("fps", lambda x: x > F.col("a"))).alias("b"))
    tallied = pairs.filter(shared_bytes("a", "b") >= 8 - DISTANCE)
    paired = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)

    crowded = attach(postings, counts.filter(F.col("n") > most).select("group", "key", F.lit(True).alias("crowded")),
                     ["group", "key"], ["fp"]).filter("crowded").select("fp").distinct()
    flips = [0, *(1 << i for i in range(64))]
    hubs = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(f))) for f in flips])).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("fps"))
    linked = least.filter("n > 1").select(F.explode("fps").alias("a"), "b").filter("a <> b")
    return paired.select("a", "b").union(linked.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge.

    Alternating large-star and small-star steps (each node links its neighbours to its smallest one) until
    nothing changes; every round is written, and the lookups of star centres are salted.
    """
    def check(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()

    def star(edges, large):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        both = save(both, "op10-star")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = attach(both, least, ["a"], ["b"])
        out = out.filter("b > a") if large else out.filter("b <> m")
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    edges = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "op10-edges")
    state = check(edges)
    while True:
        edges = save(star(star(edges, True), False), "op10-edges")
        now = check(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_groups(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    rows = save(fingerprints(docs, shingle), "op10-rows")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = save(nodes, "op10-nodes")
    roots = save(components(links(nodes.select("fp"), most)), "op10-roots")
    members = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = members.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = members.select("fp", "root").join(heads, "root").select("fp", "component_id")
    out = attach(rows, ids, ["fp"], ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
