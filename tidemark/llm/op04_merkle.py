"""Document fingerprints as Merkle trees over sections, paragraphs and sentences.

Leaves are sentences of at most ``LEAF`` characters and as many end marks and spaces, paragraphs are lines, and a section ends at a blank line or
at a paragraph whose digest ends in three zero bits, so an insertion moves no other boundary.  Every inner node
digests its children.  The fingerprint is the root (equality) followed by the tree with a short code and the
length of each leaf: two fingerprints are compared from above, equal branches are skipped, and the differing
ones locate the edits.  Likeness is the share of characters under equal branches.

The successor of a document in id order comes from blocks of the id range (bounds and block heads are a few
numbers per task): texts cross the network once, compressed, and the first document of a block is also sent to
the block before it.  Edge cases: null text counts as empty, whose fingerprint is that of the empty tree; a
null doc_id sorts first; rows of equal id are ordered by the hash of their text; a single row follows itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tasks, unpack

LEAF = 40
# every part is bounded, so a leaf of any text fits the two digits of its length
SENTENCE = re.compile(r"[^.!?\n]{1,%d}[.!?]{0,%d}[^\S\n]{0,%d}|[.!?]{1,%d}[^\S\n]{0,%d}" % ((LEAF,) * 5))
CODE = 8  # characters of a leaf: six of its digest, two of its length
LOWEST = -(1 << 63)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
LENGTHS = [a + b for a in ALPHABET for b in ALPHABET]
VALUE = {c: i for i, c in enumerate(LENGTHS)}


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: str | None) -> str:
    """root:tree, where the tree joins sections by "/", paragraphs by "." and leaves by nothing."""
    sections: list[list[str]] = [[]]
    digests: list[list[bytes]] = [[]]
    for line in _lines(text or ""):
        leaves = SENTENCE.findall(line)
        if line.endswith("\n"):
            leaves = [*leaves[:-1], leaves[-1] + "\n"] if leaves else ["\n"]
        hashes = [_digest(leaf.encode("utf-8", "surrogatepass")) for leaf in leaves]
        own = _digest(b"P" + b"".join(hashes))
        codes = base64.urlsafe_b64encode(b"".join(h[:6] for h in hashes)).decode()
        sections[-1].append("".join([codes[8 * i:8 * i + 6] + LENGTHS[len(leaf)] for i, leaf in enumerate(leaves)]))
        digests[-1].append(own)
        if not line.strip() or own[-1] & 7 == 0:
            sections.append([])
            digests.append([])
    root = _digest(b"R" + b"".join(_digest(b"S" + b"".join(d)) for d in digests if d))
    return root.hex() + ":" + "/".join(".".join(s) for s in sections if s)


def _lines(text: str) -> list[str]:
    """Lines with their ends; only a line feed ends a line."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _leaves(branch: str) -> list[str]:
    flat = branch.replace("/", "").replace(".", "")
    return [flat[i:i + CODE] for i in range(0, len(flat), CODE)]


def _size(branch: str) -> int:
    return sum(VALUE[leaf[6:]] for leaf in _leaves(branch))


def _differing(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """The branches of each side that have no equal partner on the other."""
    left, right = Counter(a), Counter(b)
    return list((left - right).elements()), list((right - left).elements())


def likeness(one: str, two: str) -> float:
    """Share of characters under equal branches, 1 exactly when the roots are equal or nothing differs."""
    root_a, _, a = one.partition(":")
    root_b, _, b = two.partition(":")
    if root_a == root_b:
        return 1.0
    most = max(_size(a), _size(b))
    if not most:
        return 1.0
    rest_a, rest_b = _differing(a.split("/"), b.split("/"))
    rest_a, rest_b = _differing([p for s in rest_a for p in s.split(".")], [p for s in rest_b for p in s.split(".")])
    rest_a, rest_b = _differing([x for p in rest_a for x in _leaves(p)], [x for p in rest_b for x in _leaves(p)])
    lost = max(sum(VALUE[x[6:]] for x in rest_a) + max(0, _size(b) - _size(a)),
               sum(VALUE[x[6:]] for x in rest_b) + max(0, _size(a) - _size(b)))
    return max(0.0, min(1.0, (most - lost) / most))


def edits(one: str, two: str) -> list[tuple[int, int]]:
    """Character ranges of the second text whose leaves the first text lacks."""
    have = Counter(_leaves(one.partition(":")[2]))
    out: list[tuple[int, int]] = []
    at = 0
    for leaf in _leaves(two.partition(":")[2]):
        end = at + VALUE[leaf[6:]]
        if have[leaf]:
            have[leaf] -= 1
        elif out and out[-1][1] == at:
            out[-1] = out[-1][0], end
        else:
            out.append((at, end))
        at = end
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _dealt(bounds, heads):
    """Rows with their block; the first row of a block goes to the block before it as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first = np.array(bounds, np.int64), heads
        order = sorted(first)
        before = {b: order[i - 1] for i, b in enumerate(order)}
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            key = batch.column("key").to_numpy()
            block = np.searchsorted(cuts, key, "right")
            rows = []
            for i, (b, k, h, text) in enumerate(zip(block.tolist(), key.tolist(), batch.column("hash").to_pylist(),
                                                    batch.column("text").to_pylist())):
                blob = codec.compress((text or "").encode("utf-8", "surrogatepass"))
                rows.append((b, 0, i, k, h, blob))
                if first[b] == (k, h):
                    rows.append((before[b], 1, i, k, h, blob))
            take = pa.array([r[2] for r in rows], pa.int32())
            columns = [pa.array([r[j] for r in rows], t) for j, t in ((0, pa.int32()), (1, pa.int32()), (3, pa.int64()), (4, pa.int64()), (5, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("doc_id").take(take)], ["block", "extra", "key", "hash", "blob", "doc_id"])
    return run


def _blocks(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds, np.int64)
        for batch in batches:
            block = np.searchsorted(cuts, batch.column("key").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("key"), batch.column("hash")], ["block", "key", "hash"])
    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None
    for batch in batches:
        out = []
        ids = batch.column("doc_id")
        for i, (block, extra, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "extra", "blob")))):
            text = unpack(blob).decode("utf-8", "surrogatepass")
            print_ = fingerprint(text)
            if last is not None and last[0] == block:
                _, doc_id, mine, own = last
                changed = edited(mine, text)
                other = fingerprint(changed)
                out.append((doc_id, len(mine), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other,
                            likeness(own, other), likeness(own, print_)))
            last = None if extra else (block, ids[i].as_py(), text, print_)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], ids.type),
                                          *(pa.array([r[j + 1] for r in out], t) for j, t in enumerate(types))], names)


def merkle(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (integer doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = tasks(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    cut = rows.agg(F.percentile_approx("key", F.lit([i / n for i in range(1, n)] or [0.5]), F.lit(10_000))).first()[0]
    bounds = sorted(set(cut or []))
    found = rows.select("key", "hash").mapInArrow(_blocks(bounds), "block int, key long, hash long").groupBy("block").agg(
        F.min(F.struct("key", "hash")).alias("head")).collect()  # one row per block
    heads = {r.block: (r["head"]["key"], r["head"]["hash"]) for r in found}
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(_dealt(bounds, heads), f"block int, extra int, key long, hash long, blob binary, doc_id {kind}")
    ordered = dealt.repartition(n, "block").sortWithinPartitions("block", "extra", "key", "hash")
    return ordered.mapInArrow(_compared, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")
