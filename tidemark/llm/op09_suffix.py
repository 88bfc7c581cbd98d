"""Removal of long repeated byte strings by a logarithmic family of sampled suffix arrays.

Sampling.  Every ``length``-byte window picks one of its ``seed``-byte substrings, the one of least hash (the
last of equal ones).  The pick depends on the window's content alone, so equal windows, wherever they stand,
pick at the same offset.  The picked positions are the sampled suffixes: one per hundred bytes or so, yet every
long match between two texts passes through a pair of them.  A sampled suffix covers a run of windows; its
context is the hash of all bytes of the run.

Index.  Documents come in batches.  A batch's sampled suffixes are sorted by their key (two leading bytes, then
the hash of the seed) into an array of distinct keys; it is merge-scanned against every level of the index for
keys in common, and then becomes a level itself.  Levels of equal size are merged before the next batch enters,
so there are about log2 of the batches.  Hits tell whether all suffixes of a key share one context.

Matches.  A key repeated in one context repeats all its windows.  Where contexts differ, each distinct context
is taken once, with its bytes.  The contexts of a key are a small suffix array: sorted by the bytes from the seed
on and, reversed, by the bytes before it.  Common prefixes of neighbours in both orders tell for every offset of
a window before the seed which contexts share that window, so ranges of repeated windows come out, byte for byte;
no window is written and no two contexts are paired.

Hot keys.  A key with more than ``GROUP`` contexts is cut: the windows that start early and those that start late
each contain a longer string around the seed, and contexts are grouped anew by that string and by half the
offsets.  Contexts alike in all windows of their half become one.  Halves shrink to single windows, so this ends
within ten rounds and no task meets more contexts than ``GROUP``.

Windows of ``length`` bytes are judged on the input, removed bytes are the union of repeated windows.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing; rows equal in doc_id and text are
occurrences of their own and give equal results; very long texts are cut into overlapping segments; no rows
give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, packed, save, unpack

LENGTH = 400
SEED = 100
BATCHES = 4
SEGMENT = 1 << 18
GROUP = 30000  # of at most 2 * length - seed bytes each: some 20 MB
LOW = (1 << 24) - 1


def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hasher:
    """Polynomial hashes modulo 2**64 of all substrings of a length, over random values of the bytes."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 1
        inverse = pow(base, -1, 1 << 64)
        self.up, self.down = _powers(base, size), _powers(inverse, size)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((sums[hi] - sums[lo]) * self.down[lo])


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash, whose low bits mix poorly."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


_HASHERS: dict[int, Hasher] = {}


def hasher(which: int) -> Hasher:
    if which not in _HASHERS:
        _HASHERS[which] = Hasher(which, 4 * SEGMENT)
    return _HASHERS[which]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def sampled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int):
    """Sampled suffixes of the texts data[starts[i]:ends[i]]: (text number, key, context, first and last window, place
    of the seed behind the first window)."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none, none
    h = hasher(1)
    sums = h.sums(data)
    at = np.arange(n - seed + 1)
    seeds = h.between(sums, at, at + seed)
    low = np.uint64(LOW)
    picked = sliding_least((seeds & ~low) | (low - at.astype(np.uint64)), length - seed + 1)
    picked = (low - (picked & low)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(len(picked)), "right")  # the text that holds a window's first byte
    inside = np.arange(len(picked)) + length <= ends[np.minimum(owner, len(ends) - 1)]
    window = np.flatnonzero(inside)
    if not len(window):
        return none, none, none, none, none, none
    pick, text = picked[window], owner[window]
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1]) | (np.diff(window) != 1)]))
    first = window[new]
    last = window[np.append(new[1:], len(window)) - 1]
    pick, text = pick[new], text[new]
    lead = data[pick].astype(np.uint64) << np.uint64(56) | data[pick + 1].astype(np.uint64) << np.uint64(48)
    key = (lead | seeds[pick] >> np.uint64(16)) ^ np.uint64(1 << 63)  # signed order is byte order
    place = (pick - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    context = _mix(hasher(2).between(hasher(2).sums(data), first, last + length) ^ place)
    return text, key.view(np.int64), context.view(np.int64), first - starts[text], last - starts[text], pick - first


def _suffix_batches(length: int, seed: int):
    def rows(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rid, base = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
        ends = np.cumsum([len(p[2]) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        text, key, context, first, last, ahead = sampled(data, starts, ends, length, seed)
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[text]), pa.array(key), pa.array(context), pa.array((first + base[text]).astype(np.int32)),
             pa.array((last - first).astype(np.int16)), pa.array(ahead.astype(np.int16))],
            ["rid", "key", "context", "first", "more", "ahead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, int, bytes]] = []  # that fit the tables of powers
        size = 0
        for batch in batches:
            for rid, blob in zip(batch.column("rid").to_pylist(), batch.column("blob").to_pylist()):
                data = unpack(blob)
                for at in range(0, len(data) - length + 1, SEGMENT):
                    piece = data[at:at + SEGMENT + length - 1]
                    if pieces and size + len(piece) > 3 * SEGMENT:
                        yield rows(pieces)
                        pieces, size = [], 0
                    pieces.append((rid, at, piece))
                    size += len(piece)
        if pieces:
            yield rows(pieces)
    return run


def _array(entries: DataFrame) -> DataFrame:
    """Entries (key, context, repeated, several) reduced to one per key."""
    return entries.groupBy("key").agg(
        F.min("context").alias("context"), ((F.count(F.lit(1)) > 1) | F.bool_or("repeated")).alias("repeated"),
        (F.bool_or("several") | (F.min("context") != F.max("context"))).alias("several"))


class SuffixIndex:
    """Levels of sorted arrays in shared files: (size in batches, table)."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Scans a batch of sampled suffixes (key, context) against the levels, then adds it.

        Returns the hits (key, context, several): keys that repeat within the batch or meet a level."""
        self._merge()
        none = F.lit(False)
        batch = save(_array(suffixes.select("key", "context", none.alias("repeated"), none.alias("several"))).sortWithinPartitions("key"),
                     "op09-level")
        hits = batch.filter("repeated").select("key", "context", "several")
        for _, level in self.levels:
            other = level.select("key", F.col("context").alias("c"), F.col("several").alias("s"))
            met = batch.select("key", "context", "several").join(other, "key")
            hits = hits.union(met.select("key", F.least("context", "c").alias("context"),
                                         (F.col("several") | F.col("s") | (F.col("context") != F.col("c"))).alias("several")))
        self.levels.append((1, batch))
        return save(hits, "op09-hits")

    def _merge(self) -> None:
        """Levels of equal size become one of twice the size, until all sizes differ."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels[-2:]
            self.levels[-2:] = [(2 * n, save(_array(a.union(b)).sortWithinPartitions("key"), "op09-level"))]


def _context_batches(length: int):
    """Bytes of the contexts, with the offsets (seed less window) of their last and first windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, blob, runs in zip(*(batch.column(c).to_pylist() for c in ("rid", "blob", "runs"))):
                data = unpack(blob)
                for at in range(0, len(runs), 10000):
                    some = runs[at:at + 10000]
                    ahead = np.array([r["ahead"] for r in some], np.int32)
                    first = np.array([r["first"] for r in some], np.int32)
                    more = np.array([r["more"] for r in some], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["key"] for r in some], pa.int64()), pa.array(ahead - more), pa.array(ahead),
                         pa.array([data[f:f + m + length] for f, m in zip(first, more)], pa.binary()),
                         pa.array(np.full(len(some), rid, np.int64)), pa.array(first + ahead), pa.array([r["alone"] for r in some])],
                        ["node", "low", "high", "bytes", "rid", "pick", "alone"])
    return run


def common_prefix(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    least = 0  # a and b agree up to here and not up to most
    while most - least > 1:
        mid = (least + most) // 2
        if a[least:mid] == b[least:mid]:
            least = mid
        else:
            most = mid
    return least


def shared_offsets(contexts: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each context (bytes, place of the seed in them) the ranges of offsets d whose window, the ``length`` bytes
    from d before the seed on, stands in another context too."""
    n = len(contexts)
    ahead, behind = [c[at:] for c, at in contexts], [c[:at][::-1] for c, at in contexts]
    orders = [sorted(range(n), key=side.__getitem__) for side in (ahead, behind)]
    right, left = ([common_prefix(side[i], side[j]) for i, j in zip(order, order[1:])] for side, order in zip((ahead, behind), orders))
    if n == 2:
        found = [(length - right[0], left[0])] if right[0] + left[0] >= length else []
        return [found, found]
    # contexts are grouped alike between two places where a neighbour is gained on the right or lost on the left
    cuts = sorted({length - r for r in right} | {d + 1 for d in left})
    right_at, left_at = np.array(right), np.array(left)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    group = np.zeros((2, n), np.int64)
    for d, after in zip(cuts, cuts[1:]):
        for side, breaks in enumerate((right_at < length - d, left_at < d)):
            group[side, orders[side]] = np.concatenate([[0], np.cumsum(breaks)])
        _, which, count = np.unique(group[0] * n + group[1], return_inverse=True, return_counts=True)
        for i in np.flatnonzero(count[which] > 1):
            if found[i] and found[i][-1][1] == d - 1:
                found[i][-1] = (found[i][-1][0], after - 1)
            else:
                found[i].append((d, after - 1))
    return found


def _settle_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, first, last = [], [], []
            for group in batch.column("group").to_pylist():
                for c, ranges in zip(group, shared_offsets([(c["bytes"], c["high"]) for c in group], length)):
                    if c["alone"]:
                        rid.extend([c["rid"]] * len(ranges))
                        first.extend(c["pick"] - high for _, high in ranges)
                        last.extend(c["pick"] - low for low, _ in ranges)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                                             ["rid", "first", "last"])
    return run


def _halves(hot: DataFrame, length: int) -> DataFrame:
    """Contexts of crowded groups, once for each half of the group's offsets in which they have windows."""
    mid = F.expr("CAST(floor((a + b) / 2) AS INT)")
    half = F.explode(F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b"))))
    rows = hot.select("node", "low", "high", "bytes", "rid", "pick", "alone", half.alias("half")).select("*", "half.*")
    rows = rows.filter("low <= b AND high >= a").withColumns({"to": F.greatest("low", "a"), "from": F.least("high", "b")})
    own = F.expr(f"substring(bytes, high - `from` + 1, `from` - `to` + {length})")  # all windows of the half
    held = F.expr(f"substring(bytes, high - a + 1, a - b + {length})")  # in each window of the half
    return rows.select(F.xxhash64("node", "a", held).alias("node"), "a", "b", F.col("to").alias("low"), F.col("from").alias("high"),
                       own.alias("bytes"), "rid", "pick", "alone")


def settle(contexts: DataFrame, length: int, seed: int, most: int | None = None) -> DataFrame:
    """Repeated windows (rid, first, last) of the distinct ``contexts`` (node, low, high, bytes, rid, pick, alone), those of
    ``alone`` contexts only.  A group of more than ``most`` contexts is cut until none is left."""
    most = most or GROUP
    out = contexts.select("rid", F.col("pick").alias("first"), F.col("pick").alias("last")).limit(0)
    rows, node = contexts.withColumns({"a": F.lit(0), "b": F.lit(length - seed)}), ["node", "a", "b"]
    while True:
        crowded = save(rows.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) & (F.col("a") < F.col("b"))),
                       "op09-crowded")
        any_crowded = not crowded.isEmpty()
        if any_crowded:
            marked = save(attach(rows, crowded, node, ["rid", "pick"]), "op09-marked")
            rows = marked.filter("n IS NULL").drop("n")
        groups = rows.groupBy(*node).agg(F.collect_list(F.struct("bytes", "high", "rid", "pick", "alone")).alias("group"))  # at most ``most``
        out = out.union(groups.filter("size(group) > 1 AND exists(group, c -> c.alone)").select("group").mapInArrow(_settle_batches(length), "rid long, first int, last int"))
        if not any_crowded:
            return out
        halves = save(_halves(marked.filter("n IS NOT NULL"), length), "op09-halves")
        alike = [*node, "low", "high", "bytes"]
        merged = save(halves.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "pick")).alias("one"),
                                                 F.bool_and("alone").alias("alone")), "op09-merged")
        twice = attach(halves.filter("alone"), merged.filter("n > 1").select(*alike, "n"), alike, ["rid", "pick"]).filter("n IS NOT NULL")
        out = out.union(twice.selectExpr("rid", "pick - high AS first", "pick - low AS last"))
        rows = merged.select(*alike, "one.*", (F.col("alone") & (F.col("n") == 1)).alias("alone"))


def _cut_batches(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, ranges in zip(batch.column("blob").to_pylist(), batch.column("ranges").to_pylist()):
                data = unpack(blob)
                spans: list[list[int]] = []
                for r in sorted(ranges or [], key=lambda r: r["first"]):
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + length)
                    else:
                        spans.append([r["first"], r["last"] + length])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([r[4] for r in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept bytes."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    texts = save(packed(rows), "op09-texts")  # row ids are fixed here
    suffixes = save(texts.select("rid", "blob").mapInArrow(
        _suffix_batches(length, seed), "rid long, key long, context long, first int, more short, ahead short"), "op09-suffixes")
    index, hits = SuffixIndex(), None
    for b in range(batches):
        found = index.add(suffixes.filter(F.pmod("rid", F.lit(batches)) == b))
        hits = found if hits is None else hits.union(found)
    keys = save(hits.groupBy("key").agg((F.bool_or("several") | (F.min("context") != F.max("context"))).alias("several")), "op09-keys")
    shared = save(attach(suffixes, keys, ["key"], ["rid", "first"]).filter(F.col("several").isNotNull()), "op09-shared")

    mixed = shared.filter("several")
    counted = save(mixed.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "more", "ahead")).alias("one")),
                   "op09-contexts")
    runs = counted.select("key", "one.*", (F.col("n") == 1).alias("alone")).groupBy("rid").agg(
        F.collect_list(F.struct("key", "first", "more", "ahead", "alone")).alias("runs"))  # of one document
    contexts = save(texts.select("rid", "blob").join(runs, "rid").mapInArrow(
        _context_batches(length), "node long, low int, high int, bytes binary, rid long, pick int, alone boolean"), "op09-bytes")
    partial = settle(contexts, length, seed)
    twice = counted.filter("n > 1").select("key", "context", F.lit(True).alias("twice"))
    last = (F.col("first") + F.col("more")).alias("last")
    whole = attach(mixed, twice, ["key", "context"], ["rid", "first"]).filter("twice").select("rid", "first", last)
    alike = shared.filter("not several").select("rid", "first", last)
    ranges = partial.union(whole).union(alike).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))  # of one document
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return texts.join(ranges, "rid", "left").select("doc_id", "blob", "ranges").mapInArrow(_cut_batches(length, with_text), fields)
