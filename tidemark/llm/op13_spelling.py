"""Spelling variants: words one edit apart, found through Bloom filters and confirmed by a join with the vocabulary.

Texts are cut into runs of letters, lower-cased in A-Z and, for one run in 199 (by crc32 of row and run), shortened by
a letter.  The vocabulary holds the words of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences.  Each word
generates its edits; being near is symmetric, so deletions and replacements by greater letters reach every pair from
one side exactly once.  An edit is first looked up in a Bloom filter of the words of its length, and only positives
travel to the vocabulary join, which removes the false ones.  Hashes are polynomial, so the hash of an edit
follows from prefix sums in a few operations and no edit is spelt out before its filter said yes.

Filters are sharded by word length (all long words share one shard), each made of 512-bit blocks with one bit in each
of eight 64-bit lanes.  One broadcast holds at most ``FILTER_BYTES``: a larger vocabulary is cut into slices by hash,
and each round broadcasts the filter of one slice and probes the edits of that slice.  The result is exact at any
rate of false positives.  Roots come by pointer doubling: counts grow fivefold along forms, so chains are short.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash; a run longer than
a batch is probed piece by piece; repeated rows count again; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, save, tasks

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
SHORTEN = 199
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
LONG = 64  # words of this length and above share a shard
BITS = 16  # bits of a filter per word
FILTER_BYTES = 64 << 20
CELLS = 1 << 20  # edits hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the vocabulary."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= MIN_LENGTH).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    out = runs.select(F.when(h % SHORTEN == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= MIN_LENGTH)
    return out.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads polynomial hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(29))


def shard(length: int) -> int:
    return min(length, LONG)


def slices_of(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h >> np.uint64(44)) & np.uint64(0xFFFFF)) % np.uint64(slices)


def block_and_bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the bit in each of the eight lanes as eight numbers of six bits."""
    block = (h & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)
    return block, mixed(h + np.uint64(0xA0761D6478BD642F))


def lane(bits: np.ndarray, i: int) -> np.ndarray:
    return np.uint64(1) << ((bits >> np.uint64(6 * i)) & np.uint64(63))


def codes(batch: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def by_length(values: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        groups.setdefault(len(v), []).append(i)
    return groups


def filter_rows(blocks: dict[int, int], slices: int):
    """Arrow function: (slice, shard, block, eight lanes) for every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("word").to_pylist()
            for length, at in by_length(values).items():
                c = codes([values[i] for i in at], length)
                h = mixed((c * powers(length)[:length]).sum(axis=1, dtype=np.uint64))
                block, bits = block_and_bits(h, blocks[shard(length)])
                columns = [slices_of(h, slices).astype(np.int32), np.full(len(h), shard(length), np.int32), block.astype(np.int64),
                           *(lane(bits, i).view(np.int64) for i in range(8))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["slice", "shard", "block", *(f"b{i}" for i in range(8))])
    return run


class Filters:
    """The filters of one slice: contained(hashes, length) looks mixed hashes up."""

    def __init__(self, blocks: dict[int, int], rows):
        self.lanes = {s: np.zeros((n, 8), np.uint64) for s, n in blocks.items()}
        for s, block, *bits in rows:
            self.lanes[s][block] = np.array(bits, np.int64).view(np.uint64)

    def contained(self, h: np.ndarray, length: int) -> np.ndarray:
        lanes = self.lanes.get(shard(length))
        if lanes is None:
            return np.zeros(0, np.int64)
        block, bits = block_and_bits(h, len(lanes))
        left = np.arange(len(h))
        for i in range(8):
            left = left[(lanes[block[left], i] & lane(bits[left], i)) != 0]
        return left


def edits(word_codes: np.ndarray, start: int, stop: int, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, mixed hashes, row, position, letter) of the edits at positions start..stop-1 of words of one length.

    Letter 0 marks a deletion.  Of equal neighbouring letters only the first is deleted; a replacement is greater.
    """
    length = word_codes.shape[1]
    power = powers(length)
    terms = word_codes * power[:length]
    ends = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = ends[:, -1]
    if length > MIN_LENGTH:
        new = np.ones((len(word_codes), stop - start), bool)
        first = max(start, 1)
        new[:, first - start:] = word_codes[:, first:stop] != word_codes[:, first - 1:stop - 1]
        row, at = np.nonzero(new)
        at = at + start
        before = ends[row, at] - terms[row, at]
        yield length - 1, mixed(before + (whole[row] - ends[row, at]) * INVERSE), row, at, np.zeros(len(row), np.uint64)
    row, at, which = np.nonzero(letters[None, None, :] > word_codes[:, start:stop, None])
    at, letter = at + start, letters[which]
    yield length, mixed(whole[row] + (letter - word_codes[row, at]) * power[at]), row, at, letter


def probe(filters, slices: int, current: int, alphabet: list[int]):
    """Arrow function: (word, n, other) for the edits that the broadcast filters may contain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = filters.value, np.array(sorted(alphabet), np.uint64)
        for batch in batches:
            values, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for length, rows in by_length(values).items():
                per = max(1, CELLS // (length * len(letters)))
                wide = max(1, CELLS // len(letters))
                for lo in range(0, len(rows), per):
                    group = rows[lo:lo + per]
                    c = codes([values[i] for i in group], length)
                    out: tuple[list, list, list] = ([], [], [])
                    for start in range(0, length, wide):
                        for size, h, row, at, letter in edits(c, start, min(length, start + wide), letters):
                            if slices > 1:
                                mine = np.nonzero(slices_of(h, slices) == current)[0]
                                h, row, at, letter = h[mine], row[mine], at[mine], letter[mine]
                            for i in held.contained(h, size).tolist():
                                word, p = values[group[row[i]]], int(at[i])
                                out[0].append(word)
                                out[1].append(counts[group[row[i]]])
                                out[2].append(word[:p] + (chr(int(letter[i])) if letter[i] else "") + word[p + 1:])
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                                                      pa.array(out[2], pa.string())], ["word", "n", "other"])
    return run


def near_pairs(vocabulary: DataFrame, alphabet: list[int] = ALPHABET, filter_bytes: int = FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """(word, n, other, other_n): every pair of near words of ``vocabulary`` (word, n; saved) once."""
    spark = vocabulary.sparkSession
    bounded_batches(spark)
    # at most LONG rows
    sizes = {r.shard: r.words for r in vocabulary.groupBy(F.least(F.char_length("word"), F.lit(LONG)).alias("shard")).agg(
        F.count(F.lit(1)).alias("words")).collect()}
    slices = -(-sum(sizes.values()) * bits // (8 * filter_bytes)) or 1
    blocks = {s: -(-n * bits // (512 * slices)) for s, n in sizes.items()}
    lanes = [f"b{i}" for i in range(8)]
    each = vocabulary.select("word").mapInArrow(filter_rows(blocks, slices), "slice int, shard int, block long, " + ", ".join(f"{x} long" for x in lanes))
    built = save(each.groupBy("slice", "shard", "block").agg(*[F.bit_or(x).alias(x) for x in lanes]), "op13-filters")
    dealt = save(vocabulary.repartition(tasks(spark)), "op13-dealt")
    found = None
    for current in range(slices):
        # at most filter_bytes of bits, plus one block per shard
        rows = built.filter(F.col("slice") == current).select("shard", "block", *lanes).toPandas().itertuples(index=False, name=None)
        filters = spark.sparkContext.broadcast(Filters(blocks, rows))
        part = save(dealt.mapInArrow(probe(filters, slices, current, alphabet), "word string, n long, other string"), "op13-positives")
        filters.destroy()
        found = part if found is None else found.unionByName(part)
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): follows forms to the last by doubling; every round is written."""
    links = save(forms.filter("form is not null").select("word", F.col("form").alias("root")), "op13-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = save(attach(links, onward, ["root"], ["word"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "op13-links")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def spelling_forms(docs: DataFrame, factor: int = FACTOR, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    vocabulary = save(words(docs), "op13-words")
    pairs = save(near_pairs(vocabulary, filter_bytes=filter_bytes), "op13-pairs")
    sides = pairs.select("word", "other", F.col("other_n").alias("m")).unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= F.col("n") * factor
    rows = save(vocabulary.join(best, "word", "left").select(
        "word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, -F.col("best.m")).alias("form_n")), "op13-forms")
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 in DuckDB: the table follows from its rule, letters of the class have at most two bytes in UTF-8.
CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
  lambda a, b: xor(t[(xor(a & 255, b) + 1)::INT], a >> 8))"""
TABLE = """SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t"""
SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({TABLE}),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, k, xor({CRC.format(text="id || ':' || run")}, 4294967295) AS h FROM counted, crc),
shortened AS (SELECT CASE WHEN h % {SHORTEN} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM shortened WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cuts AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) AS l, substring(word, i + 2) AS r FROM v, unnest(range(length(word))) u(i)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
         UNION SELECT a.word, v.word, v.n FROM cuts a JOIN v ON v.word = a.l || a.r
         UNION SELECT v.word, a.word, a.n FROM cuts a JOIN v ON v.word = a.l || a.r),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
  CASE WHEN m >= {FACTOR} * v.n THEN (SELECT min(x.other) FROM near x WHERE x.word = v.word AND x.m = best.m) END AS form,
  CASE WHEN m >= {FACTOR} * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
steps AS (SELECT word, arg_max(root, n) AS root FROM (SELECT walk.word, root, f.n FROM walk JOIN forms f ON f.word = walk.root) GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN steps USING (word)
"""
