"""Byte-level BPE over a minimal acyclic transducer of frequent words.

Texts are cut into words by the usual byte-level pattern, whole batches at a time on code point classes.  The
words of all documents are counted; the ``LEXICON`` most frequent ones (a documented bound, so the compiled
automaton stays a few MB) are merged once and compiled with their ids into a transducer, which every worker
maps into memory.  Within a batch each distinct word is looked up once; words outside the lexicon are merged
exactly by rank.  Decoding concatenates the bytes of the ids.

Edge cases: null text is empty and has no ids; the special token's string in a text gets its own id, as in the
library's default; texts of any length are encoded whole; repeated rows and further columns are harmless.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices
from .transducer import Transducer, build

LEXICON = 32_768
LONGEST = 48  # bytes of a lexicon word
FLUSH = 300_000
KEPT = 200_000
LETTER, NUMBER, OTHER, SPACE = range(4)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def code_point_classes() -> bytes:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            shift = [0x800 if i >= 0xD800 else 0 for i in (m.start(), m.end() - 1)]
            table[m.start() + shift[0]:m.end() + shift[1]] = kind
    table[0xD800:0xE000] = OTHER
    return table.tobytes()


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token if c in to_byte)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.single = [0] * 256
        for c, b in to_byte.items():
            self.single[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.token_offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Exact merges by lowest rank, leftmost first: a heap of candidate pairs over a linked list."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merges[p], i, *p) for i, p in enumerate(pairwise(ids)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (new, ids[k])) in self.merges:
                    heapq.heappush(heap, (*self.merges[p], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], new)) in self.merges:
                heapq.heappush(heap, (*self.merges[p], h, *p))
        return [i for i in ids if i >= 0]


def cut(texts: list[str], classes: np.ndarray, special: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as binary, number of words per text, positions of special tokens among the words)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    text_starts = np.cumsum([0, *map(len, texts)])
    start = np.zeros(n + 1, bool)  # segments: texts, and what lies around special tokens
    start[text_starts] = True
    found = []
    for token in special:
        if token in joined:
            for t, at in enumerate(text_starts[:-1]):
                for m in regex.finditer(regex.escape(token), texts[t]):
                    found.append((at + m.start(), at + m.end()))
    for a, b in found:
        start[[a, b]] = True
    kind = classes[points]
    blank = kind == SPACE
    begin = start[:n].copy()
    if n > 1:
        change = (kind[1:] != kind[:-1]) & (points[:-1] != 32)
        begin[1:] |= change & ~blank[1:] | blank[1:] & ~blank[:-1]
        begin[:-1] |= blank[:-1] & ~blank[1:] & ~start[1:n]
    quotes = np.flatnonzero(begin & (points == 39)) if n else np.zeros(0, np.int64)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        ends = np.concatenate([start, np.ones(3, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside = ~ends[quotes + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pair = inside & ~ends[quotes + 2] & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
                                             | (one == ord("l")) & (two == ord("l")))
        for mask, length in ((short, 2), (pair, 3)):
            at = quotes[mask]
            begin[at + 1] = False
            at = at[at + length < n] + length
            begin[at] = True
    for a, b in found:
        begin[a:b] = False
        begin[a] = True
    starts = np.flatnonzero(begin)
    width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    offsets = np.append(byte_at[starts], byte_at[-1]).astype(np.int32)
    data = joined.encode("utf-8", "surrogatepass")
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    per_text = np.diff(np.searchsorted(starts, text_starts))
    return words, per_text, np.searchsorted(starts, np.array([a for a, _ in found], np.int64))


def _texts(batch: pa.RecordBatch, a: int, b: int) -> list[str]:
    return [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.int64), np.concatenate([[0], np.cumsum(lengths)])


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of flat[offsets[w]:offsets[w + 1]] for every w, and the ends of the pieces."""
    lengths = offsets[which + 1] - offsets[which]
    ends = np.cumsum(lengths)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[which] - ends + lengths, lengths)
    return flat[index], ends


def count_words(docs: DataFrame, classes, special: list[str]) -> DataFrame:
    """(word, n): occurrences of each word over all texts, counted in the map tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = np.frombuffer(classes.value, np.uint8), {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "n"])
        for batch, a, b in text_slices(batches):
            words, _, skipped = cut(_texts(batch, a, b), table, special)
            some = words.value_counts()
            for w, n in zip(some.field("values").to_pylist(), some.field("counts").to_pylist()):
                counts[w] = counts.get(w, 0) + n
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_WORKER: dict = {}


def _worker(text: str, blob: tuple[bytes, bytes, bytes]) -> tuple[Vocabulary, Transducer, np.ndarray, np.ndarray]:
    """Per process: the parsed vocabulary and the mapped lexicon, made again only for other contents."""
    key = zlib.crc32(text.encode()), zlib.crc32(blob[0])
    if _WORKER.get("key") != key:
        made = Vocabulary(text), Transducer(blob[0]), np.frombuffer(blob[1], np.int64), np.frombuffer(blob[2], np.int64)
        _WORKER.update(key=key, made=made)
    return _WORKER["made"]


def _encode_words(words: pa.Array, vocab: Vocabulary, lexicon: Transducer, ids: np.ndarray, offsets: np.ndarray, seen: dict):
    """Flat ids and their offsets for an array of distinct words."""
    buffers = words.buffers()
    at = np.frombuffer(buffers[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    number = lexicon.numbers(data, at)
    rest = np.flatnonzero(number < 0)
    lists = []
    for i in rest.tolist():
        word = data[at[i]:at[i + 1]].tobytes()
        if (got := seen.get(word)) is None:
            if len(seen) >= KEPT:
                seen.clear()
            got = seen[word] = vocab.merge(word)
        lists.append(got)
    new, new_offsets = _flat(lists)
    number[rest] = lexicon.n_words + np.arange(len(rest))
    return number, np.concatenate([ids, new]), np.concatenate([offsets, offsets[-1] + new_offsets[1:]])


def compile_lexicon(docs: DataFrame, vocab: Vocabulary, classes, most: int = LEXICON) -> tuple[bytes, bytes, bytes]:
    """The automaton over the most frequent words, their ids and the offsets of these."""
    counted = count_words(docs, classes, list(vocab.special)).filter(F.length("word") <= LONGEST)
    top = counted.orderBy(F.col("n").desc(), "word").limit(most).select("word").collect()
    words = sorted({bytes(r.word) for r in top})
    ids, offsets = _flat([vocab.merge(w) for w in words])
    return build(words), ids.tobytes(), offsets.tobytes()


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        text = f.read()
    vocab = Vocabulary(text)
    special = list(vocab.special)
    send = spark.sparkContext.broadcast
    vocabulary, classes = send(text), send(code_point_classes())
    blob = send(compile_lexicon(docs, vocab, classes, lexicon_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon, ids, offsets = _worker(vocabulary.value, blob.value)
        table, seen = np.frombuffer(classes.value, np.uint8), {}
        for batch, a, b in text_slices(batches):
            texts = _texts(batch, a, b)
            words, per_text, specials = cut(texts, table, special)
            coded = words.dictionary_encode()
            number, flat, at = _encode_words(coded.dictionary, vocab, lexicon, ids, offsets, seen)
            which = number[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            if len(specials):  # they follow the words in the flat arrays
                order = {t.encode(): len(at) - 1 + i for i, t in enumerate(special)}
                flat = np.concatenate([flat, np.array([vocab.special[t] for t in special], np.int64)])
                at = np.concatenate([at, at[-1] + 1 + np.arange(len(special))])
                for p in specials.tolist():
                    which[p] = order[words[p].as_py()]
            all_ids, ends = gather(flat, at, which)
            ends = np.concatenate([[0], ends])
            text_ends = ends[np.concatenate([[0], np.cumsum(per_text)])]
            decoded, byte_ends = gather(vocab.token_bytes, vocab.token_offsets, all_ids)
            byte_ends = np.concatenate([[0], byte_ends])
            packed = all_ids.astype("<u4")
            columns = {"n_tokens": np.diff(text_ends), "ids_sha256": [], "decoded_sha256": []}
            extra = {"ids": [], "decoded": []}
            for lo, hi in pairwise(text_ends.tolist()):
                mine = decoded[byte_ends[lo]:byte_ends[hi]].tobytes()
                columns["ids_sha256"].append(hashlib.sha256(packed[lo:hi].tobytes()).hexdigest())
                shown = mine.decode("utf-8", "replace")
                columns["decoded_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                if with_ids:
                    extra["ids"].append(packed[lo:hi].astype(np.int32))
                    extra["decoded"].append(shown)
            arrays = [batch.column("doc_id").slice(a, b - a), pa.array(columns["n_tokens"], pa.int64()),
                      pa.array(columns["ids_sha256"], pa.string()), pa.array(columns["decoded_sha256"], pa.string())]
            names = ["doc_id", *columns]
            if with_ids:
                arrays += [pa.array(extra["ids"], pa.list_(pa.int32())), pa.array(extra["decoded"], pa.string())]
                names += list(extra)
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
