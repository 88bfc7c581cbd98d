"""Conversation structure repair by a dynamic programme over persistent edit strings.

``damage`` plants the faults, ``repair`` finds for every conversation the cheapest edits that give it the role order
``(s?(ua)+)?``, and of equally cheap edit strings the least one in ASCII order.

The programme goes through the rows in order and keeps one candidate per state of the role order: 0 nothing yet,
1 after ``s``, 2 after ``u``, 3 after ``a``.  A candidate's edits are a linked node that shares its prefix with others and
holds its ancestors at distances of powers of two and a rolling hash of the string up to it.  Ties are settled by a
search for the longest common prefix over those ancestors; equal hashes are verified letter by letter up to a shared
node, and a collision falls back to the strings themselves.  Of equally cheap candidates that used the same rows and
reached the same state none is a prefix of another, so the lesser one stays the lesser whatever follows.

Rows are sorted by range over the whole table, so a conversation of any length is spread over tasks.  Each task cuts
its rows into pieces; a piece that may continue elsewhere is solved for all four states it can begin in, the others for
state 0.  Pieces hold no texts.  A second pass chains the pieces of a conversation in order, and a third one streams its
rows against its edit string into SHA-256.  These two go through one task per conversation, row by row, as the digest
and the edit string of the contract are values of the whole conversation.  Equal rows are one row with a number.

Edge cases: null conv_id, turn, role and text read as one space, and the rows of a null conv_id are one conversation;
null turns come first and count in no gap; rows of one turn are ordered by role, then by SHA-256 of the text; repeated
rows are duplicates; an empty role has no initial and must be replaced or deleted; a conversation that lost all rows
has zeros, an empty audit and the digest of the empty string; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, save, tasks

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
PIECE = 20_000  # rows of a piece
MODULUS = (1 << 61) - 1
BASE = 1_000_003
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
ROOT = ("", 0, 0, ())
EXITS = {0, 3}


# ---------------------------------------------------------------- persistent edit strings
class Edits:
    """Nodes are (letter, depth, hash, ancestors at distances 1, 2, 4, ...)."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus

    def add(self, node: tuple, letter: str) -> tuple:
        ups = [node]
        while len(ups[-1][3]) >= len(ups):
            ups.append(ups[-1][3][len(ups) - 1])
        return letter, node[1] + 1, (node[2] * BASE + ord(letter)) % self.modulus, tuple(ups)

    @staticmethod
    def at(node: tuple, depth: int) -> tuple:
        while node[1] > depth:
            node = node[3][(node[1] - depth).bit_length() - 1]
        return node

    @staticmethod
    def same(a: tuple, b: tuple) -> bool:
        while a is not b:
            if a[0] != b[0] or a[1] != b[1]:
                return False
            a, b = a[3][0], b[3][0]
        return True

    @staticmethod
    def text(node: tuple) -> str:
        out = []
        while node[1]:
            out.append(node[0])
            node = node[3][0]
        return "".join(reversed(out))

    def less(self, a: tuple, b: tuple) -> bool:
        depth = min(a[1], b[1])
        x, y = self.at(a, depth), self.at(b, depth)
        if x[2] == y[2]:
            return a[1] < b[1] if self.same(x, y) else self.text(a) < self.text(b)
        for j in range(depth.bit_length() - 1, -1, -1):
            if j < len(x[3]) and x[3][j][2] != y[3][j][2]:
                x, y = x[3][j], y[3][j]
        if not self.same(x[3][0], y[3][0]):
            return self.text(a) < self.text(b)
        return x[0] < y[0]


class Programme:
    """Candidates per (state at the begin, state now): (cost, node)."""

    def __init__(self, begins, modulus: int = MODULUS):
        self.edits = Edits(modulus)
        self.live = {b: self.inserted({b: (0, ROOT)}) for b in begins}

    def better(self, old, cost: int, node: tuple, letter: str):
        if old is not None and old[0] < cost:
            return old
        new = cost, self.edits.add(node, letter)
        return new if old is None or cost < old[0] or self.edits.less(new[1], old[1]) else old

    def inserted(self, states: dict) -> dict:
        for sources, goal in (((0, 1, 3), 2), ((2,), 3)):
            for s in sources:
                if s in states:
                    states[goal] = self.better(states.get(goal), states[s][0] + INSERT, states[s][1], "I")
        return states

    def row(self, initial: str, drop: bool, truncated: bool) -> None:
        for begin, states in self.live.items():
            out: dict = {}
            for s, (cost, node) in states.items():
                out[s] = self.better(out.get(s), cost + DELETE, node, "D")
                if drop:
                    continue
                late = TRUNCATED if truncated else 0
                goal = 3 if s == 2 else 2
                out[goal] = self.better(out.get(goal), cost + REROLE + late, node, "R")
                goal = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(initial)
                if goal:
                    out[goal] = self.better(out.get(goal), cost + KEEP + late, node, "K")
            self.live[begin] = self.inserted(out)


# ---------------------------------------------------------------- rows
def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the damaged rows of ``conversations``, null role and text as one space."""
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                                (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("draw <> 0").select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           text.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("copies"))


def keyed(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit("n"))


def faults(damaged: DataFrame) -> DataFrame:
    """One saved row per distinct damaged row, with its number of copies and the fault of the first copy."""
    rows = damaged.groupBy(keyed("conv_id").alias("key"), "turn", "role", "text").agg(F.sum("copies").alias("n"))
    end = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({"sha": F.sha2("text", 256), "blank": end == "", "cut": ~F.right(end, F.lit(1)).isin(".", "!", "?")})
    rows = save(rows.withColumn("same", F.sha2(F.concat_ws(":", F.char_length("key").cast("string"), "key",
                                                           F.char_length("role").cast("string"), "role", "sha"), 256)), "op11-rows")
    # nulls are least in Spark's struct order, as they are in the row order
    first = rows.groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("same", "first")
    seen = F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")) & F.col("first").isNotNull(), F.lit(False))
    return save(attach(rows, first, ["same"], ["turn"]).select(
        "key", "turn", "role", "text", "sha", "n", "blank", (~F.col("blank") & seen).alias("seen"),
        (~F.col("blank") & ~seen & F.col("cut")).alias("truncated")), "op11-faults")


def counts(rows: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated)."""
    per = rows.groupBy("key", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return per.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


# ---------------------------------------------------------------- first pass: pieces
PIECES = "key string, at long, first string, last string, illegal long, begins array<int>, ends array<int>, costs array<long>, audits array<string>"


def unfold(initial: str, n: int, drop: bool, truncated: bool) -> Iterator[tuple[str, bool, bool]]:
    yield initial, drop, truncated
    for _ in range(n - 1):
        yield initial, True, False


def solve(rows: list[tuple], begins, modulus: int = MODULUS) -> list[tuple[int, int, int, str]]:
    """(begin, end, cost, edits) over rows of (initial, number, first copy to be deleted, truncated)."""
    programme = Programme(begins, modulus)
    for row in rows:
        for one in unfold(*row):
            programme.row(*one)
    return [(b, e, cost, Edits.text(node)) for b, states in programme.live.items() for e, (cost, node) in states.items()]


def illegal(rows: list[tuple], before: str = "") -> int:
    found = sum(0 if a[0] + b[0] in LEGAL else 1 for a, b in zip(rows, rows[1:]))
    return found + sum(n - 1 for _, n, _, _ in rows)


def pieces(most: int = PIECE):
    """Arrow function over rows sorted by conversation and order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << 40
        made = 0

        def piece(key: str, rows: list[tuple], begins) -> tuple:
            nonlocal made
            made += 1
            b, e, c, a = zip(*solve(rows, begins))
            return key, task + made, rows[0][0], rows[-1][0], illegal(rows), list(b), list(e), list(c), list(a)

        key, rows, whole, out = None, [], False, []  # the first conversation of a task may have begun before it
        for batch in batches:
            for k, initial, n, drop, truncated in zip(*(batch.column(c).to_pylist() for c in ("key", "initial", "n", "drop", "truncated"))):
                if k != key and rows:
                    out.append(piece(key, rows, [0] if whole else range(4)))
                    rows, whole = [], True
                elif len(rows) >= most:
                    out.append(piece(key, rows, range(4)))
                    rows, whole = [], False
                key = k
                rows.append((initial, n, drop, truncated))
            yield table_of(out, PIECES)
            out = []
        if rows:
            yield table_of([piece(key, rows, range(4))], PIECES)
    return run


def table_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


# ---------------------------------------------------------------- second pass: chains of pieces
class Chain:
    """The best candidate per state after the pieces so far, its edits as a list of strings that shares its parts."""

    def __init__(self):
        self.states, self.last, self.illegal = {0: (0, None)}, None, 0

    @staticmethod
    def parts(link) -> list[str]:
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return out[::-1]

    def least(self, a, b):
        """The lesser one of two links as whole strings."""
        x, y = self.parts(a), self.parts(b)
        i = 0
        while i < min(len(x), len(y)) and x[i] is y[i]:
            i += 1
        return a if "".join(x[i:]) <= "".join(y[i:]) else b

    def add(self, first: str, last: str, illegal: int, begins, ends, costs, audits) -> None:
        out: dict = {}
        for b, e, c, audit in zip(begins, ends, costs, audits):
            if b not in self.states:
                continue
            cost, link = self.states[b][0] + c, (audit, self.states[b][1])
            old = out.get(e)
            if old is None or cost < old[0] or (cost == old[0] and self.least(link, old[1]) is link):
                out[e] = cost, link
        self.states = out
        self.illegal += illegal + (0 if self.last is None or self.last + first in LEGAL else 1)
        self.last = last

    def result(self) -> tuple[int, str]:
        cost, _, audit = min((c, 0, "".join(self.parts(link))) for e, (c, link) in self.states.items() if e in EXITS)
        return cost, audit


CHAINS = "key string, cost long, illegal long, audit string"


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, chain, out = None, None, []
    for batch in batches:
        for k, _, *rest in zip(*(batch.column(f.split()[0]).to_pylist() for f in PIECES.split(", "))):
            if k != key:
                if chain:
                    cost, audit = chain.result()
                    out.append((key, cost, chain.illegal, audit))
                key, chain = k, Chain()
            chain.add(*rest)
        yield table_of(out, CHAINS)
        out = []
    if chain:
        cost, audit = chain.result()
        yield table_of([(key, cost, chain.illegal, audit)], CHAINS)


# ---------------------------------------------------------------- third pass: repaired texts
class Repaired:
    """Applies an edit string to the rows of a conversation as they come and digests the repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.place, self.state, self.lines, self.digest = audit, 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
        self.lines += 1

    def wanted(self) -> str:
        role, self.state = ("assistant", 3) if self.state == 2 else ("user", 2)
        return role

    def inserts(self) -> None:
        while self.audit[self.place:self.place + 1] == "I":
            self.line(self.wanted(), "")
            self.place += 1

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.inserts()
            edit = self.audit[self.place]
            self.place += 1
            if edit == "K" and role.startswith("s"):
                self.line(role, text)
                self.state = 1
            elif edit in "KR":
                given = self.wanted()
                self.line(role if edit == "K" else given, text)


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, repaired_sha256): each conversation's header row (kind 0, text = audit) comes before its rows."""
    key, now, out = None, None, []
    ddl = "key string, repaired_sha256 string"

    def close() -> None:
        if now:
            now.inserts()
            out.append((key, now.digest.hexdigest()))

    for batch in batches:
        for k, kind, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "role", "text", "n"))):
            if kind == 0:
                close()
                key, now = k, Repaired(text)
            else:
                now.row(role, text or "", n)
        yield table_of(out, ddl)
        out.clear()
    close()
    yield table_of(out, ddl)


def repair(conversations: DataFrame, damaged: DataFrame, most: int = PIECE) -> DataFrame:
    """One row per conv_id of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``damaged``: (conv_id, turn, role, text, copies) as ``damage`` gives it.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    parallel = tasks(spark)
    rows = faults(damaged)
    coded = rows.select("key", "turn", "role", "sha", F.left("role", F.lit(1)).alias("initial"), "n", (F.col("blank") | F.col("seen")).alias("drop"), "truncated")
    order = ["key", "turn", "role", "sha"]
    made = coded.repartitionByRange(parallel, *order).sortWithinPartitions(*order).mapInArrow(pieces(most), PIECES)
    made = save(made, "op11-pieces")
    chained = save(made.repartition(parallel, "key").sortWithinPartitions("key", "at").mapInArrow(chains, CHAINS), "op11-chains")
    none = F.lit(None)
    heads = chained.select("key", F.lit(0).alias("kind"), none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"),
                           none.cast("string").alias("sha"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    lines = rows.select("key", F.lit(1).alias("kind"), "turn", "role", "sha",
                        F.when(F.col("blank") | F.col("seen"), None).otherwise(F.col("text")).alias("text"), "n")
    digests = heads.unionByName(lines).repartition(parallel, "key").sortWithinPartitions("key", "kind", "turn", "role", "sha").mapInArrow(
        repaired, "key string, repaired_sha256 string")
    ids = conversations.groupBy("conv_id").agg(keyed_one()).select("conv_id", "key")
    out = ids.join(counts(rows), "key", "left").join(chained, "key", "left").join(digests, "key", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def keyed_one() -> Column:
    return F.first(keyed("conv_id")).alias("key")


TABLE = """SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t"""


def _best(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _option(state: str, cost: str, edit: str, line: str = "") -> str:
    """The candidate of ``state`` with one more edit; ``line`` is the line that the edit adds."""
    o = f"{state}.o || CASE WHEN {state}.k = 0 THEN '' ELSE chr(10) END || {line}" if line else f"{state}.o"
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': ({state}.c + {cost})::BIGINT, 'a': {state}.a || '{edit}', "
            f"'o': {o}, 'k': {state}.k + {1 if line else 0}}} END")


def _inserts(s: list[str]) -> list[str]:
    return [s[0], s[1], _best(s[2], *[_option(x, str(INSERT), "I", "'user:'") for x in (s[0], s[1], s[3])]), s[3]]


def _sql() -> str:
    late = f"CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END"
    free = "NOT (blank OR seen)"

    def when(test: str, option: str) -> str:
        return f"CASE WHEN {test} THEN {option} END"

    s = [f"d.s{i}" for i in range(4)]
    own, user, helper = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    drop = [_option(x, str(DELETE), "D") for x in s]
    rerole = [when(free, _option(s[i], f"{REROLE} + {late}", "R", helper if i == 2 else user)) for i in range(4)]

    def keep(i: int, initial: str) -> str:
        return when(f"{free} AND left(role, 1) = '{initial}'", _option(s[i], late, "K", own))

    moved = [drop[0], _best(drop[1], keep(0, "s")), _best(drop[2], *[x for i in (0, 1, 3) for x in (rerole[i], keep(i, "u"))]),
             _best(drop[3], rerole[2], keep(2, "a"))]
    start = "{'c': 0::BIGINT, 'a': '', 'o': '', 'k': 0}"
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR, k INT)"
    m = ["m0", "m1", "m2", "m3"]
    two = _inserts(m)[2]
    three = _best("m3", _option("n2", str(INSERT), "I", "'assistant:'"))

    def settled(inner: str, keep_columns: str) -> str:
        return f"SELECT {keep_columns}, m0 AS s0, m1 AS s1, n2 AS s2, {three} AS s3 FROM (SELECT *, {two} AS n2 FROM ({inner}))"

    first = f"SELECT c, 0::BIGINT AS i, {start} AS m0, {none} AS m1, {none} AS m2, {none} AS m3 FROM ids"
    following = "SELECT d.c, r.i AS i, " + ", ".join(f"{e} AS m{i}" for i, e in enumerate(moved)) + " FROM d JOIN r ON r.c = d.c AND r.i = d.i + 1"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)),
  lambda a, b: xor(t[(xor(a & 255, b) + 1)::INT], a >> 8)), 4294967295)""".format("coalesce(conversations.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED ({TABLE}),
ids AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
drawn AS MATERIALIZED (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS draw
  FROM conversations JOIN ids ON conversations.conv_id IS NOT DISTINCT FROM ids.conv_id, crc),
damaged AS (SELECT c, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, unnest(CASE draw WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM numbered),
r AS MATERIALIZED (SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS seen,
  trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
  lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS two FROM ordered),
d AS ({settled(first, "c, i")} UNION ALL {settled(following, "c, i")}),
solved AS (SELECT d.c, {_best("s0", "s3")} AS best FROM d JOIN (SELECT c, max(i) AS i FROM d GROUP BY c) USING (c, i)),
stats AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
  count_if(seen)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated, count_if(two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM r GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256
FROM ids JOIN solved USING (c) LEFT JOIN stats USING (c)
"""


SQL = _sql()
