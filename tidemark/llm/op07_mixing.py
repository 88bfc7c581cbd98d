"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are reduced to membership patterns (the set of sources a document belongs to): one row of document
and word counts per pattern.  The flow network has an arc set per pattern whose cost rises with each repetition
(a first pass is free, a second costs 1, a third 2), pattern-to-source arcs, and quota arcs to the sink; it is
solved by successive shortest paths.  A network has one node per pattern and source, never per document, and
more than ``MAX_NODES`` of either fail the job with an error.

A pattern's words are laid out once per repetition in seeded order (MD5 of seed and doc_id).  The flow fixes how
many words T the pattern gives; document d with the words [x, x + size) of each repetition e gives the overlap
of [e S + x, e S + x + size) with [0, T).  So at most one document per pattern is cut, quotas are met to the
word, and no document exceeds ``epochs`` times its size.  Positions are sums over 4096 seeded blocks and then
inside a block, so a source with a third of all rows is spread, and reruns agree.

Edge cases: null or blank texts have size zero and take nothing; a null source is a source of its own, last in
order; rows of repeated doc_id are placed by their size as well and their order among equals does not matter to
any sum; with no words at all every target is zero; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

EPOCHS = 3
MAX_NODES = 100_000
SEED = "mix-1"


def waterfill(sizes: dict[str, int], weights: dict[str, float], epochs: int = EPOCHS) -> dict[str, float]:
    """Targets that share all words by weight; a target stops at ``epochs`` times its source's size and the
    excess is shared again by weight until none is above."""
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        weight = sum(weights[s] for s in free)
        share = {s: left * weights[s] / weight for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return {s: capped.get(s, share.get(s, 0.0)) for s in sizes}
        capped |= {s: float(epochs * sizes[s]) for s in over}


def min_cost_flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], epochs: int = EPOCHS) -> dict[tuple, dict[str, int]]:
    """Words that each pattern gives to each of its sources: the largest flow, at the least repetition cost."""
    names = {("start",): 0, ("end",): 1}
    graph: list[list[list]] = [[], []]

    def node(key):
        if key not in names:
            names[key] = len(graph)
            graph.append([])
        return names[key]

    def arc(a, b, capacity, cost):
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return a, len(graph[a]) - 1

    given = {}
    for p in sorted(patterns):
        for e in range(epochs):
            arc(0, node(("pattern", p)), patterns[p], e)
        for s in p:
            given[p, s] = arc(node(("pattern", p)), node(("source", s)), epochs * patterns[p], 0)
    for s in sorted(quotas):
        arc(node(("source", s)), 1, quotas[s], 0)
    potential = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        far[0], via, heap = 0, {}, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for i, (v, capacity, cost, _) in enumerate(graph[u]):
                if capacity and d + cost + potential[u] - potential[v] < far[v]:
                    far[v], via[v] = d + cost + potential[u] - potential[v], (u, i)
                    heapq.heappush(heap, (far[v], v))
        if 1 not in via:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far)]
        path, v = [], 1
        while v:
            u, i = via[v]
            path.append(graph[u][i])
            v = u
        push = min(x[1] for x in path)
        for x in path:
            x[1] -= push
            graph[x[0]][x[3]][1] += push
    out: dict = defaultdict(dict)
    for (p, s), (a, i) in given.items():
        out[p][s] = epochs * patterns[p] - graph[a][i][1]
    return out


def mix(docs: DataFrame, members, quotas, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds size, pattern, taken and ``given`` (words per source) to doc_id.

    ``members``: column with the sorted array of a document's sources; ``quotas``: function of the patterns'
    word counts that returns integer words per source.
    """
    spark = docs.sparkSession
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    rows = save(docs.select("doc_id", F.coalesce(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)), F.lit(0))
                            .cast("long").alias("size"), members.alias("pattern"), order.alias("order")), "op07-rows")
    rows = rows.withColumn("block", F.substring("order", 1, 3))
    blocks = save(rows.groupBy("pattern", "block").agg(F.sum("size").alias("words")), "op07-blocks")
    found = blocks.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_NODES + 1).collect()
    if len(found) > MAX_NODES or len({s for r in found for s in r.pattern}) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns or sources")
    patterns = {tuple(r.pattern): r.words for r in found}
    flow = min_cost_flow(patterns, quotas(patterns), epochs)
    plan = []
    for p, words in patterns.items():
        ends = [0, *accumulate(flow[p][s] for s in p)]
        plan.append((list(p), words, ends[-1], list(zip(p, ends, ends[1:]))))
    plan = spark.createDataFrame(
        plan, "pattern array<string>, whole long, give long, parts array<struct<source:string,lo:long,hi:long>>")

    before = Window.partitionBy("pattern").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.join(plan, "pattern").withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = Window.partitionBy("pattern", "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, ["pattern", "block"])
    at = F.col("offset") + F.col("local")

    def overlap(lo, hi):
        """Words of all repetitions of the document that lie in [lo, hi)."""
        starts = [F.col("whole") * e + at for e in range(epochs)]
        return sum(F.greatest(F.lit(0).cast("long"), F.least(s + F.col("size"), hi) - F.greatest(s, lo)) for s in starts)

    given = F.transform("parts", lambda p: F.struct(p.source.alias("source"), overlap(p.lo, p.hi).alias("words")))
    return rows.select("doc_id", "size", "pattern", overlap(F.lit(0).cast("long"), F.col("give")).alias("taken"), given.alias("given"))


def key_of(source):
    """A text key that keeps code point order and puts null last (no source starts with the last code point)."""
    return F.when(source.isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit(" "), source))


def source_mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Mixes all documents: sources in code point order, null last, weigh 1, 2, 3 in turn and share all words.
    One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    spark, state = docs.sparkSession, {}

    def quotas(patterns):
        sizes = {p[0]: n for p, n in patterns.items()}
        weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
        state["sizes"], state["targets"] = sizes, waterfill(sizes, weights, epochs)
        return {s: int(round(t)) for s, t in state["targets"].items()}

    mixed = mix(docs, F.array(key_of(F.col("source"))), quotas, epochs, seed)
    rows = [(s, n, state["targets"][s]) for s, n in state["sizes"].items()]
    targets = spark.createDataFrame(rows, "key string, source_size long, target double")
    out = mixed.withColumn("key", F.element_at("pattern", 1)).join(targets, "key")
    return out.select("doc_id", "size", "source_size", "target", "taken")
