"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled training rows by smoothed log-odds of their
document frequencies.  Per text: densities and counts of strong and weak lexicon words, their nearness to the
second person, capitals, punctuation, digits, obfuscated words and repetition.  Training rows are rated by
counts that leave their own fold out, trees are boosted on three folds and the fourth calibrates them.

Only ``TRAIN_ROWS`` labelled rows (the smallest by MD5 of doc_id; a documented bound) are fitted; everything is
scored, map-side, with the lexicon (at most ``LEXICON`` entries) and the model as broadcasts of bounded size.

Edge cases: null, empty and blank texts have all-zero features and a score like any other; without training
rows of both classes every score is the share of the class there is (0 without rows); null labels are left out
and several labels of one doc_id count as the largest; repeated rows score alike; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import bounded_batches, save, text_slices

TRAIN_ROWS = 20_000
LEXICON = 20_000
FOLDS = 4
STRONG, WEAK = 2.5, 0.8
CAUTION = 1.64  # standard errors taken off a weight
LEAST = 3  # toxic training documents that hold a lexicon entry
THRESHOLD = 0.3
NEAR = 4
KEPT = 200_000
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
                   "tú ti tus usted ustedes vosotros".split())
#: General insults, rated as strong before any label is seen.
INSULTS = frozenset(
    "idiot idiots stupid moron morons imbecile dumb fool pathetic worthless loser losers scum trash garbage clown disgusting "
    "jerk bastard idioten dumm dummkopf trottel blöd blödmann depp arschloch widerlich abschaum versager imbécile stupide "
    "crétin débile connard nul dégoûtant ordure racaille estúpido estúpida imbécil tonto tonta basura asqueroso patético "
    "inútil payaso".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MIXED = re.compile(r"[^\W\d_][\d*@$!#]+[^\W\d_]")
FEATURES = ["words", "strong", "weak", "n_strong", "n_weak", "top", "mass", "distinct", "near", "second", "capitals",
            "punctuation", "marks", "digits", "obfuscated", "repeats"]


def grams(word: str) -> list[str]:
    """A word and its beginnings of three to seven letters."""
    return [word + "$", *(word[:i] for i in range(3, min(7, len(word)) + 1))]


def weight_of(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Smoothed log-odds of document frequencies, less their uncertainty."""
    return (math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
            - CAUTION * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))


def plain(token: str) -> str:
    return EDGE.sub("", token).lower()


def in_test(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "_fold", "toxic"))):
            words = {plain(t) for t in (text or "").split()}
            counts.update((g, fold, toxic) for g in {g for w in words if w for g in grams(w)})
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()),
         pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["gram", "fold", "toxic", "n"])


def learn_lexicon(train: DataFrame, size: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """Weights per gram: one lexicon without each fold, and last the one of all rows."""
    counted = train.select("text", "_fold", "toxic").mapInArrow(_gram_counts, "gram string, fold int, toxic int, n long")
    cells = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}")
             for f in range(FOLDS) for y in (0, 1)]
    wide = counted.groupBy("gram").agg(*cells)
    pos, neg = (sum(F.col(f"n{f}{y}") for f in range(FOLDS)) for y in (1, 0))
    n_pos, n_neg = (sum(size.get((f, y), 0) for f in range(FOLDS)) for y in (1, 0))
    weight = (F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
              - CAUTION * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))
    rows = wide.filter((pos >= LEAST) & (weight > WEAK)).orderBy(weight.desc(), "gram").limit(LEXICON).collect()
    out = []
    for left in [*range(FOLDS), None]:
        kept = [f for f in range(FOLDS) if f != left]
        n_neg, n_pos = (sum(size.get((f, y), 0) for f in kept) for y in (0, 1))
        lexicon = {w + "$": STRONG + 0.5 for w in INSULTS}
        for r in rows:
            neg, pos = (sum(r[f"n{f}{y}"] for f in kept) for y in (0, 1))
            w = weight_of(pos, neg, n_pos, n_neg)
            if w > WEAK:
                lexicon[r.gram] = max(w, lexicon.get(r.gram, 0.0))
        out.append(lexicon)
    return out


def features(text: str | None, lexicon: dict[str, float], memo: dict) -> list[float]:
    """The dense features of one whole text."""
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(tokens)
    strong = weak = distinct = obfuscated = second = 0
    top = mass = 0.0
    hits = set()
    for token, k in counts.items():
        known = memo.get(token)
        if known is None:
            word = plain(token)
            w = max((lexicon.get(g, 0.0) for g in grams(word)), default=0.0) if word else 0.0
            known = w, bool(MIXED.search(token)), word in SECOND
            if len(memo) >= KEPT:
                memo.clear()
            memo[token] = known
        w, mixed, you = known
        if w:
            top, mass = max(top, w), mass + w * k
            weak += k
            if w > STRONG:
                strong, distinct = strong + k, distinct + 1
                hits.add(token)
        obfuscated += k * mixed
        second += k * you
    near = 0
    if hits and second:
        at = [i for i, t in enumerate(tokens) if memo.get(t, (0, 0, False))[2] or (t not in memo and plain(t) in SECOND)]
        places = np.array(at or [-10 * NEAR])
        mine = np.array([i for i, t in enumerate(tokens) if t in hits])
        j = np.searchsorted(places, mine)
        gap = np.minimum(np.abs(mine - places[np.minimum(j, len(places) - 1)]), np.abs(mine - places[np.maximum(j - 1, 0)]))
        near = int((gap <= NEAR).sum())
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(data.sum()))
    digits, capitals = int(data[48:58].sum()), int(data[65:91].sum())
    marks = int(data[33] + data[63])
    punctuation = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
    return [math.log1p(n), strong / n, weak / n, math.log1p(strong), math.log1p(weak), top, mass / math.sqrt(n), float(distinct),
            near / n, second / n, capitals / size, punctuation / size, marks / n, digits / size, obfuscated / n,
            max(counts.values()) / n]


def _feature_batches(lexicons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{} for _ in lexicons.value]
        for batch, a, b in text_slices(batches):
            part = batch.slice(a, b - a)
            rows = [features(t, lexicons.value[f], memos[f]) for t, f in zip(part.column("text").to_pylist(), part.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(rows, pa.list_(pa.float64()))], ["kept", "x"])
    return run


def with_features(docs: DataFrame, lexicons, keep: list[str], fold: Column) -> DataFrame:
    """(kept, x): the columns of ``keep`` as one struct, so that no name of theirs meets one used here, and the features
    under the lexicon of ``fold`` (-1: the one of all rows)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text", fold.alias("fold"))
    return rows.mapInArrow(_feature_batches(lexicons), StructType([rows.schema["kept"], StructField("x", ArrayType(DoubleType()))]))


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep`` (default all) with held_out, score and predicted in
    place of any columns of these names."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in (keep or docs.columns) if c not in ("held_out", "score", "predicted")]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.filter(F.col("toxic").isNotNull() & ~in_test(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    sample = save(sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"),
                                F.pmod(F.floor(crc / 4), F.lit(FOLDS)).cast("int").alias("_fold")), "op06-sample")
    # at most train_rows ids of 16 bytes
    train = save(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "op06-train")
    size = {(r["_fold"], r.toxic): r["count"] for r in train.groupBy("_fold", "toxic").count().collect()}
    n = [sum(v for (_, y), v in size.items() if (y > 0) == t) for t in (False, True)]
    fit = [sum(v for (f, y), v in size.items() if (y > 0) == t and f < FOLDS - 1) for t in (False, True)]
    held = F.coalesce(in_test(F.col("doc_id")), F.lit(False)).alias("held_out")
    if not all(fit):
        prior = float(n[1]) / max(1, sum(n))
        return docs.select(*keep, held, F.lit(prior).alias("score"), F.lit(int(prior >= THRESHOLD)).alias("predicted"))
    lexicons = spark.sparkContext.broadcast(learn_lexicon(train, size))
    table = save(with_features(train, lexicons, ["toxic", "_fold"], F.col("_fold")).select("kept.*", "x").repartition(6), "op06-features")
    ready = table.select("_fold", F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("_features"))
    trees = GBTClassifier(featuresCol="_features", predictionCol="_class", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, maxBins=64, seed=7).fit(
        ready.filter(F.col("_fold") < FOLDS - 1))
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    chance = vector_to_array("_probability")[1].alias("_chance")
    rest = ready.filter(F.col("_fold") == FOLDS - 1)
    curve = IsotonicRegression(featuresCol="_chance", labelCol="label", predictionCol="_calibrated").fit(
        trees.transform(ready if rest.isEmpty() else rest).select("label", chance))
    scored = with_features(docs, lexicons, list(dict.fromkeys(["doc_id", *keep])), F.lit(-1))
    scored = trees.transform(scored.select("kept", array_to_vector("x").alias("_features"))).select("kept", chance)
    scored = curve.transform(scored)
    # the calibrated steps keep the order of the trees' scores inside a step
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("_calibrated") + 0.01 * F.col("_chance")))
    held = F.coalesce(in_test(F.col("kept.doc_id")), F.lit(False)).alias("held_out")
    return scored.select(*[F.col(f"kept.`{c}`") for c in keep], held, value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
