"""Model training, tuning and scoring for a whole design grid (M).

A design is one fit: a family, a candidate's parameters, features and a seed.  Rows say in an array column which designs
train on them, so all repetitions, folds, feature sets and candidates of a study are fitted together: the logistic ones
by shared Newton steps (``logit``), the ensembles by shared histogram levels (``trees``).  Scoring is one pass over the
rows for all models, and tuning one grouped metric job over all candidates.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch
from . import metrics as M
from .logit import Linear, fit_logistic, matrix, membership
from .trees import LOCAL_BYTES, Ensemble, Tree, added, fit_trees

# Three candidates per family.
GRID = {
    "lr": [("lr_c01", {"C": 0.1, "iterations": 2000, "balanced": False}), ("lr_c1", {"C": 1.0, "iterations": 2000, "balanced": False}),
           ("lr_c1_balanced", {"C": 1.0, "iterations": 2000, "balanced": True})],
    "rf": [("rf_depth16_leaf1", {"trees": 200, "depth": 16, "leaf": 1, "balanced": False}),
           ("rf_depth24_leaf2", {"trees": 200, "depth": 24, "leaf": 2, "balanced": False}),
           ("rf_unlimited_leaf5_balanced", {"trees": 200, "depth": 1_000_000, "leaf": 5, "balanced": True})],
    "boosted": [("boosted_d4_lr005", {"trees": 300, "depth": 4, "rate": 0.05, "balanced": False}),
                ("boosted_d6_lr005", {"trees": 250, "depth": 6, "rate": 0.05, "balanced": False}),
                ("boosted_d6_lr01_balanced", {"trees": 200, "depth": 6, "rate": 0.10, "balanced": True})],
}
MODEL_BYTES = 128 << 20  # models of one scoring pass
SHARD_BYTES = 64 << 20  # held trees written at a time
BLOCK_ROWS = 1 << 16  # rows that meet the trees of a stored model at a time
TREE_BYTES = 32 << 20  # trees of a stored model that rows meet at a time


@dataclass(frozen=True)
class Design:
    """One fit.  ``run`` names what shares a winner (a repetition, a corpus); ``place`` is the candidate's place in the grid."""

    run: str
    family: str
    candidate: str
    place: int
    params: dict = field(hash=False)
    features: tuple[str, ...]
    seed: int = 7


def candidate_grid(family: str) -> list[tuple[str, dict]]:
    return [(name, dict(params)) for name, params in GRID[family]]


def grid_designs(runs: list[str], features: list[str], families=tuple(GRID), seed: int = 7) -> list[Design]:
    """Every candidate of the families for every run."""
    return [Design(run, family, name, place, params, tuple(features), seed)
            for run in runs for family in families for place, (name, params) in enumerate(candidate_grid(family))]


def class_counts(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    return row.n, row.p


def where(designs: list[Design], test) -> Column:
    """Array of the numbers of the designs whose run passes ``test(run)``, a condition on the row."""
    numbers: dict[str, list[int]] = {}
    for d, design in enumerate(designs):
        numbers.setdefault(design.run, []).append(d)
    none = F.array().cast("array<int>")
    return F.flatten(F.array(*[F.when(F.coalesce(test(run), F.lit(False)), F.array(*[F.lit(d) for d in ds])).otherwise(none) for run, ds in numbers.items()]))


def fit(df: DataFrame, designs: list[Design], fits: Column, ids: str = "sample_id", local_bytes: int = LOCAL_BYTES) -> list:
    """The model of each design.  ``df`` has label and the features; ``fits`` is its array of design numbers."""
    names = sorted({f for d in designs for f in d.features})
    spark = df.sparkSession
    path = scratch(spark, "fit")
    df.select(F.col(ids).alias("id"), "label", *[F.col(f).cast("double").alias(f) for f in names], fits.alias("fits")).write.parquet(path)
    rows = spark.read.parquet(path)
    out: list = [None] * len(designs)
    linear = [i for i, d in enumerate(designs) if d.family == "lr"]
    grown = [i for i, d in enumerate(designs) if d.family != "lr"]

    def part(numbers: list[int]) -> DataFrame:
        place = F.create_map(*[F.lit(x) for pair in zip(numbers, range(len(numbers))) for x in pair])
        return rows.withColumn("fits", F.transform(F.filter("fits", lambda d: F.map_contains_key(place, d)), lambda d: place[d]))

    if linear:
        settings = [{"features": designs[i].features, "C": designs[i].params["C"], "balanced": designs[i].params["balanced"]} for i in linear]
        most = max(designs[i].params["iterations"] for i in linear)
        for i, model in zip(linear, fit_logistic(part(linear), names, settings, most=most)):
            out[i] = model
    if grown:
        settings = [{"boosted": designs[i].family == "boosted", "features": designs[i].features, "seed": designs[i].seed, **designs[i].params} for i in grown]
        for i, model in zip(grown, fit_trees(part(grown), names, settings, "id", local_bytes=local_bytes)):
            out[i] = model
    return out


def score(df: DataFrame, models: list, which: Column | None = None, keep: list[str] | None = None, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``keep`` columns, model (number), p: one row per row and model that ``which`` lists (default: every fitted model).
    Models held in the driver go to the rows by broadcast; rows go to the trees of stored ones."""
    names = sorted({f for m in models for f in m.features})
    kept = keep if keep is not None else df.columns
    fitted = [d for d, m in enumerate(models) if m.error is None]
    stored = [d for d in fitted if getattr(models[d], "stored", None)]
    groups: list[list[int]] = [[]]
    size = 0
    for d in fitted:
        if d in stored:
            continue
        mine = len(pickle.dumps(models[d]))
        if groups[-1] and size + mine > model_bytes:
            groups.append([])
            size = 0
        groups[-1].append(d)
        size += mine
    lists = which if which is not None else F.array(*[F.lit(d) for d in fitted]).cast("array<int>")
    rows = df.select(*kept, lists.alias("_which"), *[F.col(f).cast("double").alias(f"_x_{f}") for f in names])
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", model int, p double"
    out = _score_stored(rows, models, stored, kept, names, schema) if stored else None
    for group in groups if groups[0] or out is None else []:
        held = df.sparkSession.sparkContext.broadcast({d: models[d] for d in group})  # at most model_bytes, or one model

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, lists = matrix(batch, [f"_x_{f}" for f in names]), membership(batch.column("_which"), len(models))
                for d, model in held.value.items():
                    at = np.nonzero(lists[:, d])[0]
                    if len(at):
                        mine = batch.select(kept).take(pa.array(at))
                        p = model.probabilities(x[at], names)
                        yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(np.full(len(at), d, np.int32)), pa.array(p)], [*kept, "model", "p"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _score_stored(rows: DataFrame, models: list, numbers: list[int], kept: list[str], names: list[str], schema: str) -> DataFrame:
    """Rows, one byte per feature, meet the trees of each model in blocks of about ``BLOCK_ROWS``; a block reads the trees
    in their order, so reruns add up alike.  Trees beyond ``TREE_BYTES`` come in further passes to which the rows carry
    their sums, so a task never holds a whole large forest."""
    spark, heads = rows.sparkSession, {d: models[d] for d in numbers}  # cuts, no trees
    rows = rows.filter(F.arrays_overlap("_which", F.array(*[F.lit(d) for d in numbers])))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*kept, *[f"_x_{f}" for f in names]), F.lit(blocks)).cast("int"))
    like: dict[tuple, int] = {}  # models of the same cuts bin a row alike
    way = {d: like.setdefault((m.features, *[c.tobytes() for c in m.cuts]), d) for d, m in heads.items()}
    held = spark.sparkContext.broadcast((heads, way))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, way = held.value
        for batch in batches:
            x, lists = matrix(batch, [f"_x_{f}" for f in names]), membership(batch.column("_which"), len(models))
            bins = {d: pa.array([r.tobytes() for r in heads[d].bins(x, names)], pa.binary()) for d in set(way.values())}
            for d in heads:
                at = np.nonzero(lists[:, d])[0]
                if len(at):
                    mine = batch.select([*kept, "_block"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(np.full(len(at), d, np.int32)), bins[way[d]].take(pa.array(at))],
                                                     [*kept, "_block", "model", "_bins"])

    parts = {d: max(1, min(m.size, -(-m.bytes // TREE_BYTES))) for d, m in heads.items()}
    passes = max(parts.values())

    def rate(last: bool):
        def run(key: tuple[pa.Scalar, ...], mine: pa.Table, trees: pa.Table) -> pa.Table:
            head, n = held.value[0][key[0].as_py()], mine.num_rows
            data, order = trees.column("data"), np.argsort(trees.column("tree").to_numpy(), kind="stable") if n else []
            bins = np.frombuffer(b"".join(mine.column("_bins").to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
            total = added(mine.column("_total").to_numpy(), bins, (Tree.unpack(data[int(i)].as_py()) for i in order))
            if last:
                return mine.select([*kept, "model"]).append_column("p", pa.array(head.rates(total)))
            return mine.set_column(mine.schema.get_field_index("_total"), "_total", pa.array(total))
        return run

    fields = schema.rsplit(", model int", 1)[0]
    state = f"{fields}, _block int, model int, _bins binary, _total double"
    binned = rows.mapInArrow(cut, f"{fields}, _block int, model int, _bins binary").withColumn("_total", F.lit(0.0))
    size, share = (F.create_map(*[F.lit(v) for d in numbers for v in (d, n(d))]) for n in (lambda d: max(1, heads[d].size), parts.get))
    trees = _stored_trees(spark, models, numbers).withColumn("_pass", F.floor(F.col("tree") * share[F.col("model")] / size[F.col("model")]))
    trees = trees.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    for k in range(passes):
        now = trees.filter(F.col("_pass") == k).drop("_pass")
        last = k + 1 == passes
        binned = binned.groupBy("model", "_block").cogroup(now.groupBy("model", "_block")).applyInArrow(rate(last), schema if last else state)
    return binned


def _stored_trees(spark: SparkSession, models: list, numbers: list[int]) -> DataFrame:
    """(model, tree, data) of stored ensembles, under their numbers in ``models``."""
    out = None
    for path in sorted({models[d].stored for d in numbers}):
        mine = [d for d in numbers if models[d].stored == path]
        names = F.create_map(*[F.array(*[F.lit(d) for d in mine if models[d].number == n]) if i else F.lit(n)
                               for n in sorted({models[d].number for d in mine}) for i in (0, 1)])
        part = spark.read.parquet(path).withColumn("_to", names[F.col("model")]).filter(F.col("_to").isNotNull()).select(
            F.explode("_to").alias("model"), "tree", "data")
        out = part if out is None else out.unionByName(part)
    return out


TUNING = "model int, run string, family string, candidate string, candidate_index int, params_json string, status string, error string"


def tuning_table(scored: DataFrame, designs: list[Design], models: list) -> DataFrame:
    """One row per design: best grid threshold and AUC on its validation rows (``scored``: model, label, p), the error of a
    design that has no model, and ``selected``: the first of its run and family by Macro-F1, then AUC, then place."""
    spark = scored.sparkSession
    about = spark.createDataFrame([(i, d.run, d.family, d.candidate, d.place, json.dumps(d.params, sort_keys=True),
                                    "failed" if m.error else "ok", m.error) for i, (d, m) in enumerate(zip(designs, models))], TUNING)
    t = M.grid_threshold(scored, ["model"])
    a = M.score_table(scored, ["model"]).groupBy("model").agg(M.roc_auc().alias("roc_auc"))
    out = about.join(t, "model", "left").join(a, "model", "left")
    order = Window.partitionBy("run", "family").orderBy(F.col("status") != "ok", F.desc_nulls_last("macro_f1"), F.desc_nulls_last("roc_auc"), "candidate_index")
    return out.withColumn("selected", (F.row_number().over(order) == 1) & (F.col("status") == "ok"))


def select(df: DataFrame, designs: list[Design], fits: Column, validates: Column, ids: str = "sample_id",
           local_bytes: int = LOCAL_BYTES) -> tuple[list, list[dict]]:
    """(models, tuning rows) of all designs: fitted on the rows of ``fits``, rated on the rows of ``validates``."""
    models = fit(df, designs, fits, ids, local_bytes)
    path = scratch(df.sparkSession, "validation")
    score(df, models, validates, ["label"]).write.parquet(path)
    scored = df.sparkSession.read.parquet(path)
    tuning = [r.asDict() for r in tuning_table(scored, designs, models).orderBy("model").collect()]  # one row per design
    return models, tuning


def winners(tuning: list[dict]) -> list[dict]:
    """The selected rows; a run and family without any fitted candidate is an error."""
    chosen = [t for t in tuning if t["selected"]]
    missing = {(t["run"], t["family"]) for t in tuning} - {(t["run"], t["family"]) for t in chosen}
    if missing:
        raise ValueError(f"no candidate could be fitted for {sorted(missing)}")
    return chosen


# ---------------------------------------------------------------- reuse
def _head(model) -> bytes:
    """A model without its trees."""
    if isinstance(model, Linear):
        head = {"kind": "linear", "intercept": model.intercept, "coefficients": model.coefficients, "steps": model.steps}
    else:
        head = {"kind": "ensemble", "cuts": [c.tolist() for c in model.cuts], "boosted": model.boosted, "base": model.base, "size": model.size,
                "bytes": model.bytes or 15 * sum(len(t.feature) for t in model.held)}
    return json.dumps({"features": model.features, "error": model.error, **head}).encode()


def save(spark: SparkSession, models: list, path: str) -> None:
    """Writes heads (model, data) and trees (model, tree, data); stored trees are copied by tasks, and no code is stored,
    so any session can read them."""
    heads = [(i, bytearray(_head(m))) for i, m in enumerate(models)]
    spark.createDataFrame(heads, "model int, data binary").write.mode("overwrite").parquet(f"{path}/heads")
    trees = spark.createDataFrame([], "model int, tree int, data binary")
    stored = [i for i, m in enumerate(models) if getattr(m, "stored", None)]
    if stored:
        trees = trees.unionByName(_stored_trees(spark, models, stored))
    trees.write.mode("overwrite").parquet(f"{path}/trees")
    part, size = [], 0
    last = [(i, t, tree) for i, m in enumerate(models) for t, tree in enumerate(getattr(m, "held", ()))]
    for k, (i, t, tree) in enumerate(last):  # trees that the driver holds, about SHARD_BYTES at a time
        part.append((i, t, bytearray(tree.pack())))
        size += len(part[-1][2])
        if size > SHARD_BYTES or k + 1 == len(last):
            spark.createDataFrame(part, "model int, tree int, data binary").write.mode("append").parquet(f"{path}/trees")
            part, size = [], 0


def load(spark: SparkSession, path: str, wanted: list[int] | None = None) -> list:
    """The models of ``path``, or those of the numbers ``wanted``, in order of number; trees stay where they are."""
    stored = spark.read.parquet(f"{path}/heads")
    stored = stored if wanted is None else stored.filter(F.col("model").isin(wanted))
    out = []
    for r in stored.orderBy("model").collect():  # heads alone
        head = json.loads(bytes(r.data))
        if head["kind"] == "linear":
            out.append(Linear(tuple(head["features"]), head["intercept"], tuple(head["coefficients"]), head["steps"], head["error"]))
        else:
            out.append(Ensemble(tuple(head["features"]), tuple(np.array(c, float) for c in head["cuts"]), head["boosted"], head["base"], (),
                                head["error"], f"{path}/trees", r.model, head["size"], head.get("bytes", 0)))
    return out


def coefficients(spark: SparkSession, models: list, runs: list[str]) -> DataFrame:
    """(run, feature, coefficient) of linear models."""
    rows = [(run, f, float(c)) for run, m in zip(runs, models) for f, c in zip(m.features, m.coefficients)]
    return spark.createDataFrame(rows, "run string, feature string, coefficient double")


def source_discrimination(df: DataFrame, names: list[str], entity: str, seeds: list[int], ids: str = "sample_id") -> DataFrame:
    """How well a balanced logistic model tells the two sources apart inside each class, on entities it has not seen.

    ``df`` has label, source_id, the entity and the features; nulls of a feature take its median over the class.  One
    design per class and seed, all fitted together; a quarter of the entities is held out by seed.
    """
    from ..functions.columns import joined, unit

    medians = df.groupBy("label").agg(*[F.percentile_approx(F.col(n).cast("double"), 0.5, 10000).alias(f"_m_{n}") for n in names])
    # two rows, one per class
    filled = df.join(F.broadcast(medians), "label").withColumns({n: F.coalesce(F.col(n), F.col(f"_m_{n}")) for n in names}).withColumnsRenamed(
        {"label": "class_label", "source_id": "label"})
    runs = [f"{y}:{seed}" for y in (0, 1) for seed in seeds]
    designs = [Design(run, "lr", "lr_c1_balanced", 0, GRID["lr"][2][1], tuple(names)) for run in runs]

    def test(run: str) -> Column:
        return unit(joined(":", F.lit("sd" + run.split(":")[1]), entity)) < 0.25

    def own(run: str) -> Column:
        return F.col("class_label") == int(run.split(":")[0])

    models = fit(filled, designs, where(designs, lambda r: own(r) & ~test(r)), ids)
    s = score(filled, models, where(designs, lambda r: own(r) & test(r)), ["label", "class_label"])
    seed = F.element_at(F.array(*[F.lit(int(r.split(":")[1])) for r in runs]), F.col("model") + 1)
    s = s.select("class_label", seed.alias("seed"), "label", "p")
    return M.score_table(s, ["class_label", "seed"]).groupBy("class_label", "seed").agg(
        F.max("tot_neg").alias("test_left"), F.max("tot_pos").alias("test_right"), M.roc_auc().alias("auc"))
