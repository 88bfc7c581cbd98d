"""Training-corpus pipeline: STAGES of (name, function); each function takes (spark, docs, sf_dir).

Edge cases: null and empty texts are documents like others, equal to each other in exact dedup, and the mix takes none of
them; null and repeated doc_ids are told apart by row except in mixing, which repeats rows of one id alike; repeated rows
leave one; an empty table passes through every stage; further columns are kept under any name.

Every stage reads all rows its predecessor wrote.  The stages before the last return the columns of documents;
the last returns one row per remaining document with its encoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table
from tidemark.llm.op05_bpe import encode
from tidemark.llm.op06_toxicity import score
from tidemark.llm.op07_mixing import source_mix
from tidemark.llm.op08_exact import exact_groups
from tidemark.llm.op10_simhash import near_groups


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, row): the columns of ``docs`` as one struct beside a saved number, and (doc_id, text) whose doc_id also holds
    that number: decisions are a row's own, and no column of the table can meet a name used here."""
    rows = save(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    return rows, rows.select(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row").alias("doc_id"),
                             F.col("doc.text").alias("text"))


def _keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose row is in ``kept``."""
    return rows.join(kept.select(F.col("doc_id.row").alias("row")), "row", "left_semi").select("doc.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier predicts as toxic."""
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest row of each group of equal texts."""
    rows, named = _numbered(docs)
    return _keep(rows, exact_groups(named).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies, the one of smallest doc_id (null last)."""
    rows, named = _numbered(docs)
    return _keep(rows, near_groups(named).filter("doc_id.row = component_id.row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as often as the mix takes them, begun repetitions included, and drops those it does not take."""
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = source_mix(docs.select("doc_id", "text", "source")).filter("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max(copies).alias("copies"))
    out = docs.select(F.struct("*").alias("doc")).join(taken, F.col("doc.doc_id").eqNullSafe(F.col("id")))
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document."""
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing), ("BPE encoding and decoding", bpe)]

#: Fitted trees, seeded draws and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
