"""Registered queries of the corpus operators: name -> (Spark plan, DuckDB text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .op01_feistel import pseudonymise
from .op02_chaining import fuzzy_passages
from .op03_style_tree import extract
from .op04_merkle import merkle
from .op05_bpe import encode
from .op06_toxicity import score
from .op07_mixing import source_mix
from .op08_exact import exact_groups
from .op09_suffix import remove_repeats
from .op10_simhash import near_groups
from .op11_repair import SQL as OP11_SQL
from .op11_repair import damage, repair
from .op12_link_trust import SQL as OP12_SQL
from .op12_link_trust import judge
from .op13_spelling import SQL as OP13_SQL
from .op13_spelling import spelling_forms

OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damage(conversations))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1,
    "op2_collinear_chains": op2,
    "op3_style_tree": op3,
    "op4_merkle_fingerprint": op4,
    "op5_bpe_transducer": op5,
    "op6_toxicity_trees": op6,
    "op7_source_mix": op7,
    "op8_exact_dedup": op8,
    "op9_suffix_levels": op9,
    "op10_simhash_positions": op10,
    "op11_conversation_repair": op11,
    "op12_link_trust": op12,
    "op13_spelling_forms": op13,
}
ORACLES: dict[str, str] = {"op8_exact_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_link_trust": OP12_SQL,
                           "op13_spelling_forms": OP13_SQL}
