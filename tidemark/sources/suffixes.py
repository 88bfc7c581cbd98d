"""Public-suffix list reader: the list's text form becomes the rules of ``attach_suffix``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.urls import SuffixRules, parse_suffix_rules


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> SuffixRules:
    """Rules of a suffix list file: comments dropped; the private section only when asked for."""
    text = spark.read.text(path, wholetext=True).select(
        F.explode(F.split(F.col("value") if private else F.substring_index("value", "===BEGIN PRIVATE DOMAINS===", 1), "\r?\n")).alias("rule"))
    rules = text.select(F.trim("rule").alias("rule")).filter("rule <> '' and not startswith(rule, '//')").distinct()
    return parse_suffix_rules(rules)
