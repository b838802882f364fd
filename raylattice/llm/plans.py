"""Queries of the text problems (p6_ to p8_), over all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raylattice.llm import leakage, packing, subjects
from raylattice.session import table


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_area"), table(spark, sf_dir, "subject_label"))


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p7_found, p8_found)}
#: None of these can be stated in SQL; tests hold them against brute force and held-out labels.
ORACLES: dict[str, str] = {}
