"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "rag_pairs")


def long(c: str):
    return F.col(c).cast("long").alias(c)
