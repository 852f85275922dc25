"""Canonical names of domains, task categories and axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.session import join_dimension, squash


def names(aliases: DataFrame, field: str) -> DataFrame:
    """(key, canonical) of one field; canonical names are their own aliases."""
    rows = aliases.where(F.col("field_name") == field)
    both = rows.select(squash(F.col("alias")).alias("key"), "canonical").unionByName(rows.select(squash(F.col("canonical")).alias("key"), "canonical"))
    return both.where(F.col("key") != "").groupBy("key").agg(F.min("canonical").alias("canonical"))


def canonical(rows: DataFrame, aliases: DataFrame, field: str, column: str, out: str) -> DataFrame:
    """Adds ``out``: the canonical name of ``column``, squashed where unknown; null for null and blank names."""
    key = f"__{out}"
    known = names(aliases, field).select(F.col("key").alias(key), F.col("canonical").alias(f"{key}c"))
    rows = join_dimension(rows.withColumn(key, F.nullif(squash(F.col(column)), F.lit(""))), known, [key])
    return rows.withColumn(out, F.coalesce(f"{key}c", key)).drop(key, f"{key}c")


def key_of(name: Column) -> Column:
    """A name as compared, null for blank ones."""
    return F.nullif(squash(name), F.lit(""))
