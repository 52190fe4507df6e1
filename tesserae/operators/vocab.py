"""Vocabularies: descriptions of values, and domains narrowed by search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_prefix(description: Column) -> Column:
    """What follows the first ': ' of the first line."""
    return F.regexp_replace(description, r"(?d)^.*?: ", "")


def described(values: DataFrame, vocabulary: DataFrame, on: list[str]) -> DataFrame:
    """values with their descriptions, '' where there are none."""
    return values.join(vocabulary.select(*on, "description"), on, "left").withColumn("description", F.coalesce("description", F.lit("")))


def dynamic_vocabulary(hits: DataFrame, base: DataFrame, relevant: list[str]) -> DataFrame:
    """facet, value, description, origin of the relevant facets: those of the hits, or of base where a facet has none.

    hits: facet, name, description, rank. Hits without a name are dropped; of a repeated name the last description stands.
    """
    named = hits.where(F.col("facet").isin(relevant) & F.col("name").isNotNull() & (F.col("name") != ""))
    found = named.groupBy("facet", F.col("name").alias("value")).agg(without_prefix(F.max_by("description", "rank")).alias("description")).withColumn("origin", F.lit("hit"))
    rest = base.where(F.col("facet").isin(relevant)).join(found.select("facet").distinct(), "facet", "left_anti")
    return found.unionByName(rest.select("facet", "value", "description", F.lit("base").alias("origin")))
