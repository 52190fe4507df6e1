"""Counts of a catalogue's facets, overall and for each entity.

The long form (entity, facet, value, n) is what all others are made of. Scalar and many-valued facets go through one unpivot,
so the catalogue's scans and joins run once; a value that a record lists twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.predicates import is_value, values_of
from tesserae.schema import FacetSchema

#: The name under which records are counted beside the facets.
RECORDS = "#records"


def entity_of(schema: FacetSchema) -> Column:
    """A record's entity: the first of a list. A record without one keeps a null entity."""
    name = schema.entity.name
    return F.try_element_at(F.col(name), F.lit(1)) if schema.entity.multi else F.col(name)


def facet_values(records: DataFrame, schema: FacetSchema, names: list[str] | None = None, with_records: bool = False) -> DataFrame:
    """entity, facet, value: a row for each value that a record has, without empty ones and none; with_records: one more for
    the record itself. A schema that has only its entity has no rows."""
    wanted = schema.names[1:] if names is None else names
    frame = records.select(entity_of(schema).alias("#entity"), *wanted, *([F.lit("all").alias(RECORDS)] if with_records else []))
    columns = [*wanted, *([RECORDS] if with_records else [])]
    if not columns:
        return frame.select(F.col("#entity").alias("entity"), F.lit("").alias("facet"), F.lit("").alias("value")).limit(0)
    found = values_of(frame, columns, ["#entity"]).where(is_value(F.col("value")))
    return found.select(F.col("#entity").alias("entity"), "facet", "value")


def facet_counts(records: DataFrame, schema: FacetSchema) -> DataFrame:
    return facet_values(records, schema, schema.names).groupBy("facet", "value").agg(F.count("*").alias("n"))


def entity_counts(records: DataFrame, schema: FacetSchema) -> DataFrame:
    return records.groupBy(entity_of(schema).alias("entity")).agg(F.count("*").alias("dataset_count"))


def entity_profile(records: DataFrame, schema: FacetSchema, with_records: bool = False) -> DataFrame:
    """entity, facet, value, n; with_records: and a row for each entity whose facet is RECORDS."""
    return facet_values(records, schema, with_records=with_records).groupBy("entity", "facet", "value").agg(F.count("*").alias("n"))


def profile_table(records: DataFrame, schema: FacetSchema) -> DataFrame:
    """entity, parameter, values, details, all strings: a row of totals, then a row for each facet."""
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda p: F.concat(p["value"], F.lit(": "), p["n"].cast("string"))), ", ")
    rows = entity_profile(records, schema, True).groupBy("entity", "facet").agg(F.sum("n").cast("string").alias("total"), pairs.alias("details"))
    whole = F.col("facet") == RECORDS
    named = F.when(whole, "Total Datasets").otherwise(F.col("facet"))
    return rows.select("entity", named.alias("parameter"), F.when(whole, F.col("total")).otherwise(F.concat(F.lit("Total: "), "total")).alias("values"), F.when(whole, "").otherwise(F.col("details")).alias("details"))


def nested_profile(records: DataFrame, schema: FacetSchema) -> DataFrame:
    """entity, dataset_count, facets: a map of maps. Facets whose values are all empty have no entry."""
    rows = entity_profile(records, schema, True)
    inner = rows.groupBy("entity", "facet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("m"))
    whole = F.col("facet") == RECORDS
    listed = F.array_sort(F.collect_list(F.when(~whole, F.struct("facet", F.map_entries("m").alias("e")))))
    return inner.groupBy("entity").agg(F.max(F.when(whole, F.col("m")["all"])).alias("dataset_count"), F.map_from_entries(listed).alias("facets"))


def offered(records: DataFrame, schema: FacetSchema, names: list[str]) -> DataFrame:
    """entity and, for each of the facets, the list of its values among the entity's records, in order."""
    found = facet_values(records, schema, names, with_records=True).distinct()
    return found.groupBy("entity").agg(*(F.array_sort(F.collect_set(F.when(F.col("facet") == n, F.col("value")))).alias(n) for n in names))


def summary_lines(records: DataFrame, schema: FacetSchema) -> DataFrame:
    """One row: a line for each entity with its records, in order."""
    lines = F.sort_array(F.collect_list(F.concat(F.lit("- **"), F.coalesce("entity", F.lit("unknown")), F.lit("**: "), F.col("dataset_count").cast("string"), F.lit(" datasets"))))
    return entity_counts(records, schema).agg(F.array_join(lines, "\n").alias("summary"))
