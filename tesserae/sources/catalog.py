"""Catalogue sources. A source gives records with a column for each facet; filters and pruning reach its scans."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import assets
from tesserae.operators.predicates import Constraints, condition
from tesserae.schema import Facet, FacetSchema


class CatalogSource(Protocol):
    schema: FacetSchema

    def records(self) -> DataFrame: ...


class TableCatalog:
    """A catalogue that is one table."""

    def __init__(self, frame: DataFrame, schema: FacetSchema):
        self.frame, self.schema = frame, schema

    def records(self) -> DataFrame:
        return self.frame


#: Facets of the sales tables: the brand is the entity, the words of a part's name are many-valued.
SALES = FacetSchema((
    Facet("p_brand", meaning="brand"),
    Facet("l_returnflag", domain=("A", "N", "R")),
    Facet("l_linestatus", domain=("F", "O")),
    Facet("o_orderstatus", domain=("F", "O", "P")),
    Facet("o_orderpriority"),
    Facet("c_mktsegment"),
    Facet("p_type"),
    Facet("n_name"),
    Facet("r_name"),
    Facet("p_name", multi=True),
))


class SalesCatalog:
    """Order lines with all they refer to: one line is one record. Dimensions join by their keys; the planner chooses how."""

    schema = SALES

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def records(self) -> DataFrame:
        lines, orders, customers = self.table("lineitem"), self.table("orders"), self.table("customer")
        nations, regions, parts = self.table("nation"), self.table("region"), self.table("part")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(*[f.name for f in SALES.facets if f.name != "p_name"], F.split("p_name", " ").alias("p_name"), "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "o_custkey", "l_extendedprice")


class VocabularySource(Protocol):
    def vocabulary(self) -> DataFrame:
        """facet, value, description, ord."""
        ...


class SchemaVocabulary:
    """The values that a schema's domains state, with their descriptions."""

    def __init__(self, spark: SparkSession, schema: FacetSchema):
        self.spark, self.schema = spark, schema

    def vocabulary(self) -> DataFrame:
        return self.spark.createDataFrame(self.schema.vocabulary(), "facet string, value string, description string, ord int")


class TableVocabulary:
    """A vocabulary that is a table of facet, value, description and, if it has it, ord."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def vocabulary(self) -> DataFrame:
        return self.frame if "ord" in self.frame.columns else self.frame.withColumn("ord", F.lit(None).cast("int"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store's listing: CSV with a header, read as strings without a pass for types; seq: the order of its lines."""
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("seq", F.monotonically_increasing_id())


def last_store(listing: DataFrame, constraints: Constraints, columns: list[str]) -> DataFrame:
    """The last line of a listing that fits constraints on its attributes."""
    schema = FacetSchema(tuple(Facet(n) for n in listing.columns))
    return assets.last_match(listing, condition(schema, constraints), "seq", columns)
