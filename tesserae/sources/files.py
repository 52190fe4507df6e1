"""File sources: the files of a catalogue's records, with the addresses that services offer."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import assets
from tesserae.operators.predicates import Constraints, condition
from tesserae.schema import Facet, FacetSchema
from tesserae.sources.paged import Fetch, listing

SERVICE = "OPENDAP"


class FileSource(Protocol):
    def files(self, constraints: Constraints | None = None) -> DataFrame:
        """Facets of each file, and url: the address that the service offers."""
        ...


class TableFiles:
    """Files that are a table: a column for each facet, and url, a list of address|mime|service."""

    def __init__(self, frame: DataFrame, schema: FacetSchema, service: str = SERVICE):
        self.frame, self.schema, self.service = frame, schema, service

    def files(self, constraints: Constraints | None = None) -> DataFrame:
        return assets.of_service(self.frame.where(condition(self.schema, constraints)), self.service)


class PagedFiles:
    """A remote listing, read through the data source of paged listings: constraints go to the service, and pages are fetched
    by tasks. open_session gives the token that a service asks for with each request."""

    def __init__(self, spark: SparkSession, fetch: Fetch, facets: list[str], project: str, service: str = SERVICE, open_session: Callable[[], str] | None = None):
        self.schema, self.service = FacetSchema(tuple(Facet(f) for f in facets)), service
        self.frame = listing(spark, fetch, facets, project, open_session=open_session)

    def files(self, constraints: Constraints | None = None) -> DataFrame:
        return assets.of_service(self.frame.where(condition(self.schema, constraints)), self.service)
