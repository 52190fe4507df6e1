"""Paged listings of a remote service as a data source of Spark.

A listing is asked by facets and answers in pages. The source's schema is its facets and the addresses of each file; filters
on facets go to the service with the request, and are checked again by Spark, so that a service that compares loosely or
ignores one changes no result. The driver asks for the first page, which tells how many files there are and how long pages
are; from that follow all offsets, and tasks fetch the pages between them. A session is opened once, and again by a task whose
page is refused.

Defined cases: a listing without files has no rows; a page that is shorter than due, or a first page that is empty although
there are files, is an error, as are further refusals; of a page that is longer than due the rest is left out, as the next
page has it; facets that a file lacks are null. Values with a comma or white space at their ends aren't sent, as a request
can't tell them from others.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Workers get this module's classes by value, so that they need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most tasks of a listing; each fetches pages that follow one another.
TASKS = 1024
#: The facets of a file and its addresses: a list of address|mime|service.
Doc = tuple[dict[str, str], list[str]]
#: Gives the number of all files, and a page of them from an offset. Raises PermissionError where the session doesn't hold.
Fetch = Callable[[dict[str, str], int], tuple[int, list[Doc]]]
#: What a request says besides its constraints (fixed values).
FIXED = {"type": "File", "format": "application/solr+json"}
TOKEN = "csrfmiddlewaretoken"


@dataclass(frozen=True)
class Pages(InputPartition):
    """Pages from first to last (exclusive), of so many files each; total: those of the listing."""

    first: int
    last: int
    size: int
    total: int
    token: str


class ListingReader(DataSourceReader):
    def __init__(self, fetch: Fetch, facets: list[str], fixed: dict[str, str], open_session: Callable[[], str] | None):
        self.fetch, self.facets, self.fixed, self.open_session = fetch, facets, fixed, open_session
        self.asked: dict[str, list[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            name = f.attribute[0] if values and len(f.attribute) == 1 else None
            if name in self.facets and name not in self.asked and all(isinstance(v, str) and v and v == v.strip() and "," not in v for v in values):
                self.asked[name] = values
            yield f

    def request(self, token: str) -> dict[str, str]:
        return {k: ",".join(v) for k, v in self.asked.items()} | self.fixed | ({TOKEN: token} if token else {})

    def page(self, token: str, offset: int) -> tuple[str, int, list[Doc]]:
        """The token with which it was given, the number of files, and the page."""
        try:
            return token, *self.fetch(self.request(token), offset)
        except PermissionError:
            if self.open_session is None:
                raise
            token = self.open_session()
            return token, *self.fetch(self.request(token), offset)

    def partitions(self) -> list[Pages]:
        token, total, first = self.page(self.open_session() if self.open_session else "", 0)
        if total and not first:
            raise OSError(f"a listing of {total} files has an empty first page")
        size = max(len(first), 1)
        pages = -(-total // size)
        each = max(1, -(-pages // TASKS))
        return [Pages(a, min(a + each, pages), size, total, token) for a in range(0, pages, each)] or [Pages(0, 0, size, 0, token)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        token = partition.token
        for k in range(partition.first, partition.last):
            offset = k * partition.size
            due = min(partition.size, partition.total - offset)
            token, _, found = self.page(token, offset)
            if len(found) < due:
                raise OSError(f"the page at {offset} has {len(found)} of {due} files")
            for own, urls in found[:due]:
                yield (*(own.get(f) for f in self.facets), urls)


def register(spark: SparkSession, fetch: Fetch, facets: list[str], fixed: dict[str, str], open_session: Callable[[], str] | None = None) -> str:
    """Make a listing known to the session; the name by which spark.read.format() knows it. fetch and open_session must be fit
    to be sent to workers."""
    format_name = f"listing_{uuid.uuid4().hex}"

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return ", ".join(f"`{f}` string" for f in facets) + ", url array<string>"

        def reader(self, schema) -> ListingReader:
            return ListingReader(fetch, facets, fixed, open_session)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return format_name


def listing(spark: SparkSession, fetch: Fetch, facets: list[str], project: str, local: bool = True, open_session: Callable[[], str] | None = None) -> DataFrame:
    """The files of a listing: facets and url, the list of address|mime|service. Filter it, and the service is asked."""
    fixed = {"project": project, **FIXED} | ({"distrib": "false"} if local else {})
    return spark.read.format(register(spark, fetch, facets, fixed, open_session)).load()
