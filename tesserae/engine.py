"""Search, advice and access over one catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import render
from tesserae.operators import assets, expand, predicates, profile, relax, vector
from tesserae.planner import EmbeddingProvider, FacetPlanner, QuerySplitter
from tesserae.schema import COMPONENT_FACETS, STORE_ATTRIBUTES, FacetSchema
from tesserae.sources.catalog import CatalogSource
from tesserae.sources.files import FileSource


class CatalogError(Exception):
    """A request that can't be met; the cause is chained."""


@dataclass(frozen=True)
class Site:
    """Where the catalogue can be looked at, and the listing of its store."""

    base: str = ""
    project: str = ""
    store: str = ""


@dataclass
class Access:
    """What the constraints leave. records stay cached for all of it; close() lets them go. Of the links, unique_links has the
    first of each address, and link_stats how many there are of both."""

    hit_count: int
    facet_counts: DataFrame
    profile: DataFrame
    table: DataFrame
    summary: str
    predicate: str
    link: str
    snippet: str
    markdown: str
    json: str
    links: DataFrame | None
    unique_links: DataFrame | None
    link_stats: DataFrame | None
    records: DataFrame

    def close(self) -> None:
        self.records.unpersist()


class Engine:
    def __init__(self, catalog: CatalogSource, planner: FacetPlanner, splitter: QuerySplitter, embedder: EmbeddingProvider | None = None, store: DataFrame | None = None, files: FileSource | None = None, site: Site = Site()):
        """store: vec_id, embedding, component, name, description of what can be searched for. files: where links come from."""
        self.catalog, self.planner, self.splitter, self.embedder, self.store, self.files, self.site = catalog, planner, splitter, embedder, store, files, site

    def hits(self, query: str, fields: list[str], k: int = vector.TOP_K) -> dict[str, list[tuple[str, str]]]:
        """Names and descriptions by facet, k at most for each, by rank."""
        if unknown := [f for f in fields if f not in COMPONENT_FACETS]:
            raise CatalogError(f"can't search for {', '.join(unknown)}; only for {', '.join(COMPONENT_FACETS)}")
        if not fields or self.store is None or self.embedder is None:
            return {}
        parts = {c: text for c, text in self.splitter.split(query).items() if c in fields and text}
        out: dict[str, list[tuple[str, str]]] = {COMPONENT_FACETS[c]: [] for c in parts}
        if parts:
            asked = [(c, text, [float(x) for x in self.embedder.embed(text)]) for c, text in parts.items()]
            queries = self.store.sparkSession.createDataFrame(asked, "component string, text string, query array<double>")
            near = vector.search_components(self.store, queries, COMPONENT_FACETS, k, among="component", carry=["name", "description"])
            for r in near.orderBy("facet", "rank").collect():
                out[r.facet].append((r["name"], r.description))
        return out

    def advise(self, query: str, relevant: list[str], fields: list[str]) -> FacetSchema:
        try:
            return self.catalog.schema.narrowed(relevant, self.hits(query, fields))
        except KeyError as e:
            raise CatalogError(str(e)) from e

    def search(self, query: str, earlier: Sequence[str] = ()) -> dict[str, list[str]]:
        """Facet values that a query asks for, after what was said earlier; all of them are in their facet's domain."""
        plan = self.planner.plan(query, earlier)
        schema = self.advise(query, plan.relevant, plan.search_fields if plan.needs_search else [])
        found = self.planner.values(query, schema, earlier)
        return {k: kept for k, v in found.items() if (kept := [x for x in v if not schema[k].domain or x in schema[k].domain])}

    def links(self, records: DataFrame, parameters: list[str] | None = None) -> DataFrame:
        """The links of each entity's files, by what its records offer; a parameter with a default offers that where it has none."""
        if self.files is None:
            raise CatalogError("this engine has no source of files")
        schema = self.catalog.schema
        found = self.files.files()
        names = parameters or [n for n in schema.names[1:] if n in found.columns]
        offered = profile.offered(records, schema, names)
        for n in names:
            if schema[n].default:
                offered = offered.withColumn(n, expand.with_default(F.col(n), schema[n].default))
        return assets.file_links(offered, found.withColumnRenamed(schema.entity.name, "entity"), "entity", names)

    def relaxed(self, constraints: predicates.Constraints) -> dict[str, int]:
        """Hits without each facet of the constraints, by its name; without any facet, nothing."""
        schema = self.catalog.schema
        if unknown := [k for k in constraints if schema.asked_by(k) is None]:
            raise CatalogError(f"no facet {', '.join(unknown)}")
        counts = predicates.relaxed(self.catalog.records(), schema, constraints).where("dropped <> ''").collect()
        return {r.dropped: r.hits for r in counts}

    def minimal_relaxations(self, constraints: predicates.Constraints, wanted: int = 1) -> list[tuple[list[str], int]]:
        """The minimal sets of facets without which the constraints leave as many records as are wanted, with what they leave:
        smaller sets first, then those that leave more."""
        schema = self.catalog.schema
        if unknown := [k for k in constraints if schema.asked_by(k) is None]:
            raise CatalogError(f"no facet {', '.join(unknown)}")
        try:
            found = relax.minimal(self.catalog.records(), schema, constraints, wanted)
        except ValueError as e:
            raise CatalogError(str(e)) from e
        return sorted(((r.dropped, r.hits) for r in found.collect()), key=lambda x: (len(x[0]), -x[1], x[0]))

    def access(self, constraints: predicates.Constraints, query: str = "", with_files: bool | None = None) -> Access:
        """Counts, profiles, predicate, link and code of what the constraints leave, and the links of files where they are
        asked for: by with_files, else by the query, if there are hits."""
        schema, site = self.catalog.schema, self.site
        if unknown := [k for k in constraints if schema.asked_by(k) is None]:
            raise CatalogError(f"no facet {', '.join(unknown)}")
        records = self.catalog.records().where(predicates.condition(schema, constraints)).select(*schema.names).persist()
        count = records.count()
        lines = profile.summary_lines(records, schema).first()[0]
        attributes = list(STORE_ATTRIBUTES) if all(n in schema for n in STORE_ATTRIBUTES) else schema.names
        known = records.withColumn(schema.entity.name, profile.entity_of(schema))
        predicate = predicates.predicate_string(known, attributes).first()[0]
        link = predicates.search_link(site.base, constraints, site.project)
        asked = bool(count) and self.files is not None and (self.planner.wants_files(query) if with_files is None else with_files)
        counts = profile.facet_counts(records, schema)
        found = self.links(records) if asked else None
        unique = assets.dedup_first(found) if found is not None else None
        stats = assets.link_stats(found) if found is not None else None
        return Access(
            count, counts, profile.entity_profile(records, schema), profile.profile_table(records, schema), lines, predicate, link, render.snippet(site.store, predicate),
            render.markdown(query, count, lines, link, asked), render.facet_json(counts, count), found, unique, stats, records,
        )
