"""From a question to facets and values. Interfaces for models, and lexical ones that need none."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import choose
from tesserae.schema import COMPONENT_FACETS, FacetSchema

#: Words by which a query asks for the links of files.
FILE_WORDS = ("opendap", "download", "file", "files", "link", "links")


@dataclass(frozen=True)
class Plan:
    relevant: list[str] = field(default_factory=list)
    needs_search: bool = False
    search_fields: list[str] = field(default_factory=list)


class FacetPlanner(Protocol):
    """earlier: what the user said before in the conversation, the last turn last."""

    def plan(self, query: str, earlier: Sequence[str] = ()) -> Plan: ...

    def values(self, query: str, schema: FacetSchema, earlier: Sequence[str] = ()) -> dict[str, list[str]]: ...

    def wants_files(self, query: str) -> bool: ...


class QuerySplitter(Protocol):
    def split(self, query: str) -> dict[str, str]: ...


class EmbeddingProvider(Protocol):
    def embed(self, text: str) -> list[float]: ...


class StoredEmbeddings:
    """Vectors known beforehand; a text without one is an error of its own."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.vectors = vectors

    def embed(self, text: str) -> list[float]:
        if text not in self.vectors:
            raise LookupError(f"no stored vector for {text!r}")
        return self.vectors[text]


class WholeQuery:
    """Each component is asked the whole query."""

    def split(self, query: str) -> dict[str, str]:
        return dict.fromkeys(COMPONENT_FACETS, query)


class ModelSplitter:
    """A model is asked for the part of each component; what it says is recovered as split_parts does."""

    def __init__(self, spark: SparkSession, ask: Callable[[str], str]):
        self.spark, self.ask = spark, ask

    def split(self, query: str) -> dict[str, str]:
        said = self.spark.createDataFrame([(self.ask(query), query)], "response string, query string")
        parts = said.select(text.split_parts(F.col("response"), F.col("query")).alias("p")).first().p
        return {c: parts[f"{c}_query"] for c in COMPONENT_FACETS}


def says(query: str, value: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(value.lower())}(?!\w)", query.lower()) is not None


class LexicalPlanner:
    """A facet is relevant if the query says its name or one of its values; open facets that it names are searched for. What was
    said earlier counts for nothing."""

    def __init__(self, schema: FacetSchema):
        self.schema = schema

    def plan(self, query: str, earlier: Sequence[str] = ()) -> Plan:
        named = [f for f in self.schema.facets if says(query, f.name) or says(query, f.name.removesuffix("_id")) or any(says(query, v) for v in f.domain)]
        fields = [k for k, v in COMPONENT_FACETS.items() if any(f.name == v and not f.domain for f in named)]
        return Plan([f.name for f in named], bool(fields), fields)

    def values(self, query: str, schema: FacetSchema, earlier: Sequence[str] = ()) -> dict[str, list[str]]:
        found = {f.name: [v for v in f.domain if says(query, v)] for f in schema.facets}
        return {k: v for k, v in found.items() if v}

    def wants_files(self, query: str) -> bool:
        return any(says(query, w) for w in FILE_WORDS)


class ScoredPlanner(LexicalPlanner):
    """Values by their scores among a vocabulary's: misspelt words, words of descriptions and what was said before count too.
    A facet is relevant if it is named or a value of it scores enough."""

    def __init__(self, schema: FacetSchema, vocabulary: DataFrame):
        """vocabulary: facet, value, description."""
        super().__init__(schema)
        self.index = choose.VocabularyIndex.of(vocabulary.where(F.col("facet").isin(schema.names)))
        self.last: tuple[list[str], dict[str, list[str]]] = ([], {})

    def chosen(self, query: str, earlier: Sequence[str]) -> dict[str, list[str]]:
        said = [*earlier, query]
        if self.last[0] == said:
            return self.last[1]
        turns = [(0, i, t) for i, t in enumerate(said)]
        frame = self.index.postings.sparkSession.createDataFrame(turns, "conv_id long, turn long, text string")
        found = self.index.choose_in_turns(frame, F.col("turn") == len(earlier))
        self.last = said, {r.facet: list(r["values"]) for r in found.collect()}
        return self.last[1]

    def plan(self, query: str, earlier: Sequence[str] = ()) -> Plan:
        named, scored = super().plan(query), self.chosen(query, earlier)
        return Plan([n for n in self.schema.names if n in named.relevant or n in scored], named.needs_search, named.search_fields)

    def values(self, query: str, schema: FacetSchema, earlier: Sequence[str] = ()) -> dict[str, list[str]]:
        """The best value of each facet, and what the query says of domains that a search has narrowed."""
        scored = self.chosen(query, earlier)
        return super().values(query, schema) | {k: v[:1] for k, v in scored.items() if k in schema.names}
