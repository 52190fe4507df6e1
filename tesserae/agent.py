"""A bounded loop in which a model calls the engine's tools until it has an answer.

Models are an interface. The one that is built in follows fixed rules: search, access, and where nothing is found, leave out
the facet without which most is found, as one aggregate over the catalogue tells.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from tesserae.engine import Access, CatalogError, Engine

#: Tool calls of an answer, at most (fixed value).
MOST = 20


@dataclass(frozen=True)
class Config:
    """Which model answers, and how. The key is left out where the configuration is shown."""

    model: str = "rules"
    temperature: float = 1.0
    iterations: int = MOST
    key: str = field(default="", repr=False)


@dataclass(frozen=True)
class Step:
    """What a model does next: call a tool with arguments, or, if it names none, say text."""

    text: str = ""
    tool: str = ""
    arguments: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Turn:
    """Something said by user, assistant or tool. found: what a tool's text stands for; a call that failed has none."""

    role: str
    text: str
    tool: str = ""
    found: dict[str, Any] | None = None


class Model(Protocol):
    def next(self, turns: list[Turn]) -> Step: ...


class ByRule:
    """Search and access; without hits, the smallest set of facets goes that leaves some. Of sets of one size that leaves most
    goes, and of those that leave equally many the one that was named last."""

    def next(self, turns: list[Turn]) -> Step:
        asked = max(i for i, t in enumerate(turns) if t.role == "user")
        query, last = turns[asked].text, turns[-1]
        if last.role != "tool":
            return Step(tool="search", arguments={"query": query})
        if last.found is None:
            return Step(last.text)
        values = dict(last.found["facet_values"])
        if last.tool == "access":
            return Step(last.text) if last.found["hit_count"] or not values else Step(tool="relax", arguments={"facet_values": values})
        if last.tool == "relax":
            order = list(values)
            gone = max(last.found["minimal"], key=lambda x: (-len(x[0]), x[1], [order.index(n) for n in x[0]]), default=(order, 0))[0]
            values = {k: v for k, v in values.items() if k not in gone}
        return Step(tool="access", arguments={"facet_values": values, "query": query})


#: Models by name, made from a configuration; callers add their own.
MODELS: dict[str, Callable[[Config], Model]] = {"rules": lambda config: ByRule()}


@dataclass
class Answer:
    """facet_values: those that the last tool worked with; access: what they leave, if that was asked for."""

    text: str
    facet_values: dict[str, list[str]]
    access: Access | None
    turns: list[Turn]


class Agent:
    def __init__(self, engine: Engine, config: Config = Config(), models: dict[str, Callable[[Config], Model]] = MODELS):
        if config.model not in models:
            raise CatalogError(f"no model {config.model!r}; there are {', '.join(models)}")
        self.engine, self.model, self.most = engine, models[config.model](config), config.iterations
        self.tools = {"search": self.search, "access": self.access, "advise": self.advise, "relax": self.relax}
        self.last: Access | None = None
        self.earlier: list[str] = []

    def search(self, query: str) -> Turn:
        found = self.engine.search(query, self.earlier)
        return Turn("tool", json.dumps(found), "search", {"facet_values": found})

    def access(self, facet_values: dict[str, list[str]], query: str = "") -> Turn:
        got = self.engine.access(facet_values, query)
        if self.last:
            self.last.close()
        self.last = got
        return Turn("tool", got.markdown, "access", {"facet_values": facet_values, "hit_count": got.hit_count})

    def advise(self, query: str, relevant_facets: list[str], vector_search_fields: list[str] | None = None) -> Turn:
        schema = self.engine.advise(query, relevant_facets, vector_search_fields or [])
        return Turn("tool", schema.json(), "advise", {"facet_values": {f.name: list(f.domain) for f in schema.facets}})

    def relax(self, facet_values: dict[str, list[str]]) -> Turn:
        hits, sets = self.engine.relaxed(facet_values), self.engine.minimal_relaxations(facet_values)
        return Turn("tool", json.dumps({"without": hits, "minimal": sets}), "relax", {"facet_values": facet_values, "hits": hits, "minimal": sets})

    def call(self, step: Step) -> Turn:
        """A tool's result; what is wrong with a call is told to the model, which may make a better one."""
        if step.tool not in self.tools:
            return Turn("tool", f"no tool {step.tool!r}; there are {', '.join(self.tools)}", step.tool)
        try:
            inspect.signature(self.tools[step.tool]).bind(**step.arguments)
        except TypeError as e:
            return Turn("tool", f"{step.tool}: {e}", step.tool)
        try:
            return self.tools[step.tool](**step.arguments)
        except CatalogError as e:
            return Turn("tool", f"{step.tool}: {e}", step.tool)

    def answer(self, query: str, history: list[Turn] | None = None) -> Answer:
        """The model's answer, or that there is none after so many calls. history: earlier turns of the same conversation."""
        turns, values = [*(history or []), Turn("user", query)], {}
        self.last, text = None, None
        self.earlier = [t.text for t in history or [] if t.role == "user"]
        for calls in range(self.most + 1):
            step = self.model.next(turns)
            if not step.tool:
                text = step.text
            if not step.tool or calls == self.most:
                break
            turns.append(self.call(step))
            values = (turns[-1].found or {}).get("facet_values", values)
        said = f"No answer after {self.most} calls." if text is None else text
        return Answer(said, values, self.last, [*turns, Turn("assistant", said)])
