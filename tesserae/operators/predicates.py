"""Constraints on facets, as columns, as strings and as links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.schema import FacetSchema

Constraints = dict[str, str | Iterable[str]]


def normalized(constraints: Constraints | None) -> dict[str, list[str]]:
    """Values stripped, blank ones and facets without values dropped; a scalar is a list of one, any iterable a list."""
    out = {}
    for name, given in (constraints or {}).items():
        values = [given] if isinstance(given, str) else list(given or [])
        kept = [v.strip() for v in map(str, (v for v in values if v is not None)) if v.strip()]
        if kept:
            out[name] = kept
    return out


def normalized_values(values: Column) -> Column:
    """The same of a column of lists: items stripped, blank and null ones dropped."""
    return F.filter(F.transform(values, strip), lambda x: x != "")


def condition(schema: FacetSchema, constraints: Constraints | None) -> Column:
    """All facets must hold, each by any of its values. Scalars use IN, which reaches the scan."""
    parts = []
    for name, values in normalized(constraints).items():
        facet = schema.asked_by(name)
        if facet is None:
            raise KeyError(f"no facet {name!r}; there are {', '.join(schema.names)}")
        column = F.col(facet.name)
        if name != facet.name:
            last = lambda x: F.substring_index(x, "-", -1)
            column = F.transform(column, last) if facet.multi else last(column)
        parts.append(F.arrays_overlap(column, F.array(*map(F.lit, values))) if facet.multi else column.isin(values))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def is_value(value: Column) -> Column:
    """Neither null, nor empty, nor the word none in any case."""
    return value.isNotNull() & (value != "") & (F.lower(value) != "none")


def strip(text: Column) -> Column:
    """White space of Unicode off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def domain_violations(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(facet, value) rows that the vocabulary doesn't have, for facets that it states."""
    stated = vocabulary.select("facet").distinct()
    return values.join(stated, "facet", "left_semi").join(vocabulary, ["facet", "value"], "left_anti")


def predicate_part(name: str, values: Column) -> Column:
    """name == 'v', or name == ['v', 'w'] for several, in order; null for none. Quotes and backslashes are escaped."""
    escaped = F.transform(F.array_sort(values), lambda v: F.concat(F.lit("'"), F.regexp_replace(v, r"(['\\])", r"\\$1"), F.lit("'")))
    several = F.concat(F.lit(f"{name} == ["), F.array_join(escaped, ", "), F.lit("]"))
    return F.when(F.size(values) == 1, F.concat(F.lit(f"{name} == "), escaped[0])).when(F.size(values) > 1, several)


def values_of(frame: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, facet, value: a row for each value that a row has in columns of strings or of lists, null ones and sentinels too.

    One pass over the frame, so that its scans and joins run once: where there are lists, a row is laid out as one list for
    each column, and these lists as their items. No more rows are made than there are columns or values.
    """
    keys = keys or []
    lists = [n for n in names if isinstance(frame.schema[n].dataType, T.ArrayType)]
    if not lists:
        return frame.select(*keys, *names).unpivot(keys, names, "facet", "value")
    cells = F.array(*(F.col(n) if n in lists else F.array(n) for n in names))
    spread = frame.select(*keys, F.posexplode(cells).alias("#place", "#cell"))
    return spread.select(*keys, F.get(F.lit(names), F.col("#place")).alias("facet"), F.explode("#cell").alias("value"))


def predicate_string(records: DataFrame, names: list[str], legacy: bool = False) -> DataFrame:
    """One row: the predicate that the distinct values of the records make, in the order of names; columns may be strings or
    lists. Null, empty and none are no values. Attributes without values are left out; legacy writes them as [''], which
    matches the empty string only."""
    found = values_of(records, names).where(is_value(F.col("value"))).distinct()
    sets = found.agg(*(F.collect_set(F.when(F.col("facet") == n, F.col("value"))).alias(n) for n in names))
    part = lambda n: F.coalesce(predicate_part(n, F.col(n)), F.lit(f"{n} == ['']")) if legacy else predicate_part(n, F.col(n))
    return sets.select(F.concat_ws(" & ", *(part(n) for n in names)).alias("predicate"))


#: A comparison as predicates have it: a facet and a string or a list of strings, in quotes, with backslashes before quotes.
STRING = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
COMPARISON = re.compile(rf"(\w+)\s*(==|!=|\bnot\s+in\b|\bin\b)\s*({STRING}|\[\s*(?:{STRING}(?:\s*,\s*{STRING})*)?\s*\])")


def applied(text: str, schema: FacetSchema) -> Column:
    """A predicate's text as a condition, so that what predicate_string() writes can be asked of a catalogue again.

    Comparisons become Spark's, by any of their values, and &, |, and, or, not and parentheses stand for themselves; Spark
    reads the rest. A facet that is null or has no values equals nothing, so it differs from everything. Text of another form
    is an error, as is a facet that there isn't. An empty text leaves all records.
    """
    parts: list[str] = []

    def compared(m: re.Match) -> str:
        facet, unlike = schema.asked_by(m[1]), m[2] == "!=" or m[2].startswith("not")
        if facet is None or facet.name != m[1]:
            raise KeyError(f"no facet {m[1]!r}; there are {', '.join(schema.names)}")
        values = ", ".join(re.findall(STRING, m[3]))
        if not values:
            met = "false"
        elif facet.multi:
            met = f"arrays_overlap(`{facet.name}`, array({values}))"
        else:
            met = f"`{facet.name}` IN ({values})"
        parts.append(f"NOT coalesce({met}, false)" if unlike else f"({met})")
        return f" #{len(parts) - 1} "

    shape = COMPARISON.sub(compared, text)
    words = re.findall(r"#\d+|[&|()]|\w+|\S", shape)
    joined = {"&": "AND", "and": "AND", "|": "OR", "or": "OR", "not": "NOT", "(": "(", ")": ")"}
    if wrong := [w for w in words if not re.fullmatch(r"#\d+", w) and w.lower() not in joined]:
        raise ValueError(f"can't read {' '.join(wrong)!r} in the predicate {text!r}")
    return F.expr(" ".join(parts[int(w[1:])] if w[0] == "#" else joined[w.lower()] for w in words)) if words else F.lit(True)


def search_link(base: str, constraints: Constraints | None, project: str, legacy: bool = False) -> str:
    """A link to the catalogue's page with these constraints. legacy keeps blank items of lists, as empty strings."""
    active = normalized(constraints)
    if legacy:
        active = {}
        for name, given in (constraints or {}).items():
            if not given:
                continue
            values = [v.strip() for v in given if v] if isinstance(given, list) else [str(given).strip()]
            if values and (isinstance(given, list) or values[0]):
                active[name] = values
    if not active:
        return f"{base}project={project}"
    return f"{base}activeFacets={quote(json.dumps(active))}&project={project}"


def link_column(base: str, facets: Column, project: str) -> Column:
    """The same of a map from facet to values, for names and values without characters that JSON escapes."""
    pairs = F.transform(F.map_entries(facets), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": ["'), F.array_join(e["value"], '", "'), F.lit('"]')))
    body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    escaped = F.replace(F.replace(F.replace(F.replace(F.url_encode(body), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(f"{base}activeFacets="), escaped, F.lit(f"&project={project}"))


def relaxed(records: DataFrame, schema: FacetSchema, constraints: Constraints) -> DataFrame:
    """Hits with all constraints and with each left out, in one pass. A policy for searches without hits."""
    names = list(normalized(constraints))
    every = condition(schema, constraints)
    counts = [F.count_if(F.coalesce(every, F.lit(False))).alias("_all")]
    counts += [F.count_if(F.coalesce(condition(schema, {k: v for k, v in constraints.items() if k != n}), F.lit(False))).alias(n) for n in names]
    one = records.agg(*counts)
    return one.select(F.explode(F.array(F.struct(F.lit("").alias("dropped"), F.col("_all").alias("hits")), *(F.struct(F.lit(n).alias("dropped"), F.col(n).alias("hits")) for n in names))).alias("r")).select("r.*")
