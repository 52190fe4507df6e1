"""Text of models and chats: cleaning, JSON that hides in prose, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.predicates import strip

#: Phrases taken out of a query, in this order (fixed values).
PHRASES = ("user want ", "user wants ", "user need ", "user needs ")
PARTS = ("variable_query", "source_query", "experiment_query")


def clean_query(text: Column, phrases: tuple[str, ...] = PHRASES) -> Column:
    out = F.lower(text)
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(""))
    return strip(out)


def without_fences(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def outermost_braces(text: Column) -> Column:
    """From the first { to the last }, null if there is no such stretch."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last >= first), F.substring(text, first, last - first + 1))


def last_fenced(text: Column) -> Column:
    """What stands in the last block that is fenced as JSON."""
    return F.when(text.contains("```json"), F.substring_index(F.element_at(F.split(text, "```json"), -1), "```", 1))


def split_parts(response: Column, query: Column, parts: tuple[str, ...] = PARTS) -> Column:
    """A struct of the parts that a response names; of JSON as it is, or in the last fenced block, else the query for each."""
    def one(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        values = [F.get_json_object(text, f"$.{p}") for p in parts]
        there = parsed.isNotNull() & F.startswith(strip(text), F.lit("{"))
        return F.when(there, F.struct(*(F.coalesce(v, F.lit("")).alias(p) for v, p in zip(values, parts))))

    fallback = F.struct(*(query.alias(p) for p in parts))
    found = F.coalesce(one(response), one(last_fenced(response)), fallback)
    return F.struct(*(clean_query(found[p]).alias(p) for p in parts))


def has_both(text: Column, a: str, b: str) -> Column:
    return F.get_json_object(text, f"$.{a}").isNotNull() & F.get_json_object(text, f"$.{b}").isNotNull()


def shown(response: Column) -> Column:
    """What is displayed of a response: the summary of one that holds it beside its full result, else all of it."""
    return F.when(has_both(response, "summary", "full_result"), F.get_json_object(response, "$.summary")).otherwise(response)


def joined(chunks: DataFrame, key: str, order: str, text: Column, name: str) -> DataFrame:
    """The chunks of each key as one text, in order; a null one adds nothing."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias(name))


def history(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation as one text, a line for a turn; whoever isn't the user is the assistant."""
    who = F.when(F.col(role) == "user", "User").otherwise("Assistant")
    return joined(turns, key, turn, F.concat(who, F.lit(": "), F.coalesce(text, F.lit("")), F.lit("\n")), "history")
