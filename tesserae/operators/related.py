"""Facet values that go with an entity: personalised PageRank over the graph of entities and the values they have.

An edge joins an entity with a value that it has more often than chance would have it: its weight is the lift, the number of
records with both times all records by the product of their own numbers; edges of a lift of 1 or less are none. A walk starts
at an entity, goes to one of its values, from there to an entity, and so on, by the edges' weights, and at each step from a
value returns to where it started with a fixed chance. So a value scores that an entity's neighbours have, though its own
records may not have it yet.

Edges come of the profile's counts, not of pairs of values within records, are written once, and do not grow with the records.
A round is two joins with them; what travels is a score for each start and value that its walk has reached. The rounds are
bounded: after r of them, what is left out weighs (1 - RESTART) ** r at most.

Defined cases: a null entity is none; an entity without an edge has no suggestions; ties go by facet and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.staging import staged

#: The chance to return to the start; rounds; suggestions; decimals of a score, so that sums' order doesn't count.
RESTART, ROUNDS, MOST, DECIMALS = 0.2, 4, 5, 9


def edges(profile: DataFrame) -> DataFrame:
    """entity, facet, value, lift of the pairs that go together. profile: entity, facet, value, n."""
    known = profile.where("entity IS NOT NULL")
    of_entity = known.groupBy("entity", "facet").agg(F.sum("n").alias("n_entity"))
    of_value = known.groupBy("facet", "value").agg(F.sum("n").alias("n_value"))
    of_facet = known.groupBy("facet").agg(F.sum("n").alias("n_all"))
    met = known.join(of_entity, ["entity", "facet"]).join(of_value, ["facet", "value"]).join(of_facet, "facet")
    lift = F.col("n") * F.col("n_all") / (F.col("n_entity") * F.col("n_value"))
    return met.select("entity", "facet", "value", lift.alias("lift")).where("lift > 1")


def suggestions(profile: DataFrame, rounds: int = ROUNDS, most: int = MOST) -> DataFrame:
    """entity, facet, value, score, rank: the values that score most for each entity."""
    graph = staged(edges(profile), "edges")
    out_of_entity = graph.groupBy("entity").agg(F.sum("lift").alias("whole"))
    out_of_value = graph.groupBy("facet", "value").agg(F.sum("lift").alias("whole"))
    steps = graph.join(out_of_entity, "entity").select("entity", "facet", "value", (F.col("lift") / F.col("whole")).alias("down"))
    steps = staged(steps.join(graph.join(out_of_value, ["facet", "value"]).select("entity", "facet", "value", (F.col("lift") / F.col("whole")).alias("up")), ["entity", "facet", "value"]), "steps")
    at = steps.select(F.col("entity").alias("start"), "entity").distinct().withColumn("p", F.lit(1.0))
    total = None
    for r in range(rounds):
        reached = at.join(steps, "entity").groupBy("start", "facet", "value").agg(F.sum(F.col("p") * F.col("down")).alias("p"))
        reached = staged(reached, f"reached-{r}")
        total = reached if total is None else total.unionByName(reached)
        if r + 1 < rounds:
            at = reached.join(steps, ["facet", "value"]).groupBy("start", "entity").agg(((1 - RESTART) * F.sum(F.col("p") * F.col("up"))).alias("p"))
    # A walk that returned to its start goes the same ways again, so the scores of all such returns are a common factor.
    scores = total.groupBy("start", "facet", "value").agg(F.round(RESTART * F.sum("p"), DECIMALS).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy(F.desc("score"), "facet", "value")).cast("long"))
    return ranked.where(F.col("rank") <= most).select(F.col("start").alias("entity"), "facet", "value", "score", "rank")
