"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_shuffle, staged, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label of every node in edges; label: the least node that it is joined with.

    Each round, a node takes the least label among its neighbours', then the label of its label, so a chain shrinks to half
    at least. Every round is written to the shared folder; the driver reads one number a round. Loops and repeated edges do
    no harm; nodes that no edge names are not in the result; no edges give no rows. No table of nodes is broadcast.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = staged(both.union(both.select("v", "u")).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        around = both.join(in_shuffle(labels.withColumnRenamed("node", "v")), "v").groupBy("u").agg(F.min("label").alias("least"))
        new = labels.join(in_shuffle(around), labels["node"] == around["u"]).select("node", "label", F.least("label", "least").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = staged(new.join(in_shuffle(jump), "near").select("node", F.least("near", "far").alias("next"), "label"), "labels")
        changed = new.where("next < label").limit(1).count()
        unstage(labels)
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            unstage(both)
            return labels
