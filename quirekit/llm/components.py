"""Connected components of a graph of any size, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b); label is the least node of the component.

    Each round takes the least label among a node and its neighbours, then the label of that label;
    both are pre-aggregated or joined on stored tables, so a node with many edges is no single task's
    work. The rounds grow with the logarithm of a component's diameter in practice; each one is a
    written table. Nothing but the number of changes reaches the driver.
    """
    both = store(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = store(labels, "labels")
    while True:
        of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))  # noqa: E731, B023
        near = both.join(of("other"), "other").groupBy("node").agg(F.min("other_label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("via"))
        jumped = stepped.join(of("via"), "via", "left").select("node", "before", F.coalesce("via_label", "via").alias("label"))
        jumped = store(jumped, "labels")
        if jumped.where(F.col("before") != F.col("label")).limit(1).count() == 0:
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
