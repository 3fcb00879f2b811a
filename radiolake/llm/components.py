"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.session import persist_table


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Rounds are written to the shared folder.  Each takes the smallest label of the neighbours
    and then the label of that label, so chains shrink by half; hubs are met by aggregates
    with partial sums and by joins that AQE can split.  Null nodes and loops are left out.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = persist_table(one.union(one.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = persist_table(labels.select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(both["a"].alias("node"))
            .agg(F.min("component").alias("near"))
        )
        new = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        step = new.join(up, "low").select(
            "node", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("component")).alias("moved")
        )
        step = persist_table(step, "labels")
        labels = step.select("node", "component")
        if not step.where("moved").head(1):
            return labels


def connected_by_leads(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As ``connected``, for graphs of dense groups: every node first goes to its smallest
    neighbour, and only the distinct edges between those run through the rounds.

    A group in which most nodes know a common one shrinks to a few edges whatever its size.
    """
    one = persist_table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    near = one.union(one.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    leads = persist_table(near.select("node", F.least("node", "low").alias("lead")), "leads")
    of = lambda x: leads.select(F.col("node").alias(x), F.col("lead").alias(f"{x}_lead"))
    between = one.join(of("a"), "a").join(of("b"), "b").where("a_lead <> b_lead").select("a_lead", "b_lead").distinct()
    top = connected(between, "a_lead", "b_lead").select(F.col("node").alias("lead"), "component")
    return leads.join(top, "lead", "left").select("node", F.coalesce("component", "lead").alias("component"))
