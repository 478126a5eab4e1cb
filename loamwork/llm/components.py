"""Connected components by label propagation with pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, label (its component's smallest node) for the nodes of edges (a, b: longs).

    Each round takes the smallest label among a node, its neighbours and the node its label names, so labels cross
    a component in about as many rounds as its diameter has binary digits.  Each round is a written table of one
    row per node; nothing is gathered.  Nodes without edges aren't in the result; an empty table gives none.
    """
    both = ws.save(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    number = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        one = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        two = one.join(jump, F.col("to") == F.col("at")).select("node", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") != F.col("label")).alias("moved"))
        labels, still = _round(two, ws, name, number := number + 1)
        if still:
            ws.drop(f"{name}-edges")
            return labels


def roots(parents: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, label (the last of its chain of parents) for parents (node, label: longs), one smaller parent a node.

    Each round goes twice as far up, by one join.  Nodes without a parent aren't in the result.
    """
    labels, number = parents.select("node", "label"), 0
    while True:
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        one = labels.join(up, F.col("label") == F.col("at"), "left")
        labels, still = _round(one.select("node", F.coalesce("beyond", "label").alias("label"), F.col("beyond").isNotNull().alias("moved")), ws, name, number := number + 1)
        if still:
            return labels


def extended(labels: DataFrame, edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """labels (node, label) of components, their nodes without a row standing for themselves, after edges (a, b) too.

    Only the labels that the edges join are gone through, one node for each component found before.  The result has a
    row for each node or label of labels and each end of an edge between components.
    """
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        ends = ends.join(of, F.col(end) == F.col("at"), "left").withColumn(end, F.coalesce("to", end)).drop("at", "to")
    more = components(ends, ws, name)
    own = labels.select(F.col("label").alias("node")).union(more.select("node")).distinct().select("node", F.col("node").alias("label"))
    found = more.select(F.col("node").alias("at"), F.col("label").alias("to"))
    whole = labels.where("node <> label").union(own).join(found, F.col("label") == F.col("at"), "left")
    return ws.save(whole.select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")


def _round(after: DataFrame, ws: Workspace, name: str, number: int) -> tuple[DataFrame, bool]:
    """Writes a round (node, label, moved), drops the one before; its labels, and whether no label moved."""
    after = ws.save(after, f"{name}-{number}")
    if number > 1:
        ws.drop(f"{name}-{number - 1}")
    return after.select("node", "label"), after.where("moved").isEmpty()
