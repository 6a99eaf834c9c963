"""Connected components as DataFrame rounds on a graph that shrinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm._scratch import Scratch


def relabelled(rows: DataFrame, column: str, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with the node in ``column`` replaced by its component; nodes without a label stay.

    ``labels`` must be a written table: the join then has a shuffle of its own on both sides, so that rows of one huge
    component can be split, or none where the labels are few enough to be broadcast.
    """
    named = scratch.sized(labels.select(F.col("node").alias("_node"), F.col("component").alias("_component")))
    joined = rows.join(named, rows[column] == named["_node"], "left")
    return joined.select(*[F.coalesce("_component", F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def _roots(up: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Follow every node's label to the end by doubling; labels only ever go down, so there is no cycle."""
    step = 0
    while True:
        ahead = scratch.sized(up.select(F.col("node").alias("_node")))
        if not up.join(ahead, up["component"] == ahead["_node"], "left_semi").limit(1).count():
            return up
        step += 1
        up = scratch.write(relabelled(up, "component", up, scratch), f"{name}_{step}")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (a, b); returns a written table (node, component).

    A round lets every node take its smallest neighbour, follows these labels to their ends, and replaces both ends of every
    edge by their labels: edges inside a component vanish, so the next round sees a smaller graph. A hub costs no task of its
    own: the minimum is combined before the shuffle, and labels are joined by broadcast or by a join that can be split. Nodes
    without an edge are not listed. Repeated edges, loops and either direction are fine.
    """

    def oriented(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    graph, rounds = scratch.write(oriented(edges), f"{name}_graph_0"), []
    while graph.limit(1).count():
        k = len(rounds)
        up = scratch.write(graph.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), f"{name}_up_{k}")
        rounds.append(_roots(up, scratch, f"{name}_up_{k}"))
        graph = scratch.write(oriented(relabelled(relabelled(graph, "a", rounds[-1], scratch), "b", rounds[-1], scratch)), f"{name}_graph_{k + 1}")
        scratch.drop(f"{name}_graph_{k}")
    if not rounds:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop()
    while rounds:  # a node that an early round merged goes where later rounds took its label
        k = len(rounds)
        labels = scratch.write(relabelled(rounds.pop(), "component", labels, scratch).unionByName(labels), f"{name}_labels_{k}")
    own = labels.select(F.col("component").alias("node"), "component").distinct()
    return scratch.write(labels.unionByName(own), f"{name}_components")
