"""Connected components by repeated contraction, with every round written to the shared folder.

Each round lets every node point at its smallest neighbour, follows the pointers
to their ends by squaring, and replaces the edges by edges between the ends. Each component loses a node with every round at least; where
identifiers are hashes, as in this package, a node is the smallest around it with a probability of one over its neighbours and itself, and the nodes
that still have edges fall by a constant factor on average, so rounds are few. No step gathers a
node's neighbours, and hubs meet only in partial aggregates and splittable joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import drop, save


def _ends(pointers: DataFrame) -> DataFrame:
    """Follow (node, parent) pointers to their roots; each step doubles the distance."""
    while True:
        up = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        new = save(
            pointers.join(up, "parent", "left").select(
                "node", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved")
            ),
            "pointers",
        )
        moved = new.filter("moved").limit(1).count()
        drop(pointers)
        pointers = new
        if not moved:
            return pointers.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, component): the smallest node reachable. Nodes without an edge are absent.

    Null ends and self-loops are dropped; repeated edges count once. An empty table gives an empty result.
    """
    edges = save(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    labels = None
    while edges.limit(1).count():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointers = save(
            both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent"))
            .select("node", F.least("node", "parent").alias("parent")),
            "pointers",
        )
        ends = _ends(pointers)
        if labels is None:
            labels = save(ends.select("node", F.col("parent").alias("component")), "labels")
        else:
            old = labels
            step = ends.select(F.col("node").alias("component"), "parent")
            labels = save(
                old.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")),
                "labels",
            )
            drop(old)
        a = ends.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = ends.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        done = edges
        edges = save(
            done.join(a, "u").join(b, "v").filter("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
            "edges",
        )
        drop(done)
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
