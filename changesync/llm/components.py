"""Connected components of a link table, by contraction, on Spark alone.

Each round every vertex hooks to its smallest neighbour, the hooks are followed to their roots,
and the links are drawn again between roots. The number of vertices with links at least halves,
so a few rounds end it, whatever the diameter. Nothing is gathered per vertex or on the driver;
aggregations combine before they shuffle, joins have a unique right side.

A large group has many links more than members, most of them needless: before the rounds, each task
keeps a spanning forest of its share of the links, a bounded number of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from changesync.storage import Scratch


def _roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of a forest (node, parent) in which roots have no row of their own."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = scratch.keep(
            parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")),
            "jump",
        )
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


TASK_LINKS = 1 << 18  # links of a task at most
TASKS = 8  # at least


def spanning_forest(links: DataFrame) -> DataFrame:
    """Some of `links` (a, b) that join the same nodes: of each task's share as many as it has nodes at most."""

    def run(batches):
        shares = [np.stack([b.column(c).to_numpy() for c in "ab"]) for b in batches]
        if not shares:
            return
        share = np.concatenate(shares, axis=1)
        up = list(range(len(nodes := np.unique(share))))
        kept = []
        for i, (a, b) in enumerate(zip(*np.searchsorted(nodes, share).tolist())):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(share[0, kept]), pa.array(share[1, kept])], ["a", "b"])

    return links.repartition(max(TASKS, -(-links.count() // TASK_LINKS))).mapInArrow(run, "a LONG, b LONG")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of `links` (a, b), root the smallest node of its component.

    Nodes are longs; links may repeat, in either direction, and may be loops.
    """
    proper = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.keep(spanning_forest(proper).distinct(), "edges")
    label = None
    while not edges.isEmpty():
        # The larger end hooks to its smallest neighbour: no cycles, since parents are smaller.
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = _roots(scratch.keep(hooks, "hooks"), scratch)
        if label is None:
            label = roots
        else:
            again = roots.select(F.col("node").alias("root"), F.col("root").alias("_new"))
            old = label.join(again, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
            label = old.unionByName(roots.join(label.select("node"), "node", "left_anti"))
        label = scratch.keep(label, "labels")
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        drawn = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")
        )
        edges = scratch.keep(drawn.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).filter("false")
    heads = label.select(F.col("root").alias("node"), "root").distinct()
    return label.unionByName(heads.join(label.select("node"), "node", "left_anti")).distinct()
