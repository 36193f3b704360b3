"""Connected components of a link table, by contraction within tasks and alternating stars, in DataFrame joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize

#: Links that a task holds at once when it contracts its own.
CHUNK = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node, least node reachable, for every node of the links (a[k], b[k]) that isn't the least itself.

    Roots hook to their least neighbouring root and paths are cut until all point to a root: every two rounds each root
    that has a neighbour merges with another, so the rounds grow with the logarithm of the nodes.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        high, low = np.maximum(parent[x], parent[y]), np.minimum(parent[x], parent[y])
        apart = high != low
        if not apart.any():
            break
        high, low, x, y = high[apart], low[apart], x[apart], y[apart]
        order = np.lexsort((low, high))
        first = np.r_[True, np.diff(high[order]) > 0]
        parent[high[order][first]] = low[order][first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def contracted(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, root (root < node): a forest of stars with the same components, from chunks of each task's links. Fewer rows, never more."""
    kind = links.schema["node"].dataType.simpleString()

    def run(batches):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            node, root = roots(*(table.column(c).to_numpy() for c in ("node", "root")))
            for k in range(0, len(node), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 50_000], held[0].schema.field("node").type), pa.array(root[k : k + 50_000], held[0].schema.field("node").type)], ["node", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= chunk:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return links.mapInArrow(run, f"node {kind}, root {kind}")


def star_round(links: DataFrame) -> DataFrame:
    """A large-star and a small-star step (Kiveris et al. 2014) on node, root (root < node); both join the links with a minimum a node."""
    both = links.select(F.col("node").alias("at"), F.col("root").alias("near")).unionAll(links.select("root", "node"))
    least = both.groupBy("at").agg(F.min("near").alias("near")).select(F.col("at").alias("root"), F.least("at", "near").alias("least"))
    large = materialize(links.join(least, "root").select("node", F.col("least").alias("root")).distinct(), "cc-large")
    lowest = large.groupBy("node").agg(F.min("root").alias("low"))
    joined = large.join(lowest, "node")
    small = joined.select("node", F.col("low").alias("root")).unionAll(joined.where("root > low").select(F.col("root").alias("node"), F.col("low").alias("root"))).distinct()
    out = materialize(small, "cc-small")
    discard(large)
    return out


def is_forest_of_stars(links: DataFrame) -> bool:
    """Whether each node has one root and no root has a root."""
    several = links.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    chained = links.select(F.col("root").alias("node")).join(links.select("node"), "node", "left_semi")
    return not several.unionAll(chained).limit(1).count()


def components(links: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """node, component (the least node reachable) for every node of links (columns a and b); a written table.

    Each round contracts what every task holds (chunk: None skips that) and then takes a large and a small star step, which
    need O(log n) rounds whatever the order of the ids. Neighbours are reduced by min, never gathered; each round's table is
    written to the shared folder, so joins see its size and Spark can split a hot node's rows. Ends when all are stars.
    """
    state = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    state = materialize(state.distinct(), "cc-links")
    kind = state.schema["node"].dataType.simpleString()
    while not is_forest_of_stars(state):
        whole = materialize(contracted(state, chunk).distinct(), "cc-contracted") if chunk else state
        if chunk and is_forest_of_stars(whole):
            new = whole
        else:
            new = star_round(whole)
            discard(*([whole] if chunk else []))
        discard(state)
        state = new
    out = materialize(state.unionAll(state.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").cast(kind).alias("component")), "cc-labels")
    discard(state)
    return out
