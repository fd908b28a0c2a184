"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Edges that a task contracts at once.
BATCH = 1 << 20


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that isn't broadcast: tables of nodes grow with the input, and one that is small as a
    shuffle's bytes is several times that in the driver, which keeps those of all rounds."""
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """df with a cut lineage: in the checkpoint folder if the session has one, else kept. Not for rounds: a checkpoint
    hands on the size that its plan was taken to have, a product for joins, whose digits double each round."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def roots(parents: DataFrame, store: Callable[[DataFrame], DataFrame] = stored, rounds: int = 60) -> DataFrame:
    """node, root: the end of each chain of node, parent; parents are smaller, so chains end.
    Pointers jump over each other, which halves the chains a round."""
    labels = store(parents.select("node", F.col("parent").alias("root")))
    for _ in range(rounds):
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = store(labels.join(shuffled(above), "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        labels = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"pointers did not settle in {rounds} rounds")


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = stored, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of edges (a, b) can reach.

    Each round every node hooks onto its smallest smaller neighbour, the trees are contracted to
    their roots, and only edges between different roots go on. An edge is thus joined once a
    round in which its ends are still apart, stars, cliques and sorted chains end after one or two
    rounds, and only aggregates that combine on the map side meet a hub.
    """
    rest = store(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    out: DataFrame | None = None
    for _ in range(rounds):
        top = roots(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), store, rounds)
        if out is None:
            out = nodes.join(shuffled(top), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        else:
            onward = top.select(F.col("node").alias("root"), F.col("root").alias("far"))
            out = out.join(shuffled(onward), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        out = store(out)
        # The larger end of each edge has a root; the smaller one may be a root itself.
        low, high = (top.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b"))
        met = rest.join(shuffled(high), "b").join(shuffled(low), "a", "left").select(F.coalesce("a_root", "a").alias("x"), F.col("b_root").alias("y")).where(F.col("x") != F.col("y"))
        rest = store(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not rest.limit(1).count():
            return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ends of edges, and the smallest that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), np.split(at, 2)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((above := root[root]) != root).any():
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _contracting(batch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in _contracted(*ends)], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for part in batches:
            parts.append(part)
            if (n := n + part.num_rows) >= batch:
                yield stars(parts)
                parts, n = [], 0
        if n:
            yield stars(parts)

    return run


def parted_components(edges: DataFrame, batch: int = BATCH) -> DataFrame:
    """As components, for edges (a, b, part) of which few components have edges of several parts.

    Parts are dealt over tasks, and a task contracts a batch of its edges at a time, whatever their number. Only nodes
    that two or more parts or batches share link their roots, and only these links take rounds of joins.
    """
    dealt = edges.repartition("part").sortWithinPartitions("part").select(F.col("a").cast("long"), F.col("b").cast("long"))
    stars = stored(dealt.mapInArrow(_contracting(batch), "node long, root long"))
    ends = stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("last"))
    shared = ends.where(F.col("root") != F.col("last")).select("node", F.col("root").alias("a"))
    links = stars.join(shuffled(shared), "node").where(F.col("root") != F.col("a")).select("a", F.col("root").alias("b"))
    onward = components(links).select(F.col("node").alias("root"), F.col("root").alias("far"))
    return ends.join(shuffled(onward), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
