"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.llm.common import materialize

#: Edges that one task may finish in memory (16 bytes each, about 16 MB).
ONE_TASK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) and the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [p for p in parts if len(p)]
    if frames:
        edges = pd.concat(frames)
        node, root = forest(edges["a"].to_numpy(), edges["b"].to_numpy())
        yield pd.DataFrame({"node": node, "root": root})


def connected_components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint).

    ``root`` names the component; it is one of its nodes.  Each round every
    node joins its smallest neighbour and the edges are rewritten between the
    joined nodes, which at least halves the nodes that still have edges.  Once
    the counted edges fit ``one_task_edges``, one task ends the work.  Rounds
    are written to the shared folder.  Self loops, repeated edges and an empty
    table are allowed; nulls are ignored.
    """
    edges = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    moves: list[DataFrame] = []
    while edges.count() > one_task_edges:
        both = edges.union(edges.select("b", "a"))
        move = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "moves"
        )
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = materialize(
            edges.join(left, "a").join(right, "b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .where("a < b").distinct(),
            "edges",
        )
    found = edges.coalesce(1).mapInPandas(_finish, "node bigint, root bigint")
    for move in reversed(moves):
        last = found.select(F.col("node").alias("to"), "root")
        found = materialize(
            move.join(last, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots"
        )
    return found
