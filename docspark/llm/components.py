"""Connected components by alternating large and small stars, each step a join and a grouping, until the edges fit in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, dealt_join

#: As many edges at most, by count, are joined up in one task (16 bytes each, some 100 with what is made of them).
SOLVED = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids on edges u - v, and the least id reachable from each: roots hook to smaller ones until no edge joins two."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return ids, ids[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, further := root[root]):
            root = further


def _solve_batches(batches):
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        ids, comps = least_reachable(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comps)], ["id", "comp"])


def _solved(edges: DataFrame) -> DataFrame:
    """Of SOLVED edges at most."""
    return edges.select("u", "v").coalesce(1).mapInArrow(_solve_batches, "id long, comp long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return dealt_join(both.where("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges run from the larger end u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = dealt_join(edges, least, "u", "n", n)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges(u, v), both non-null and different -> (id, comp): for every id on an edge, the least id reachable.

    Edges may repeat and run either way; they are read twice. Without edges the result is empty. Each step is written to the shared folder.
    """
    if edges.count() <= SOLVED:
        return scratch.keep(_solved(edges), f"{name}-solved")
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state, step = _state(now), 0
    while state[0]:
        if state[0] <= SOLVED:
            return scratch.keep(_solved(now), f"{name}-solved")
        step += 1
        large = scratch.keep(_large_star(now, state[0]), f"{name}-{step}-large")
        scratch.drop(f"{name}-{step - 1}")
        now = scratch.keep(_small_star(large, state[0]), f"{name}-{step}")
        scratch.drop(f"{name}-{step}-large")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
