"""Connected components of links held in a DataFrame.

Each task first joins the links that it has and passes on a star for each tree, so nothing is dealt out for that. Up to ALONE links
that are left are joined by one task. More go through rounds of alternating large and small stars until they are few enough or settle: each
round joins the links with the least neighbour of each node, which is an aggregate with map-side partials, so that a
node with very many links is neither collected nor held in one task. Rounds are cut by reliable checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffles_removed

MAX_ROUNDS = 60
#: Links that a task joins at once (8 MB of them); the same at all sizes of the input.
ALONE = 1 << 19


def _state(links: DataFrame) -> tuple:
    with shuffles_removed(links.sparkSession):
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (arrays of two rows) and the least node that each reaches."""
    names, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1), return_inverse=True)
    forest = Forest(len(names))
    forest.union(*at.reshape(2, -1))
    return names, names[forest.label]


def _by_task(links: DataFrame) -> DataFrame:
    """Links (u, v: the least node of the tree) that join what the links of each task join."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= ALONE:
                yield stars(held)
                held, n = [], 0
        yield stars(held)

    def stars(held):
        names, least = _joined(held)
        return pa.RecordBatch.from_pydict({"u": names[names != least], "v": least[names != least]}, schema=schema)

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _by_one_task(links: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches):
        names, least = _joined([np.stack([c.to_numpy() for c in batch.columns]) for batch in batches])
        yield pa.RecordBatch.from_pydict({"node": names, "component": least}, schema=schema)

    return links.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, component (the smallest node reachable) for every node with a link to another; self-links, repeats and nulls are ignored."""
    at = cut(_by_task(links.where("u <> v")))
    state = _state(at)
    for _ in range(MAX_ROUNDS):
        if state[0] <= ALONE:
            return _by_one_task(at)
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(at)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Sets of the indices 0..n-1 under unions given as arrays; the label of a set is its smallest index."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def star(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from each index to the smallest name in its set, as names, without self-links."""
        least = names.copy()
        np.minimum.at(least, self.label, names)
        centre = least[self.label]
        out = centre != names
        return names[out], centre[out]
