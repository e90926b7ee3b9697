"""Embedding near-duplicates: exact cosine links, clusters and link counts over all vectors.

Method: vectors are scaled to length one and quantised to int8 in tiles. The product of two tiles of integers gives the
cosines of the quantised vectors; with the exact length of each vector's quantisation error, |x.y - x'.y'| <= |x - x'| +
|x'| |y - y'| <= e_x + (1 + e_x) e_y, so only pairs whose quantised cosine plus this bound reaches the threshold are computed
again in double precision.

Equal vectors are one row of a tile with a count. A pair of tiles yields link counts by vector and a spanning forest of its
links, never the pairs; components are joined by stars. Tiles are dealt over blocks, and each pair of blocks is one row of work
that compares all their pairs of tiles, so a tile moves once for each block and not for each tile. The work is all pairs of tiles, which an exact
search in this many dimensions can't undercut; no pair is left out. Vectors move in the precision they came in; codes and errors are made where
they are compared, and one routine decides all pairs that are computed again.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of different
lengths. Rows with a null id are returned with no links and a null component and are not compared. Repeated ids with equal
vectors count as other vectors; an empty table gives no rows; vectors may be of any length, which sets a tile's memory; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table
from .components import Forest, components

#: Vectors of a tile, tiles of a block at most.
TILE, BLOCK = 2048, 16
#: Covers the rounding of single-precision sums and products.
SLACK = 1e-5


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error lengths of unit vectors (rows, double)."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(vectors - codes * scale[:, None], axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def candidates(a, b, threshold: float) -> np.ndarray:
    """The mask of pairs that can reach the threshold, from (codes, scales, errors) of two tiles."""
    exact = np.float32 if a[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (a[0].astype(exact) @ b[0].astype(exact).T).astype(np.float32, copy=False)
    near *= a[1].astype(np.float32)[:, None]
    near *= b[1].astype(np.float32)[None, :]
    near += a[2].astype(np.float32)[:, None]
    most = float(a[2].max())
    return near >= (threshold - SLACK - b[2] * (1 + most)).astype(np.float32)[None, :]


def linked(a, b, threshold: float, own: bool):
    """Row indices (i, j) of pairs with cosine >= threshold. a, b: (unit vectors, codes, scales, errors); own: both are the same tile, and i < j."""
    mask = candidates(a[1:], b[1:], threshold)
    if own:
        mask = np.triu(mask, 1)
    i, j = np.nonzero(mask)
    if not len(i):
        return i, j
    cosine = np.concatenate([np.einsum("ij,ij->i", a[0][i[k : k + 32768]], b[0][j[k : k + 32768]]) for k in range(0, len(i), 32768)])
    keep = cosine >= threshold
    return i[keep], j[keep]


_TILE = pa.schema([("tile", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())])
_TILE_DDL = "tile long, dim long, ids binary, counts binary, vectors binary"


def _pack(kind: str):
    """Rows (tile, dim, rep, n, v) in order of tile and dim to rows of _TILE, as they end; kind: the vectors' number type."""

    def run(batches):
        held: list = []

        def packed(rows):
            tile, dim = rows[0][:2]
            out = (tile, dim, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], kind))
            return pa.RecordBatch.from_pydict({f.name: [x if isinstance(x, int) else x.tobytes()] for f, x in zip(_TILE, out)}, schema=_TILE)

        for batch in batches:
            for _, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[:2]):
                rows = list(rows)
                if held and held[0][:2] != rows[0][:2]:
                    yield packed(held)
                    held = []
                held += rows
        if held:
            yield packed(held)

    return run


def _compared(kind: str, threshold: float):
    """Rows (low, high, block, tile, dim, ids, counts, vectors) in order of the pair of blocks: counts of links and spanning forests of each pair of their tiles."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def arrays(tile, dim, ids, counts, vectors):
        v = unit(np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64))
        return tile, dim, np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64), (v, *quantised(v))

    def pair(x, y):
        same = x is y
        (_, _, ids, n, a), (_, _, ids_b, n_b, b) = x, y
        i, j = linked(a, b, threshold, same)
        names = ids if same else np.concatenate((ids, ids_b))
        shift = 0 if same else len(ids)
        count = np.bincount(i, n_b[j], len(names)) + np.bincount(j + shift, n[i], len(names))
        forest = Forest(len(names))
        forest.union(i, j + shift)
        u, v = forest.star(names)
        some = count > 0
        return pa.RecordBatch.from_pydict({"u": np.concatenate((names[some], u)), "v": np.concatenate((names[some], v)), "n": np.concatenate((count[some].astype(np.int64), np.zeros(len(u), np.int64)))}, schema=schema)

    def met(key, tiles):
        own = key[0] == key[1]
        left = [t for block, t in tiles if block == key[0]]
        right = left if own else [t for block, t in tiles if block == key[1]]
        for p, x in enumerate(left):
            for y in right[p:] if own else right:
                if x[1] == y[1]:
                    yield pair(x, y)

    def run(batches):
        key, tiles = None, []
        for batch in batches:
            for low, high, block, *tile in zip(*(c.to_pylist() for c in batch.columns)):
                if (low, high) != key:
                    if tiles:
                        yield from met(key, tiles)
                    key, tiles = (low, high), []
                tiles.append((block, arrays(*tile)))
        if tiles:
            yield from met(key, tiles)

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """id, n_links, component for each row of df; see above."""
    spark = df.sparkSession
    small_batches(spark)
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fine = F.expr("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    usable = own.where(fine)
    kind = "<f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    distinct = cut(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    tiles = max(1, math.ceil(distinct.count() / TILE))
    blocks = max(math.ceil(tiles / BLOCK), min(tiles, math.isqrt(2 * partitions(spark)) + 1))
    vector = F.col("v") if kind == "<f4" else F.col("v").cast("array<double>")
    dealt = distinct.select(F.pmod(F.xxhash64("rep"), F.lit(tiles)).alias("tile"), F.size("v").cast("long").alias("dim"), "rep", "n", vector.alias("v"))
    packed = cut(dealt.repartition(min(tiles, 4 * partitions(spark)), "tile").sortWithinPartitions("tile", "dim").mapInArrow(_pack(kind), _TILE_DDL))
    block, other = F.pmod("tile", F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = packed.withColumn("block", block).withColumn("other", other)
    work = sent.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tile", "dim", "ids", "counts", "vectors")
    pairs = blocks * (blocks + 1) // 2
    spread = work.repartition(min(pairs, 1 << 17), "low", "high").sortWithinPartitions("low", "high", "block", "tile")
    found = cut(spread.mapInArrow(_compared(kind, threshold), "u long, v long, n long"))
    counts = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("others"))
    joined = components(found.where("n = 0").select("u", "v"))
    named = distinct.join(counts, distinct.rep == counts.u, "left").join(joined, distinct.rep == joined.node, "left")
    named = named.select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    alone = own.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return usable.join(named, "v").select("id", F.col("n_links").cast("long").alias("n_links"), "component").unionByName(alone)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


#: Every pair, in one SQL statement; the oracle of the query.
ORACLE = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as u, b.vec_id as w from v a join v b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), r(u, w) as (
  select u, w from l union select r.u, l.w from r join l on r.w = l.u
), c as (select u, min(w) as m from r group by u), n as (select u, count(*) as k from l group by u)
select t.vec_id, coalesce(n.k, 0)::bigint as n_links, least(t.vec_id, coalesce(c.m, t.vec_id)) as component_id,
  t.vec_id <= coalesce(c.m, t.vec_id) as kept
from embeddings t left join n on n.u = t.vec_id left join c on c.u = t.vec_id
"""
