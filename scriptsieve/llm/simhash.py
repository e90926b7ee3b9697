"""SimHash near-duplicates of whole texts.

Fingerprints: texts lower-cased in A-Z, words between ASCII white space, shingles of words joined by a space; XXH64 with
seed 42 of each shingle, repeats included; a bit is set if over half the hashes have it.

Method: a Gray-order hierarchical index. Distinct fingerprints are range-partitioned and sorted by Gray rank and packed
into leaves; a leaf's fingerprints share their first bits. The bits that all fingerprints of a node agree on form its masked
pattern; a child's pattern adds to that of its parent. Two nodes are compared on the bits that both patterns hold and that
their parents did not; the differences accumulate from the top, and the whole pair of groups is dropped once they
exceed the limit. Leaves are sent to the pairs of first bits that differ in up to `bits` of them, and meet there once.

A pair of leaves yields a spanning forest of its links, never all pairs; components are joined by stars. Exact copies share
a fingerprint and are one row of the index. Null and empty texts have fingerprint zero, which links like any other. Rows with
a null id are fingerprinted and get the component of their fingerprint if a row with an id has it or links to it, else null;
they never name a component. Other columns are not read by the query and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, cut, forget, partitions, small_batches, spread, table, unused
from .components import Forest, components

SEED = 42
#: Fingerprints that a leaf holds on average and at most.
LEAF, LEAF_MOST = 8192, 16384
FAN = 8
#: Node pairs that are compared at once.
AT_ONCE = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: max(1, len(found) - words + 1)].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """doc (long), fp (long, the unsigned fingerprint's bits) for each row."""

    small_batches(df.sparkSession)

    def run(rows: dict[str, list]) -> dict[str, list]:
        forget()
        fps = np.array([fingerprint(t or b"", words) for t in rows["text"]], np.uint64).view(np.int64)
        return {"doc": rows["doc"], "fp": fps}

    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64())])
    return spread(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))).mapInArrow(by_batch(run, schema), "doc long, fp long")


def gray_rank(fp: F.Column) -> F.Column:
    """The place of a fingerprint in Gray order, as a signed long that sorts as the unsigned rank does."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(shift))
    return fps


def nodes(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level over fingerprints in Gray order; level 0 has the fingerprints themselves."""
    levels = [(np.full(len(fps), ALL), fps)]
    both, either = fps, fps
    while len(both) > FAN:
        at = np.arange(0, len(both), FAN)
        both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
        levels.append((~(both ^ either), both))
    return levels


def linked(a: np.ndarray, b: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most `bits` bits; within a if b is None, each pair once."""
    own = b is None
    left = nodes(a)
    right = left if own else nodes(b)
    while len(left) < len(right):
        left.append(_whole(left[-1]))
    while len(right) < len(left):
        right.append(_whole(right[-1]))
    if own:
        right = left
    top = len(left) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left[top][0])), np.arange(len(right[top][0])), indexing="ij"))
    none = np.zeros(len(i), np.uint64)
    yield from _compare(left, right, top, i, j, none, np.zeros(len(i), np.uint8), bits, own)


def _whole(level: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One node above all nodes of a level."""
    mask, pattern = level
    both, either = np.bitwise_and.reduce(pattern & mask), np.bitwise_or.reduce(pattern | ~mask)
    return np.array([~(both ^ either)]), np.array([both])


def _compare(left, right, level, i, j, seen, differ, bits, own):
    """Keeps the pairs (i, j) of nodes whose accumulated differences are within `bits`, and goes on with their children."""
    if own:
        keep = i < j if level == 0 else i <= j
        i, j, seen, differ = i[keep], j[keep], seen[keep], differ[keep]
    (mask_a, pattern_a), (mask_b, pattern_b) = left[level], right[level]
    shared = mask_a[i] & mask_b[j]
    differ = differ + np.bitwise_count((pattern_a[i] ^ pattern_b[j]) & shared & ~seen)
    keep = differ <= bits
    i, j = i[keep], j[keep]
    if level == 0:
        if len(i):
            yield i, j
        return
    shared, differ = shared[keep], differ[keep]
    n, m = len(left[level - 1][0]), len(right[level - 1][0])
    fan_a, fan_b = (FAN if len(x[level][0]) > 1 or len(x[level - 1][0]) > 1 else 1 for x in (left, right))
    step = max(1, AT_ONCE // (fan_a * fan_b))
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        x = (i[s, None, None] * fan_a + np.arange(fan_a)[None, :, None]) + np.zeros((1, 1, fan_b), np.int64)
        y = (j[s, None, None] * fan_b + np.arange(fan_b)[None, None, :]) + np.zeros((1, fan_a, 1), np.int64)
        size = fan_a * fan_b
        x, y, inside = x.ravel(), y.ravel(), None
        inside = (x < n) & (y < m)
        yield from _compare(left, right, level - 1, x[inside], y[inside], np.repeat(shared[s], size)[inside], np.repeat(differ[s], size)[inside], bits, own)


def leaves(distinct: DataFrame, depth: int) -> DataFrame:
    """Packs the column fp in Gray order into leaves: prefix (the first `depth` bits), fps."""
    schema = pa.schema([("prefix", pa.int64()), ("fps", pa.binary())])

    def run(batches):
        fps = np.zeros(0, np.int64)

        def packed(last: bool):
            nonlocal fps
            prefix = (fps.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(fps), np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))).tolist() if len(fps) else []
            found, done = [], 0
            for s, e in zip(cuts, [*cuts[1:], len(fps)]):
                if e == len(fps) and not last and e - s < LEAF_MOST:
                    break
                found += [(int(prefix[at]), fps[at : min(at + LEAF_MOST, e)].tobytes()) for at in range(s, e, LEAF_MOST)]
                done = e
            fps = fps[done:]
            return pa.RecordBatch.from_pydict({"prefix": [p for p, _ in found], "fps": [f for _, f in found]}, schema=schema)

        for batch in batches:
            fps = np.concatenate((fps, batch.column(0).to_numpy()))
            if len(fps) >= 4 * LEAF_MOST:
                yield packed(False)
        yield packed(True)

    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(partitions(distinct.sparkSession), "rank").sortWithinPartitions("rank")
    return ranked.select("fp").mapInArrow(run, "prefix long, fps binary")


def links(distinct: DataFrame, n: int, bits: int) -> DataFrame:
    """A spanning forest (u, v: fingerprints) of the links among n rows with different fingerprints in column fp."""
    depth = max(0, min(32, round(math.log2(max(n, 1) / LEAF))))
    packed = cut(leaves(distinct, depth))
    flips = F.explode(F.array(*[F.lit(m).cast("long") for k in range(bits + 1) for m in _masks(depth, k)]))
    sent = packed.select("prefix", "fps", flips.alias("flip")).withColumn("other", F.col("prefix").bitwiseXOR(F.col("flip")))
    sent = sent.select(F.least("prefix", "other").alias("low"), F.greatest("prefix", "other").alias("high"), (F.col("prefix") > F.col("other")).alias("second"), "fps")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def found(firsts, seconds):
        own = not seconds
        names = np.concatenate(firsts + seconds)
        starts = np.cumsum([0, *map(len, firsts + seconds)]).tolist()
        forest = Forest(len(names))
        for p in range(len(firsts)):
            for q in range(p, len(firsts)) if own else range(len(firsts), len(firsts) + len(seconds)):
                a, b = firsts[p], None if p == q else (firsts + seconds)[q]
                for i, j in linked(a.view(np.uint64), None if b is None else b.view(np.uint64), bits):
                    forest.union(i + starts[p], j + starts[q])
        u, v = forest.star(names)
        return pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=schema)

    def run(batches):
        at, sides = None, ([], [])
        for batch in batches:
            for low, high, second, fps in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (low, high):
                    if at is not None and (at[0] == at[1] or sides[1]) and sides[0]:
                        yield found(*sides)
                    at, sides = (low, high), ([], [])
                sides[second].append(np.frombuffer(fps, np.int64))
        if at is not None and (at[0] == at[1] or sides[1]) and sides[0]:
            yield found(*sides)

    spread = sent.repartition(4 * partitions(distinct.sparkSession), "low", "high").sortWithinPartitions("low", "high", "second")
    return spread.mapInArrow(run, "u long, v long")


def _masks(depth: int, k: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in bits) for bits in combinations(range(depth), k)]


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 4) -> DataFrame:
    """doc, fp, component for each row of df: near-duplicates by fingerprints that differ in at most `bits` bits, linked transitively."""
    own = cut(fingerprints(df, id_col, text_col, words))
    distinct = cut(own.groupBy("fp").agg(F.min("doc").alias("rep")).where("rep is not null"))
    found = components(links(distinct, distinct.count(), bits))
    tree = cut(distinct.join(found, distinct.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    least = cut(tree.groupBy("root").agg(F.min("rep").alias("component")))  # cut, so that the join is one whose large groups Spark can split
    named = cut(tree.join(least, "root").select("fp", "component"))
    return own.join(named, "fp", "left").select("doc", "fp", "component")


def first_rows(df: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """The rows of df whose id is the least of its group (found: doc, component), and those with a null id."""
    name = unused(df, "first")
    lasting = found.where("doc = component").select(F.col("doc").alias(name)).distinct()
    return df.join(lasting, df[id_col] == lasting[name], "left").where(F.col(name).isNotNull() | df[id_col].isNull()).drop(name)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 4) -> DataFrame:
    """The rows of df that are first of their group by id, and rows with a null id; columns as given. Of rows that repeat an id all stay or none."""
    return first_rows(df, id_col, groups(df, id_col, text_col, words, bits))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
