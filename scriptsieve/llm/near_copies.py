"""Near copies of whole texts: groups linked by the Jaccard similarity of their word shingles.

Shingles are those of `simhash`, as sets. Two texts are linked if the sets' Jaccard similarity is NEAR or more; groups are the
connected components of these links. A SimHash radius is no bound on this similarity: at one wide enough for nearly all such pairs (14 to
16 of 64 bits) the Gray-order index has nothing to skip and its work is quadratic. So SimHash finds the groups that it can, and every
pair, of those groups and of the rest, is checked on whole sets.

1. The operator `simhash` gives groups of fingerprints that differ in few bits. Each text is checked against the first of its group.
2. Min-hashes give candidates for the rest. A text has BANDS keys of ROWS min-hashes; a pair at the limit shares no key with probability
   (1 - 0.8^5)^40, about 1e-7, and closer pairs less. Of each key every text is a candidate with the least text that has it, so a key that very
   many texts hold makes one link each. One candidate of each text is checked at a time, and those that links have put in one part aren't
   checked at all; after AHEAD rounds all that are left are checked.
3. Where the links that held leave a group of candidates in more than one part, the parts are compared with each other: pairs that share one of
   their rarest shingles (which a pair at the limit can't avoid) are checked until no two parts are linked.

Equal sets are one row. Null and empty texts have no shingles and are near to each other only. Rows with a null id get the
group of their set if a row with an id has it, else null; they never name a group. Other columns are kept by `one_of_each`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, cut, forget, partitions, small_batches, spread
from .components import components
from .simhash import SEED, first_rows
from .simhash import groups as fingerprint_groups

#: The least similarity of a link, as a fraction.
NEAR = (4, 5)
BANDS, ROWS = 40, 5
#: Rounds in which one candidate of each set is checked, before all that are left.
AHEAD = 2
_FACTORS = np.random.default_rng(9).integers(1, 1 << 62, (BANDS * ROWS, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(10).integers(1, 1 << 62, (1, ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = text.lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1) if found else 0
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def set_key(hashes: np.ndarray) -> int:
    """A signed number for a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _FACTORS).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    least = (least ^ least >> np.uint64(29)) * _MIX
    mixed = (least ^ least >> np.uint64(32)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mixed.view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of NEAR or more."""
    top, bottom = NEAR
    if bottom * min(len(a), len(b)) < top * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return bottom * shared >= top * (len(a) + len(b) - shared)


def joined_parts(parts: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Index pairs of near sets that join the given parts, each only where it joins two."""
    at = {p: p for p in parts}

    def find(x):
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    top, bottom = NEAR
    holders, start = defaultdict(list), 0
    for i, s in enumerate(sets):
        own = place[start : start + len(s)]
        start += len(s)
        rare = own[np.lexsort((own, count[own]))][: len(s) - -(-top * len(s) // bottom) + 1].tolist()
        seen = set()
        for x in rare:
            for j in holders[x]:
                if j not in seen and find(parts[i]) != find(parts[j]):
                    seen.add(j)
                    if near(s, sets[j]):
                        at[find(parts[i])] = find(parts[j])
                        yield i, j
            holders[x].append(i)


def _sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc, fp (key of the set of shingles), keys for each row."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        forget()
        found = [shingles(t or b"", words) for t in rows["text"]]
        return {"doc": rows["doc"], "fp": [set_key(s) for s in found], "keys": [band_keys(s) for s in found]}

    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
    return spread(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))).mapInArrow(by_batch(run, schema), "doc long, fp long, keys array<long>")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """fp, hashes of each wanted (doc, fp)."""
    schema = pa.schema([("fp", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for batch in batches:
            found = [(fp, s) for fp, t in zip(*(c.to_pylist() for c in batch.columns)) if set_key(s := shingles(t or b"", words)) == fp]
            yield pa.RecordBatch.from_pydict({"fp": [fp for fp, _ in found], "hashes": [s.tobytes() for _, s in found]}, schema=schema)

    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(wanted, "doc").select("fp", "text").mapInArrow(run, "fp long, hashes binary").dropDuplicates(["fp"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are near."""

    def run(batches):
        for batch in batches:
            u, v, a, b = batch.columns
            keep = [near(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    first, second = sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _between(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join the parts of each group of candidates; parts: node, candidate, part."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(group):
        nodes, names, sets = zip(*group)
        found = list(joined_parts(list(names), [np.frombuffer(s, np.uint64) for s in sets]))
        return pa.RecordBatch.from_pydict({"u": [nodes[i] for i, _ in found], "v": [nodes[j] for _, j in found]}, schema=schema)

    def run(batches):
        at, group = None, []
        for batch in batches:
            for candidate, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if candidate != at and group:
                    yield links(group)
                    group = []
                at = candidate
                group.append(row)
        if group:
            yield links(group)

    spread = parts.groupBy("candidate").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("candidate")
    rows = parts.join(spread, "candidate").join(sets, parts.node == sets.fp).select("candidate", "node", "part", "hashes")
    return rows.repartition(4 * partitions(parts.sparkSession), "candidate").sortWithinPartitions("candidate").mapInArrow(run, "u long, v long")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (u, v) that aren't in one part; parts: node, component."""
    name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    placed = pairs.join(name("u"), "u", "left").join(name("v"), "v", "left")
    return placed.where(F.coalesce("part_u", "u") != F.coalesce("part_v", "v")).select("u", "v")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 4) -> DataFrame:
    """doc, component for each row of df: texts linked transitively by a Jaccard similarity of NEAR or more."""
    small_batches(df.sparkSession)
    own = cut(_sketches(df, id_col, text_col, words))
    named = own.where("doc is not null")
    sets_of = cut(named.groupBy("fp").agg(F.min("doc").alias("doc"), F.first("keys").alias("keys")))  # a row a set
    close = fingerprint_groups(df, id_col, text_col, words, bits).select("doc", F.col("component").alias("first")).where("doc is not null")
    # Of each set the first document's group, and that group's first document's set.
    first = sets_of.join(close, "doc").select(F.col("fp").alias("u"), "first").distinct()
    stars = cut(first.join(named.select(F.col("doc").alias("first"), F.col("fp").alias("v")), "first").where("u <> v").select("u", "v").distinct())
    keyed = sets_of.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("key", "v")
    pairs = cut(keyed.join(shared, "key").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct())
    candidates = cut(components(pairs.unionByName(stars)))
    wanted = sets_of.join(candidates.select(F.col("node").alias("fp")), "fp").select("fp", "doc")
    sets = cut(_sets(df, wanted, id_col, text_col, words))
    held = cut(_checked(stars, sets))
    for _ in range(AHEAD):  # a candidate of each set at a time, as most of the others are then in one part
        pairs = cut(_apart(pairs, cut(components(held))))
        now = cut(pairs.groupBy("u").agg(F.min("v").alias("v")))
        held = held.unionByName(cut(_checked(now, sets)))
        pairs = pairs.join(now, ["u", "v"], "left_anti")
    held = held.unionByName(cut(_checked(_apart(pairs, cut(components(held))), sets)))
    parts = candidates.select("node", F.col("component").alias("candidate")).join(components(held).withColumnRenamed("component", "part"), "node", "left")
    parts = cut(parts.withColumn("part", F.coalesce("part", "node")))
    found = components(held.unionByName(_between(parts, sets)))
    # A set's group is named by the least document of its sets, a row each, so that copies meet before they are dealt by group.
    tree = cut(sets_of.select("fp", "doc").join(found, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("component", "fp").alias("root")))
    least = cut(tree.groupBy("root").agg(F.min("doc").alias("component")))  # cut, so that the join below is one whose large groups Spark can split
    return own.select("doc", "fp").join(tree.join(least, "root").select("fp", "component"), "fp", "left").select("doc", "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of df that are first of their group by id, and rows with a null id; columns as given. Of rows that repeat an id all stay or none."""
    return first_rows(df, id_col, groups(df, id_col, text_col, words))
