import random

import numpy as np
import pytest
import xxhash

from scriptsieve.llm import simhash
from scriptsieve.llm.components import Forest, components


def brute_fingerprint(text, words=4):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in ("", " \t", "One", "a B c d", "a b c d e", "Ünï É x\x0by z \xa0 w", "the cat sat on the mat " * 40):
        assert simhash.fingerprint(t.encode(), 4) == brute_fingerprint(t)


def test_gray_rank(spark):
    values = [0, 1, 2, 3, (1 << 63), (1 << 64) - 1, 0x123456789ABCDEF0]
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    got = [r[0] for r in df.select(simhash.gray_rank(df.fp)).collect()]
    want = simhash.gray_ranks(np.array(values, np.uint64))
    assert [(g + (1 << 63)) % (1 << 64) for g in got] == want.tolist()
    assert all((r ^ (r >> 1)) == v for r, v in zip(want.tolist(), values))


@pytest.mark.parametrize("n,m", [(1, 1), (3, 70), (700, 90), (600, None), (2, None), (1, None), (4096, 9)])
def test_index_finds_every_pair(n, m):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)

    def some(k):
        out = base[rng.integers(0, 40, k)].copy()
        for _ in range(5):
            out ^= np.where(rng.random(k) < 0.6, np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64), np.uint64(0)).astype(np.uint64)
        out = np.unique(out)
        return out[np.argsort(simhash.gray_ranks(out))]

    a, b = some(n), None if m is None else some(m)
    got = {(int(x), int(y)) for i, j in simhash.linked(a, b, 4) for x, y in zip(i, j)}
    near = np.bitwise_count(a[:, None] ^ (a if b is None else b)[None, :]) <= 4
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(near)) if b is not None or x < y}
    assert got == want


def test_forest_and_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1500)] + [(k, k + 1) for k in range(2000, 2060)]
    nodes = sorted({x for p in pairs for x in p})
    want = brute_components(nodes, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(n == want[n] for n in nodes if n not in got)
    forest, place = Forest(len(nodes)), {n: i for i, n in enumerate(nodes)}
    forest.union(np.array([place[a] for a, _ in pairs]), np.array([place[b] for _, b in pairs]))
    u, v = forest.star(np.array(nodes))
    assert {int(a): int(b) for a, b in zip(u, v)} == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("alone", [5, 40, 1 << 19])
def test_components_of_more_links_than_a_task_joins(spark, monkeypatch, alone):
    monkeypatch.setattr("scriptsieve.llm.components.ALONE", alone)
    rng = random.Random(alone)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(9000, k) for k in range(8000, 8300)] + [(k, k + 1) for k in range(-60, -2)]
    want = brute_components({x for p in pairs for x in p}, pairs)
    df = spark.createDataFrame([*pairs, *pairs[:50], (None, 3), (3, None), (77777, 77777)], "u long, v long").repartition(7)
    got = [tuple(r) for r in components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}


def test_query_equals_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    fps = {d.doc_id: simhash.fingerprint((d.text or "").encode(), 4) for d in docs}
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4, 1))
    want = brute_components(ids, [(ids[a], ids[b]) for a, b in near])
    assert len(set(want.values())) < len(ids)
    assert {i: (f"{fps[i]:016x}", want[i]) for i in ids} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}


def test_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "LEAF_MOST", 32)
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    fps = np.unique(np.concatenate((fps, fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), fps[:1] ^ np.arange(200).astype(np.uint64))))
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(int(f), i) for f, i in zip(fps.view(np.int64), ids)], "fp long, rep long")
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = brute_components(ids, [(int(a), int(b)) for a, b in near])
    got = {r.node: r.component for r in components(simhash.links(df, len(ids), 4)).collect()}
    named = fps.view(np.int64).tolist()
    for a in (0, 5, 40, 450):
        assert [got.get(x, x) == got.get(named[a], named[a]) for x in named] == [want[i] == want[a] for i in ids]


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 1), (4, "a b c d e f", 1), (7, None, 2), (8, "", 2), (9, "other words entirely here", 3), (None, "only here and nowhere else", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = sorted(((r.doc or -1), r.component) for r in simhash.groups(df, words=4).collect() if r.component is not None)
    assert got == [(-1, 4), (4, 4), (4, 4), (7, 7), (8, 7), (9, 9)]
    kept = simhash.one_of_each(df, words=4)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 4, 4, 7, 9]
    assert simhash.groups(df.limit(0)).count() == 0

def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8)], "doc_id long, text string, FIRST int")
    assert [tuple(r) for r in simhash.one_of_each(df).collect()] == [(1, "a b c d e f", 7)]
