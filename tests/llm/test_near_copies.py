import random
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from scriptsieve.llm import near_copies

from .test_simhash import brute_components


def brute_set(text, words=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_groups(texts):
    sets, holders, shared = {i: brute_set(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s or [()]:
            shared.update((j, i) for j in holders[x])
            holders[x].append(i)
    near = [(i, j) for (i, j), n in shared.items() if not sets[i] or 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    return brute_components(texts, near)


def test_stage_equals_brute_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    want = brute_groups({r.doc_id: r.text for r in docs.collect()})
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(want.values()) and out.columns == docs.columns


def test_chains_and_pairs_at_the_limit(spark):
    rng = random.Random(3)
    texts = {}
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 60, 200]))]
        for m in range(6):
            texts[10 * k + m] = " ".join(words)
            for _ in range(rng.choice([1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_groups(texts)
    assert {r.doc: r.component for r in near_copies.groups(df).collect()} == want
    assert 40 < len(set(want.values())) < len(texts)


def test_parts_are_joined_as_brute_force_does():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(45, 61), replace=False)) for _ in range(60)]
    both = [(i, j) for i in range(60) for j in range(i) if 5 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    assert all(near_copies.near(sets[i], sets[j]) == ((i, j) in set(both)) for i in range(60) for j in range(i))
    found = list(near_copies.joined_parts(list(range(60)), sets))
    assert brute_components(range(60), found) == brute_components(range(60), both) and 0 < len(found) < 60


def test_nulls_repeats_and_empty(spark):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, a.upper()), (None, a), (None, "alone"), (3, None), (4, ""), (5, "b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc or 0, r.component or 0) for r in near_copies.groups(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    assert sorted(r.doc_id or 0 for r in near_copies.one_of_each(df).collect()) == [0, 0, 1, 1, 3, 5]
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_finished_steps_leave_no_shuffle_files(spark):
    """A group of near copies takes many steps; what one has dealt out is gone when it ends, not when the driver's garbage is collected."""
    rng, base = random.Random(8), [f"w{i}" for i in range(60)]
    texts = []
    for k in range(200):
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append((k, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    found = near_copies.groups(df)
    left = {f.split("_")[1] for f in files() - before}
    assert len(left) <= 2, f"files of {len(left)} shuffles"
    assert {r.doc: r.component for r in found.collect()} == brute_groups(dict(texts))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8)], "doc_id long, text string, First int")
    assert [tuple(r) for r in near_copies.one_of_each(df).collect()] == [(1, "a b c d e f", 7)]
