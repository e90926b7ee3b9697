import collections
import math
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scriptsieve.llm import ngrams
from scriptsieve.llm.common import shared_folder


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def model(rows, mu2, mu3):
    """A function that scores a text."""
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    pairs, triples, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        for a, b, w in zip(["<s>", "<s>", *t], ["<s>", *t], t):
            pairs[b, w] += 1
            triples[a, b, w] += 1
            contexts[b] += 1
            contexts[a, b] += 1
    n, m = sum(c.values()), sum(c.values()) + len(c) + 1

    def figures(text):
        t = words(text)
        base = sum(math.log10((c[x] + 1) / m) for x in t)
        score = 0.0
        for a, b, w in zip(["<s>", "<s>", *t], ["<s>", *t], t):
            p2 = (pairs[b, w] + mu2 * (c[w] + 1) / m) / (contexts[b] + mu2)
            score += math.log10((triples[a, b, w] + mu3 * p2) / (contexts[a, b] + mu3))
        return len(t), sum(c[x] > 0 for x in t), n, base, score

    return figures


def brute(rows, mu2=ngrams.MU2, mu3=ngrams.MU3):
    figures = model(rows, mu2, mu3)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, *figures(t)) for i, t in rows}


@pytest.mark.parametrize("top,n", [(10, 5), (1 << 62, 3000), (3000, 3000), (1 << 20, 1), (64, 200)])
def test_elias_fano(top, n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n).astype(np.uint64))
    ef = ngrams.EliasFano(values)
    assert np.array_equal(ef.get(np.arange(len(values))).astype(np.uint64), values)
    ask = np.concatenate((values, values + np.uint64(1), rng.integers(0, top, 500).astype(np.uint64), np.array([0, top + 5], np.uint64)))
    at, hit = ef.successor(ask)
    assert np.array_equal(at, np.searchsorted(values, ask)) and np.array_equal(hit, np.isin(ask, values))


def test_elias_fano_of_clusters():
    values = np.concatenate((np.arange(5000), np.array([1 << 40]), np.arange((1 << 41), (1 << 41) + 3000)))
    ef = ngrams.EliasFano(values)
    ask = np.concatenate((values, values + 1, values - 1))[1:]
    ask = ask[ask >= 0]
    at, hit = ef.successor(ask)
    assert np.array_equal(at, np.searchsorted(values, ask)) and np.array_equal(hit, np.isin(ask, values))
    repeated = np.sort(np.random.default_rng(3).integers(0, 300, 2000))
    assert np.array_equal(ngrams.EliasFano(repeated).get(np.arange(2000)), repeated)


def test_hashes_are_by_word():
    a, lengths = ngrams.tokens([b"The cat", b"", b" the\tCAT cat\x0bx "], ngrams.Hasher())
    assert a[0] == a[4] and a[1] == a[5] == a[6] and lengths.tolist() == [3, 1, 5]
    assert a[2] == a[3] == a[8] == ngrams.END_HASH


def same(got, want):
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], rel=1e-9) and got[i][5] == pytest.approx(w[5], abs=8e-4 * w[1])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    return sf_dir, [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# Of all words, none is dealt over several shards; or the most frequent and their pairs are.
@pytest.mark.parametrize("hot,shard", [(ngrams.HOT, ngrams.SHARD), (40, 30_000)])
def test_query_equals_brute_force_and_beats_the_base(spark, documents, monkeypatch, hot, shard):
    monkeypatch.setattr(ngrams, "HOT", hot)
    monkeypatch.setattr(ngrams, "SHARD", shard)
    sf_dir, rows = documents
    got = {r.doc_id: tuple(r)[1:] for r in ngrams.op5_lm_scores(spark, sf_dir).collect()}
    same(got, brute(rows))
    held = [g for g in got.values() if g[0]]
    assert held and sum(g[5] for g in held) > sum(g[4] for g in held)


def test_order_3_beats_order_2_on_held_out_texts(documents):
    _, rows = documents
    held = lambda mu3: sum(g[5] for g in brute(rows, mu3=mu3).values() if g[0])
    assert held(ngrams.MU3) > held(1e12)


def test_a_model_scores_other_texts(spark, documents, tmp_path):
    _, rows = documents
    df = spark.createDataFrame(rows[:600], "doc_id long, text string")
    fitted, own = ngrams.fit(df)
    own.count()
    other = [*rows[600:700], (None, "unheard of WORDS and the"), (5000, None)]
    got = ngrams.score(ngrams.Model.load(fitted.folder), spark.createDataFrame(other, "doc_id long, text string")).collect()
    figures = model(rows[:600], ngrams.MU2, ngrams.MU3)
    assert len(got) == len(other)
    want = {i: figures(t) for i, t in other}
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4], abs=4e-4 * w[0])


def test_a_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    fitted, own = ngrams.fit(empty)
    assert own.collect() == []
    (r,) = ngrams.score(fitted, spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score == pytest.approx(0, abs=1e-2)


def test_long_texts_and_extreme_ids(spark):
    rows = [((1 << 63) - 1, "word " * 300_000), (-(1 << 63), "x" * 500_000), (0, "one two " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ngrams.scores(df).collect()}
    same(got, brute(rows))


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "b"), (2, None), (9, ""), (0, "A\nc")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted(tuple(r) for r in ngrams.scores(df).collect())
    assert len(got) == 6 and [g[2] for g in got if g[0] == 1] == [2, 4, 4]
    assert {g[4] for g in got} == {sum(len(words(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)}
    with_null = df.unionByName(df.limit(1).selectExpr("cast(null as long) as doc_id", "text", "score"))
    assert ngrams.scores(with_null).where("doc_id is null").count() == 1
    assert ngrams.scores(df.limit(0)).count() == 0


def test_scores_alone_keep_no_tries(spark):
    df = spark.createDataFrame([(k, f"a b {k % 3} c a b") for k in range(40)], "doc_id long, text string")
    shards = lambda: {str(p) for p in pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("lm-*/trie-*")}
    before = shards()
    got = sorted(map(tuple, ngrams.scores(df).collect()))
    assert shards() == before
    model, own = ngrams.fit(df)
    assert sorted(map(tuple, own.collect())) == got and shards() > before


def test_frequent_words_come_first_in_files(tmp_path, monkeypatch):
    monkeypatch.setattr(ngrams, "FREQUENT", 2)
    monkeypatch.setattr(ngrams.TaskContext, "get", lambda: type("", (), {"partitionId": lambda self: 0})())
    texts = [b"x y y z", b"y u", b""]
    (row,) = ngrams._write_batches(str(tmp_path), True)([pa.RecordBatch.from_pydict({"id": [1, 2, None], "data": texts})])
    h, lengths = ngrams.tokens(texts, ngrams.Hasher())
    *_, found, words, place = ngrams._texts(str(tmp_path), row.column(0)[0].as_py())
    assert (words[place] == h).all() and (found == lengths).all() and (np.diff(words) > 0).all()
    code = ngrams._batch(str(tmp_path), row.column(0)[0].as_py())[5]
    assert np.bincount(code)[:2].sum() == 6  # of 9 tokens: y and the end
