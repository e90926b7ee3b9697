import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from scriptsieve.llm import suffixes


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w not in first or i < first[w]:
                first[w] = i
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        text = parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared) + parts[2]
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            at = rng.randrange(max(1, len(text)))
            text = text[:at] + rng.choice(["", "X", "YY"]) + text[at + rng.randint(0, 2) :]
        rows.append((i * 3 % (2 * n + 1), text))
    return rows


SPECIAL = [(500, ""), (501, None), (502, "a" * 400), (503, "b" + "a" * 49), (504, "b" + "a" * 50), (505, "ab" * 100), (506, "x" + "ab" * 26), (507, "y" * 49), (508, "y" * 50), (509, "z" + "y" * 50), (510, "a" * 300)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_equal_brute_force(spark, seed):
    rows = made(seed) + SPECIAL
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digests(df).collect()}
    assert got == brute(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.op8_suffix_dedup(spark, sf_dir).collect()}
    want = brute(rows)
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    at, _ = suffixes.anchors(data)
    for s in range(0, 2950, 7):
        inside = {int(a) - s for a in at if s <= a <= s + suffixes.REACH}
        other = np.concatenate((rng.integers(97, 100, 80).astype(np.uint8), data[s : s + 50], rng.integers(97, 100, 80).astype(np.uint8)))
        least = suffixes.token_hashes(data[s : s + 50])
        k = int(np.argmin(least))
        assert k in inside and k + 80 in suffixes.anchors(other)[0]
    assert len(at) < 0.1 * len(data)


def test_multikey_sort():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, run = suffixes.multikey_sort(words)
    want = sorted(map(tuple, words.tolist()))
    assert [tuple(r) for r in words[order].tolist()] == want
    assert run.tolist() == [sorted(set(want)).index(w) for w in want]


def test_pack():
    parts = [np.arange(5, dtype=np.uint64), np.array([-1, 7], np.int32), np.zeros((0, 84), np.uint8), np.arange(168, dtype=np.uint8).reshape(2, 84)]
    assert all(np.array_equal(a, b) for a, b in zip(parts, suffixes.unpack(suffixes.pack(*parts))))


def test_nulls_repeats_and_empty(spark):
    long = "some words that are long enough to be a string of fifty bytes at least"
    df = spark.createDataFrame([(4, long), (4, long), (None, long), (None, "alone " + long[::-1])], "doc_id long, text string")
    got = sorted(((r.doc_id or 99), r.n_removed) for r in suffixes.digests(df).collect())
    assert got == [(4, 0), (4, 0), (99, 0), (99, len(long))]
    assert suffixes.digests(df.limit(0)).count() == 0


def test_rows_without_repeats(spark):
    long = "some words that are long enough to be a string of fifty bytes at least"
    df = spark.createDataFrame([(4, long, "a", 1), (5, "mine: " + long, "b", 2), (6, long, "c", 3), (7, " ", "d", 4), (8, None, None, None)], "doc_id long, text string, batch string, c0 int")
    left = {r.doc_id: (r.text, r.batch, r.c0) for r in suffixes.without_repeats(df).collect()}
    assert left == {4: (long, "a", 1), 5: ("mine: ", "b", 2), 7: (" ", "d", 4), 8: (None, None, None)}


def test_other_columns_come_back_as_they_were(spark):
    sql = """select id as doc_id, 'text ' || id as text, timestamp'1850-01-02 03:04:05.123456' + make_interval(0, 0, 0, id) as at, timestamp_ntz'2024-01-01 00:00:00.000001' as ntz, cast(id as decimal(38, 10)) / 3 as price,
      case id when 1 then double('nan') when 2 then double('infinity') else 0.1D end as x, unhex('00ff') as raw, map('a', array(id, null)) as m, named_struct('p', date'0001-01-01', 'q', null) as s, cast(id as byte) as tiny from range(5)"""
    df = spark.sql(sql)
    out = suffixes.without_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))


def test_extreme_ids(spark):
    long = "some words that are long enough to be a string of fifty bytes at least"
    df = spark.createDataFrame([((1 << 63) - 1, long), (-(1 << 63), long), (None, long)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.digests(df).collect()}
    assert got == {(1 << 63) - 1: len(long), -(1 << 63): 0, None: len(long)}


@pytest.mark.parametrize("seed", [4, 5])
def test_frequent_tokens_equal_brute_force(spark, monkeypatch, seed):
    """All tokens that a few documents share are frequent, so that windows travel by their hashes, and batches are small."""
    monkeypatch.setattr(suffixes, "FREQUENT", (4, 4))
    rows = made(seed, 90) + SPECIAL
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.digests(df).collect()} == brute(rows)


def test_long_texts(spark):
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefgh ", k=400_000))
    rows = [(2, text), (1, text[100_000:300_000]), (3, "x" * 300_000), (4, "x" * 200_000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: (400_000, 200_000, 1), 1: (200_000, 0, 0), 3: (300_000, 0, 0), 4: (200_000, 200_000, 1)}


@pytest.mark.parametrize("buckets", [1, 7, 112, 3000])
def test_buckets_of_tokens_are_even(buckets):
    _, h = suffixes.anchors(np.random.default_rng(buckets).integers(32, 127, 2_000_000, dtype=np.uint8))
    splitters = suffixes._token_splitters(buckets)
    sizes = np.bincount(np.searchsorted(splitters, h >> np.uint64(16), "right"), minlength=buckets)
    assert len(sizes) == buckets and sizes.max() < 1.2 * len(h) / buckets + 60


def frequent_batch(folder, texts):
    """The spans that step 3 keeps of a batch whose tokens are all frequent, the windows that it asks, and the most memory of the step beside the texts'."""
    name = "docs-000000-000000"
    draft = suffixes.files.Draft(str(folder), name)
    rest = suffixes.pa.table({"c0": range(len(texts))})
    sink = suffixes.pa.BufferOutputStream()
    with suffixes.pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_table(rest)
    draft.write(suffixes.pack(np.arange(len(texts)), np.array(list(map(len, texts))), np.frombuffer(b"".join(texts), np.uint8), np.frombuffer(sink.getvalue(), np.uint8)))
    draft.commit()
    n = len(np.unique(suffixes._batch_tokens(texts)[1]))
    answer = suffixes.pack(np.packbits(np.ones(n, bool)), np.packbits(np.ones(n, bool)), np.array([n]))
    rows = suffixes.pa.RecordBatch.from_pydict({"batch": [name], "bucket": [0], "data": [answer]})
    tracemalloc.start()
    asked = sum(len(suffixes.unpack(data)[2]) for batch in suffixes._suffix_rows(str(folder), np.zeros(0, np.uint64), 4)([rows]) for data in batch.column(3).to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    with suffixes.files.read(f"{folder}/{name}-spans") as f:
        return suffixes.unpack(f.read()), asked, most


def test_a_batch_of_frequent_tokens_takes_bounded_memory(tmp_path):
    text = np.random.default_rng(1).integers(97, 123, 10_000, np.uint8).tobytes()
    texts = [text] * 400
    (doc, start, end), asked, most = frequent_batch(tmp_path, texts)
    assert len(doc) <= 10 * len(texts) and asked == len(text) - 49
    for k in range(len(texts)):
        kept = suffixes.kept_bytes(text, start[doc == k], end[doc == k])[0] if (doc == k).any() else text
        assert kept == (b"" if k else text)
    assert most < 40 * sum(map(len, texts))


def test_different_windows_of_frequent_tokens_are_asked_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "MEET", 5000, raising=False)
    texts = [np.random.default_rng(k).integers(97, 123, 4000, np.uint8).tobytes() for k in (1, 2, 3, 2)]
    (doc, start, end), asked, _ = frequent_batch(tmp_path, texts)
    found = {k: suffixes.kept_bytes(texts[k], start[doc == k], end[doc == k])[0] for k in set(doc.tolist())}
    assert asked >= 3 * 3951 and set(found) <= {3}  # what a part could not tell, its bucket does


@pytest.mark.parametrize("seed", range(5))
def test_joined_spans_are_the_same_bytes_and_runs(seed):
    rng = np.random.default_rng(seed)
    doc, start = rng.integers(0, 6, 200).astype(np.int32), rng.integers(0, 900, 200).astype(np.int32)
    end = start + rng.integers(1, 20, 200).astype(np.int32)
    text = rng.integers(0, 256, 1000, np.uint8).tobytes()
    d, s, e = suffixes.joined(doc, start, end)
    for k in range(6):
        assert suffixes.kept_bytes(text, s[d == k], e[d == k]) == suffixes.kept_bytes(text, start[doc == k], end[doc == k])
        assert (d == k).sum() == suffixes.kept_bytes(text, start[doc == k], end[doc == k])[1]
    assert [len(x) for x in suffixes.joined(doc[:0], start[:0], end[:0])] == [0, 0, 0]
