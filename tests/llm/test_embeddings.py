import numpy as np
import pytest

from scriptsieve.llm import embeddings


def brute(rows, threshold=0.95):
    ok = {k: np.array(v, float) for k, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k, _ in rows}
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        out[k] = (len(links[k]), min(seen))
    return out


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[: n // 2] + rng.normal(size=(n // 2, dim)) * rng.choice([0.05, 0.25, 0.3, 0.33], size=(n // 2, 1))
    return np.concatenate((base, near, base[:9]))


def test_bound_never_drops_a_link():
    x = embeddings.unit(vectors(400, 24, 3))
    a = (x, *embeddings.quantised(x))
    cosine = x @ x.T
    for t in (0.9, 0.95, 0.99):
        assert not (cosine[~embeddings.candidates(a[1:], a[1:], t)] >= t).any()
        i, j = embeddings.linked(a, a, t, True)
        assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p, q in np.argwhere(cosine >= t).tolist() if p < q}


@pytest.mark.parametrize("tile", [2048, 60])
def test_rows_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(120))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] * 16), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.id or 0, r.n_links, r.component or 0) for r in embeddings.near_duplicates(df).collect())
    assert got[1:] == [(5, 1, 5), (5, 1, 5), (9, 0, 9)] and got[0][0] == 0
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.op3_embedding_near_dedup(spark, sf_dir).collect()}
    assert got == want
