import collections

import pytest

from scriptsieve.llm import mixing


def cells(spark):
    rows = [("a", "en", "x", 900), ("a", "de", "x", 100), ("a", "en", "y", 300), ("b", "en", "x", 50), ("b", "de", "y", 70), ("b", "en", "y", 5), ("c", "de", "x", 10), ("c", "en", "y", 20)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_rakes_to_given_margins(spark):
    want = {"source": {"a": 0.4, "b": 0.4, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.5, "y": 0.5}}
    targets = {m: spark.createDataFrame(list(v.items()), "value string, share double") for m, v in want.items()}
    got = mixing.raked(cells(spark), targets, rounds=40).collect()
    total = sum(r.weight for r in got)
    for m, shares in want.items():
        have = collections.Counter()
        for r in got:
            have[r[m]] += r.weight / total
        assert {k: pytest.approx(v, abs=1e-6) for k, v in shares.items()} == dict(have)


def test_query_equals_sql_and_is_calibrated(spark, sf_dir):
    import duckdb

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = sorted(mixing.op4_mixing(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.execute(f"select doc_id, source, lang, topic, n_tokens, probability, sampled from ({mixing.ORACLE})").fetchall())
    assert [tuple(r) for r in got] == want
    kept, hoped, drawn = collections.Counter(), collections.Counter(), sum(r.sampled for r in got)
    for r in got:
        hoped[r.lang] += r.probability * r.n_tokens
        kept[r.lang] += r.sampled * r.n_tokens
    assert 0 < drawn < len(got)
    assert all(abs(kept[k] / sum(kept.values()) - hoped[k] / sum(hoped.values())) < 0.08 for k in hoped)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (3, "one two", None, None), (3, "one two", None, None), (None, "x", "a", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, lang string, tokens int")
    got = sorted(((r.id or 0), r.source, r.tokens, r.probability) for r in mixing.calibrated(df).collect())
    assert [g[:3] for g in got] == [(0, "a", 1), (1, "(none)", 0), (2, "a", 0), (3, "(none)", 2), (3, "(none)", 2)]
    assert got[1][3] == got[2][3] == 1.0 and max(g[3] for g in got if g[2]) == 1.0
    assert mixing.sample(df).columns == df.columns and mixing.sample(df.limit(0)).count() == 0


def test_one_rare_document_takes_nothing_from_the_others(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(50))
    rows = [(i, f"{text} {i}", "ab"[i % 2], "en") for i in range(2000)]
    one = [(9999, " ".join(["rare"] * 25), "new", "en")]
    schema = "doc_id long, text string, source string, lang string"
    kept = collections.Counter(r.doc_id for r in corpus_pipeline.mixed(spark, spark.createDataFrame(rows + one, schema), "").collect())
    tokens = 51 * sum(kept[r[0]] for r in rows), 25 * kept[9999]
    assert tokens[0] > 0.9 * 51 * 2000 and sum(tokens) == pytest.approx(51 * 2000 + 25, rel=0.02)
    share = 25**0.5 / (25**0.5 + 2 * (51 * 1000) ** 0.5)
    assert tokens[1] == pytest.approx(share * (51 * 2000 + 25), abs=25)


def test_sample_of_a_given_size_has_the_shares(spark):
    rows = [(i, "one two three four", "abc"[min(i % 10, 2)], "en") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.sample(df, budget=10_000)
    have = {r.source: 4 * r["count"] for r in got.groupBy("source").count().collect()}
    want = {"a": 500**0.5, "b": 500**0.5, "c": 4000**0.5}
    assert {k: pytest.approx(10_000 * v / sum(want.values()), rel=0.1) for k, v in want.items()} == have and got.columns == df.columns

def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", "en", 1, 2, 3)], "doc_id long, text string, source string, lang string, sampled int, Copies int, copy int")
    assert [tuple(r) for r in mixing.sample(df).collect()] == [(1, "a b", "s", "en", 1, 2, 3)]
