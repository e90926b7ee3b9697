import sentencepiece

import corpus_pipeline
from scriptsieve.llm import mixing, quality, vocabularies

from .test_near_copies import brute_groups
from .test_suffixes import brute as brute_suffixes


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        got = at[name] = {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            assert set(got) == {r.doc_id for r in quality.judge(docs).where("kept").collect()} and 0 < len(got) < len(before)
        elif name == "simhash_near_dedup":
            want = brute_groups({i: r.text for i, r in before.items()})
            assert set(got) == set(want.values())
        elif name == "suffix_array_dedup":
            want = brute_suffixes([(i, r.text) for i, r in before.items()])
            assert all(len(got[i].text.encode()) <= want[i][0] - want[i][1] for i in got) and all(want[i][1] for i in set(before) - set(got))
            assert all(got[i].text == before[i].text for i in got if not want[i][1])
        elif name == "mixing":
            odds = {r.id: r for r in mixing.calibrated(docs).collect()}
            assert set(got) == {i for i, r in odds.items() if r.sampled} and all(got[i] == before[i] for i in got)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
            assert all(got[i].ids == library.encode(before[i].text) and got[i].round_trip for i in before)
        if name != "sentencepiece":
            assert out.columns == columns
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(at["sentencepiece"])


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, repeats, a very long text, and columns whose names the operators use go through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = docs.limit(1).selectExpr("cast(77777 as bigint) as doc_id", "repeat(concat(text, ' '), 400) as text", "lang", "source", "n_chars")
    nothing = docs.limit(1).selectExpr(*(f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in docs.schema))
    more = docs.unionByName(docs.limit(5)).unionByName(long).unionByName(nothing)
    more = more.selectExpr("*", "doc_id as sampled", "source as batch", "timestamp'2024-01-01 00:00:00.000001' as first", "lang as c0")
    more.write.parquet(f"{tmp_path}/documents.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, stage, sf_dir)
        assert out.columns == more.columns and out.schema.simpleString() == more.schema.simpleString()
        rows = out.collect()
        assert rows and all(r["first"].microsecond == 1 for r in rows)
        stage = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
