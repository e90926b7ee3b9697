import random

import pytest
from tokenizers import Tokenizer

from scriptsieve.llm import token_counts, vocabularies

FILE = vocabularies.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n\n a", "a  b", "don't we'll I'm", " <|endoftext|> x", "x<|endoftext|><|endoftext|>", "a\x1cb \x1f ! \x85 x", "\xa0 a  b　", "é😀漢字 ñandú", "12345 6,7", "a" * 5000, "ab " * 50, "\t\n !!! ##", "x́ y", "​ z", " \n \n", "…—“q”", "tail  \n", "\x00\x01", "ABCdef" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_counts_equal_the_library(library):
    count = token_counts.counter(FILE).count
    rng = random.Random(3)
    letters = "abcdeéñ漢😀 \n\t\xa0 '.,!#0129ABs t\x1c\x85　<|>"
    texts = [*ODD, *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500))]
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_proof_holds_for_the_library(library):
    proven = sorted(token_counts.prove(FILE).strings)[::37]
    assert proven and all(len(e.ids) == 1 for e in library.encode_batch(proven, add_special_tokens=False))


def test_a_proof_of_another_file_is_refused():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(FILE, token_counts.Proof("0", frozenset()))


@pytest.mark.parametrize("text", ["a" * 300_000, "ab cd " * 100_000, " " * 300_000, "QmFzZTY0" * 40_000])
def test_very_long_texts(library, text):
    counter = token_counts.counter(FILE)
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert all(len(k) <= 64 for memo in (counter.chunks, counter.pre_tokens) for k in memo)


def test_latin_1_pre_tokens_equal_the_general_ones():
    rng = random.Random(9)
    for _ in range(20_000):
        text = "".join(chr(rng.randrange(256)) if rng.random() < 0.5 else rng.choice(" \n\t'slltreaB1²ª") for _ in range(rng.randrange(1, 9)))
        assert token_counts.pre_tokens(text) == token_counts.PRE_TOKENS.findall(text)


def test_long_merge_equals_short():
    bpe = token_counts.ByteBpe(FILE)
    rng = random.Random(5)
    for _ in range(50):
        s = list(token_counts.mapped("".join(rng.choices("theanringo é", k=47))))
        assert bpe.merged(s) == bpe._merged_long(s)


def test_frame_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "hello world", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect())
    assert got == [(0, 11, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_query_over_the_whole_table(spark, sf_dir, library):
    from scriptsieve.llm.token_counts import op2_token_counts

    got = {r.doc_id: r for r in op2_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, e in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), len(e.ids), len(e.ids) > 512)
