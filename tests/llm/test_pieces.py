import random
import time

import pytest
import sentencepiece

from scriptsieve.llm import pieces, vocabularies

FILE = vocabularies.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "   a   b", "\n\n\tx", "don't (x)=y;", "é😀漢字 ñandú", "▁x ▁ y", "1234567 89", "a" * 300, "the" * 80, "\x00\x01", "​ z", "x́", "\xa0 a", "=" * 40, "if (a == b) { return c->d[0]; }", "ПриветМир", "a_b_c __init__"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def ours():
    return pieces.PieceModel(FILE)


def texts(n=1500):
    rng = random.Random(7)
    letters = "etaoinshrdlu  ..,'-_éñß漢😀\n\t0123ABCтест(){}=;"
    return [*ODD, *("".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(n))]


def test_ids_and_decoding_equal_the_library(library, ours):
    for t in texts():
        ids = library.encode(t)
        assert ours.encode(t) == ids, t
        assert ours.decode(ids) == library.decode(ids)


def test_window_commits_early_and_equals_plain_merges(ours):
    rng = random.Random(9)
    runs = 0
    for _ in range(60):
        t = "".join(rng.choices("etaoinshrdlucmfwyp", k=400))
        found = list(ours.walk(t))
        runs += len(found)
        assert [p for run in found for p in run] == ours._merge_all(t)
    assert runs > 200


def test_unigram_window_equals_the_whole_lattice(ours):
    best = pieces.UnigramModel({p: ours.scores[i] for p, i in ours.ids.items()})
    rng = random.Random(11)
    for _ in range(30):
        t = "".join(rng.choices("etaoinshrdlu", k=150))
        top = [0.0]
        for end in range(1, len(t) + 1):
            top.append(max(top[s] + best.pieces[t[s:end]] for s in range(max(0, end - best.longest), end) if t[s:end] in best.pieces))
        runs = list(best.walk(t))
        assert len(runs) > 1 and "".join(p for run in runs for p in run) == t
        assert sum(best.pieces[p] for run in runs for p in run) == top[-1]


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "Hello  wörld", 3), (3, "Hello  wörld", 3), (None, "x", 4)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), r.n_tokens, r.decoded, r.round_trip) for r in pieces.encode_texts(df).collect())
    assert got[0][2:] == ("x", True) and got[1] == (1, 0, "", True) and got[2] == (2, 0, "", True)
    assert got[3] == got[4] and got[3][2:] == ("Hello  wörld", True)
    assert pieces.encode_digests(df.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, sf_dir, library):
    import zlib

    import numpy as np

    got = {r.doc_id: r for r in pieces.op1_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = library.encode(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[d.doc_id].round_trip


@pytest.mark.parametrize("text", [" " * 1_000_000, " " + "QmFzZTY0IGVuY29k" * 62_500, "  " + "x9Zq" * 50_000, "a" * 200_000, "漢字" * 100_000])
def test_very_long_texts_take_time_in_proportion(text):
    model, library = pieces.model(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    began = time.process_time()
    ids = model.encode(text)
    assert time.process_time() - began < 30 and ids == library.encode(text)
    assert all(len(k) <= 64 for k in model.memo)


def test_runs_of_spaces_equal_the_library():
    model, library = pieces.model(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(11)
    parts = [*"aAz09.,<!ßéK\n\t\r{}文ñ▁", *(" " * k for k in (1, 2, 3, 5, 8, 14, 15, 17, 33)), "the", "\r\n"]
    texts = [" " * k + w + " " * (k % 5) for k in range(70) for w in ("", "a", "the", "é", "文x", "{", "\r\n", "▁")]
    texts += ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    assert [model.encode(t) for t in texts] == library.encode(texts)
