import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from scriptsieve.llm import idcoder, token_files, vocabularies

FILE = vocabularies.path("word_bpe_49k.json")


@pytest.fixture
def short_blocks(monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 4096)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 4095, 4096, 4097, 20_000, (1 << 20) + 5])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_407).astype(np.uint32)
    ids[n // 2 :] = ids[: n - n // 2]
    blocks = idcoder.encode(ids, 16)
    assert np.array_equal(idcoder.decode(blocks, 16), ids)
    if n == 20_000:
        assert sum(len(b[2]) for b in blocks) < 2 * n * 0.65


def test_extremes_and_repeats():
    for ids in (np.zeros(9000), np.arange(9000), np.tile([1, 2, 3, 65535], 3000), np.random.default_rng(1).integers(0, 1 << 16, 5000)):
        ids = ids.astype(np.uint32)
        blocks = idcoder.encode(ids, 16)
        assert np.array_equal(idcoder.decode(blocks, 16), ids)
    assert sum(len(b[2]) for b in idcoder.encode(np.tile([1, 2, 3], 4000), 16)) < 2500


@pytest.mark.parametrize("bits", [1, 15, 16, 17, 20, 21, 25])
def test_ids_of_all_widths(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 90_000)
    ids[:2] = 0, (1 << bits) - 1
    assert np.array_equal(idcoder.decode(idcoder.encode(ids, bits), bits), ids)


def test_more_kinds_than_order_0_holds():
    ids = np.concatenate((np.arange(70_000), np.random.default_rng(6).integers(0, 70_000, 70_000)))
    assert np.array_equal(idcoder.decode(idcoder.encode(ids, 17), 17), ids)


def test_order_0_predicts_ids():
    """Independent ids come close to their entropy, and to no fewer bits."""
    rng = np.random.default_rng(7)
    share = rng.dirichlet(np.full(300, 0.3))
    ids = rng.choice(49_000, 300, replace=False)[rng.choice(300, 1_000_000, p=share)]
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert entropy * 0.99 < 8 * sum(len(b[2]) for b in idcoder.encode(ids, 16)) / len(ids) < entropy * 1.06


def test_orders_1_and_2_predict_ids():
    rng = np.random.default_rng(8)
    after = rng.permutation(50)
    ids = np.empty(300_000, np.int64)
    ids[:2] = 1, 2
    chosen = rng.random(len(ids))
    for t in range(2, len(ids)):
        ids[t] = after[ids[t - 1]] if chosen[t] < 0.5 else (ids[t - 1] * 7 + ids[t - 2]) % 50 if chosen[t] < 0.9 else chosen[t] * 5000 % 50
    assert 8 * sum(len(b[2]) for b in idcoder.encode(ids, 16)) / len(ids) < 4.3 < np.log2(50)


def test_blocks_stand_alone_and_damage_is_found(short_blocks):
    ids = np.random.default_rng(2).integers(0, 500, 3 * 4096).astype(np.uint32)
    blocks = idcoder.encode(ids, 16)
    assert len(blocks) == 3 and np.array_equal(idcoder.decode(blocks[1:2], 16), ids[4096:8192])
    n, crc, code = blocks[1]
    for at in (1, 100, 2000, len(code) - 1):
        with pytest.raises(idcoder.Damaged):
            idcoder.decode([blocks[0], (n, crc, code[:at] + bytes([code[at] ^ 1]) + code[at + 1 :]), blocks[2]], 16)


def encoded(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.kind).tolist()


def test_words_encode_as_the_library():
    library, ours = Tokenizer.from_file(FILE), token_files.encoder(FILE)
    rng = random.Random(3)
    letters = "abcdeéñ漢😀 \n\t\xa0 '.,!#0129ABs t\x1c\x85　<|>Σςªµ²İßÖ×́"
    texts = ["", "<|endoftext|>x <|startoftext|>", "it's WE'LL", "ab" * 100_000, "a b " * 100_000, *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500))]
    assert hasattr(ours, "merges")
    assert [encoded(ours, t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, ours.words)) <= 64


def test_sections_and_their_checksums():
    ids = np.arange(10)
    data = b"".join(token_files.section(docs, [4, 6], ids, 16) for docs in ([None, 7], [-(1 << 63), (1 << 63) - 1]))
    found = list(token_files.sections(io.BytesIO(data)))
    assert [f[0] for f in found] == [[None, 7], [-(1 << 63), (1 << 63) - 1]] and all(np.array_equal(f[2], ids) for f in found)
    for at in range(len(data) // 2):
        with pytest.raises(idcoder.Damaged):
            list(token_files.sections(io.BytesIO(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :])))
    with pytest.raises(idcoder.Damaged):
        list(token_files.sections(io.BytesIO(data[:-3])))


def test_files_of_several_sections_and_extreme_ids(spark, tmp_path):
    rows = [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (None, "none"), *((i, "some words " * (i % 7)) for i in range(40)), (50, "long " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = token_files.read(token_files.write(df, f"file://{tmp_path}/s"), f"file://{tmp_path}/s").collect()
    library = Tokenizer.from_file(FILE)
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    assert {r.id: r.ids for r in got} == want and len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)


def test_files(spark, tmp_path):
    rows = [(5, "b c"), (None, "x"), (3, None), (3, "hello world"), (9, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    manifest = token_files.write(df, f"file://{tmp_path}/t")
    got = sorted((r.start, r.id, r.ids) for r in token_files.read(manifest, f"file://{tmp_path}/t").collect())
    assert [g[1] for g in got] == [None, 3, 3, 5, 9] and [g[0] for g in got] == [int(x) for x in np.cumsum([0, *(len(g[2]) for g in got[:-1])])]
    assert all(g[2][-1] == 1 for g in got) and len(got[-1][2]) == 1
    empty = token_files.write(df.limit(0), f"file://{tmp_path}/e")
    assert token_files.read(empty, f"file://{tmp_path}/e").count() == 0


def test_query(spark, sf_dir):
    library = Tokenizer.from_file(FILE)
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: tuple(r) for r in token_files.op6_token_files(spark, sf_dir).collect()}
    start = 0
    for d, e in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        assert got[d.doc_id] == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_words_of_letters_and_punctuation_are_cut_at_once():
    coder = token_files.encoder(vocabularies.path("word_bpe_49k.json", None))
    looked, cut = coder.pre_tokens, token_files.PRE_TOKENS
    for word in ("Übung,", "maïs...%%%", "it's", "l'été,", "a'", "abc'd", "x<|", "x<|endoftext|>", "<|im_end|>y", "a1", "a×b", "÷a", "Ab!!", "é", "ÿ~", "ŒUVRE,"):
        assert coder._word(word) == coder._library(word), word
    try:
        token_files.PRE_TOKENS = None  # such words don't need the expression
        assert coder._word("Naïveté?!") == looked["naïveté"] + looked["?!"]
    finally:
        token_files.PRE_TOKENS = cut


def test_plain_texts_are_merged_together_without_the_library():
    library, coder = Tokenizer.from_file(FILE), token_files.WordEncoder(FILE)
    coder.library = coder.merges = coder.special = None
    rng = random.Random(4)
    texts = ["", " ", "'", "Don't WE'LL 'sabc \"'s a''s 9's éa's x's's v'e", "12a 3", "ÀÖØß ÿ" * 3, "aaaaaaa thththe " * 9, *("".join(rng.choices("etaoinshrdlu bcdéüßÄ\n'.,0", k=rng.randint(1, 300))) for _ in range(400))]
    got = [np.frombuffer(ids, coder.kind).tolist() for ids in coder.encode_all(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, coder.runs)) <= 64


def test_merges_of_words_of_all_lengths():
    coder, rng = token_files.encoder(FILE), random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu" * 2 + "bcdéü漢", k=n)) for n in range(1, 65) for _ in range(20)] + [w * n for w in ("a", "th", "the") for n in range(1, 22)]
    assert coder.together.ids([w.encode() for w in words]) == [coder._pre_token(w) for w in words] and coder.together.ids([]) == []


@pytest.mark.parametrize("size", [1, 7, 60])
def test_texts_are_cut_by_slices(monkeypatch, size):
    monkeypatch.setattr(token_files, "SLICE", size)
    library, coder, rng = Tokenizer.from_file(FILE), token_files.encoder(FILE), random.Random(size)
    texts = ["", "", "\t", "a" * 70 + " b", "漢字　x\x1cy é × <|endoftext|>z, it's", *("".join(rng.choices("abé'sl \n 漢×\x1c\x85<|.,1S", k=rng.randint(0, 90))) for _ in range(300)), ""]
    assert [encoded(coder, t) for t in texts] == [np.frombuffer(ids, coder.kind).tolist() for ids in coder.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
