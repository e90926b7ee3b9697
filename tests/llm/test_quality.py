import math
import random
import re
from collections import Counter

import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from scriptsieve.llm import quality, vocabularies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    spans = {}
    for i in range(len(words) - 7):
        spans.setdefault(tuple(words[i : i + 8]), []).append(i)
    marked = {i + k for at in spans.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), len(words) < 20 or 100 * len(marked) > 30 * len(words)


def texts():
    rng = random.Random(4)
    out = ["", " ", "\n\n", "\x0b\x0c a\n\x0b\n a\n a", "a b c d e f g h " * 9, "x " * 400, "\xa0\n\xa0\n", "é# * $\n<a>|\n<a>|"]
    for _ in range(300):
        out.append("".join(rng.choice(["the", "a", "an#", "é*", "\n", "\n", " ", " ", "\t", "  "]) for _ in range(rng.randint(1, 200))))
    return out


def test_figures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", i) for i, t in rows], "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a b", None), (1, "a b", None)], "doc_id long, text string, lang string")
    got = quality.judge(df).collect()
    assert len(got) == 3 and not any(r.kept for r in got)
    assert quality.judge(df.limit(0)).collect() == [] and quality.kept_rows(df).collect() == []


def fertility():
    return quality.fertility(vocabularies.path("piece_bpe_32k.model"), vocabularies.path("byte_bpe_50k.json"))


def test_entropy_and_share():
    n, share, entropy, n_bytes = next(fertility().measure(["\n\n"]))
    assert n == 3 and share == pytest.approx(2 / 3) and entropy == pytest.approx(0.9182958) and n_bytes == 1


def test_measures_equal_the_libraries():
    model = fertility()
    byte_level = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    letters = [*"aAbBzZ09'.,<|>!ßÀÖÿéªµº²¼×İΣσς ſK \n\t\r\x1c 　é中文ñ́▁", " ", "  ", "\n\n", "\r\n", "<|endoftext|>", "the", "it's", ");"]
    texts = ["", " ", "word " * 50_000, "QmFz" * 20_000, *("".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(4000))]
    for text, (n, share, entropy, n_bytes) in zip(texts, model.measure(texts), strict=True):
        counts = Counter(model.library.encode(text))
        assert n == counts.total() and n_bytes == len(byte_level.encode(text, add_special_tokens=False).ids)
        assert share == pytest.approx(sum(k for i, k in counts.items() if model.library.is_byte(i)) / max(1, n))
        assert entropy == pytest.approx(-sum(k / n * math.log2(k / n) for k in counts.values()), abs=1e-9)


def test_verdict_equals_brute_force(spark, sf_dir):
    """The verdict of each text, from the libraries' ids and the bands' rules written out."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
    byte_level = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))

    def kept(text, lang):
        n_words, *_, failed = brute(text)
        ids, m = pieces.encode(text), len(byte_level.encode(text, add_special_tokens=False).ids)
        n, counts = len(ids), Counter(ids)
        if failed or not n:
            return False
        latin, letters = (len(regex.findall(p, text)) for p in (r"\p{Latin}", r"\p{L}"))
        band = quality.BANDS.get(lang) or quality.BANDS["Latin" if 2 * latin >= letters else "other"]
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        if sum(pieces.is_byte(i) for i in ids) / n > band.fallback or n >= 64 and not band.low <= entropy <= band.high:
            return False
        figures = [1, len(text) / n, len(text) / m, n / n_words, m / n_words, min(entropy, 7.1), min(max(math.log2(n), 5), 15), n**-0.5]
        if band.joint and sum(w * f for w, f in zip(band.joint, figures)) < 0:
            return False
        return len(text) / n + 2 / n**0.5 >= band.pieces or len(text) / m + 2 / m**0.5 >= band.bytes

    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.kept for r in quality.op7_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(set(got.values())) == 2
    assert got == {i: kept(d.text or "", d.lang) for i, d in docs.items()}


def test_band_falls_back_on_the_script():
    assert quality.band_of("xx", "abc", quality.BANDS) is quality.BANDS["Latin"]
    assert quality.band_of(None, "привет", quality.BANDS) is quality.BANDS["other"]


def test_good_documents_stay_and_shouted_or_marked_ones_go(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    got = quality.judge(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert len(good) > 100 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.5


def test_rows_kept_are_those_judged_so(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.op7_quality_rules(spark, sf_dir).collect() if r.kept}


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").cache()


def shares(docs):
    """Shares of good and of junk texts that stay, of those that pass the base figures."""
    got = quality.judge(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert len(good) > 100 and len(bad) > 10
    return sum(good) / len(good), sum(bad) / len(bad)


def test_nearly_all_junk_goes(labelled):
    good, bad = shares(labelled)
    assert good > 0.99 and bad < 0.05


@pytest.mark.parametrize("lang", [None, "xx", "en-US"])
def test_junk_without_a_known_language_goes(labelled, lang):
    from pyspark.sql import functions as F

    good, bad = shares(labelled.withColumn("lang", F.lit(lang).cast("string")))
    assert good > 0.99 and bad < 0.05
