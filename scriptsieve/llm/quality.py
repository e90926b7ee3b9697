"""Quality rules for whole texts.

Base figures: words, their characters, symbols, repeated lines, and words in repeated 8-word windows. Method: tokeniser
fertility. Two public vocabularies measure characters per token, the share of byte-fallback tokens and the entropy of the
token distribution; a text is rejected outside the bands of its language, or of its script where the language has none.

Both vocabularies measure every text that passes the base figures, chunk by chunk: white space and the word after it, which no token of
either vocabulary goes beyond (checked for the pieces against their vocabulary). What the library makes of a chunk under both is remembered in a
memo, bounded by entries and their length. A text is rejected if their joint figures score below
zero (characters per token of both, tokens of both per word, entropy and length, weighted by language), or if both have few
characters per token; there each is given an allowance that shrinks with the root of the token count, so that a number, key
or address in a short clean text does not reject it.

A null text counts as empty (no words, so it fails the base rule); a null or unknown language falls back on the script; rows
repeat as given; an empty table gives no rows; texts of any length are measured whole, in memory that grows with the text alone; columns other
than id, text and language are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_counts, vocabularies
from .common import Memo, by_batch, small_batches, spread, table

SPACE = "▁"
#: Marks a count of byte-level tokens among pieces.
COUNT = 1 << 31
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Band:
    """Limits of one language or script: least characters per token under the piece and the byte-level vocabulary, largest share of byte-fallback tokens, least and largest entropy in bits; weights of the joint figures, the constant first, or none."""

    pieces: float
    bytes: float
    fallback: float = 0.25
    low: float = 3.0
    high: float = 12.0
    joint: tuple[float, ...] = ()


#: Set from labelled documents, those of "Latin" from all of them with the language withheld: of texts that pass the base figures nearly all good ones stay.
BANDS: Mapping[str, Band] = {
    "en": Band(2.52, 2.58, joint=(-140.6, 8.654, 11.39, 2.174, -1.703, 13, -0.133, 208.1)),
    "de": Band(2.54, 2.36, joint=(-148, 22.91, 0.9203, -1.455, 0.1894, 14.92, -0.7204, 160.1)),
    "es": Band(2.24, 2.08, joint=(-97.43, 6.408, -14.26, -3.662, -1.734, 20.35, -0.816, 258.8)),
    "fr": Band(2.28, 2.14, joint=(-136, 18.08, -17.13, -2.044, -0.5574, 20.83, -0.02359, 286.1)),
    "Latin": Band(2.24, 2.08, joint=(-105.4, 6.507, -8.82, -3.335, -0.4642, 17.9, -0.02423, 240.9)),
    "other": Band(0.4, 0.3, fallback=0.9),
}
#: Entropy and binary logarithm of the pieces count in the joint figures as far as labelled documents go.
JOINT_ENTROPY, JOINT_LENGTH = 7.1, (5.0, 15.0)
#: Added to the characters per token, divided by the root of the token count.
ALLOWANCE = 2.0
#: The entropy of fewer tokens says nothing.
ENTROPY_TOKENS = 64

#: White space and the word after it; on over a carriage return, which pieces have after marks.
CHUNKS = re.compile("[{0}]*[^{0}]+(?:\r[{0}]*[^{0}]*)*|[{0}]+".format(token_counts.WHITE))
_LATIN = regex.compile(r"\p{Latin}")
_LETTER = regex.compile(r"\p{L}")
_BLANK_LINE = re.compile(r"[ \t\r\x0b\x0c]*")
_MIX = (np.random.default_rng(8).integers(1, 1 << 62, WINDOW, dtype=np.int64) * 2 + 1).astype(np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h ^= h >> np.uint64(31)
    mixed = np.zeros(n, np.uint64)
    for k, m in enumerate(_MIX):
        mixed += h[k : k + n] * m
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(np.isin(mixed, twice))
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_failed(words: list[bytes], repeat: int) -> bool:
    return len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if not _BLANK_LINE.fullmatch(x)] if "\n" in text else []
    return len(lines) - len(set(lines))


def in_parts(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Slices of texts of about so many characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def band_of(lang: str | None, text: str, bands: Mapping[str, Band]) -> Band:
    if lang in bands:
        return bands[lang]
    counts = Counter(text)
    letters = {c: n for c, n in counts.items() if _LETTER.match(c)}
    return bands["Latin" if 2 * sum(n for c, n in letters.items() if _LATIN.match(c)) >= sum(letters.values()) else "other"]


class Fertility:
    """What both vocabularies make of a text."""

    def __init__(self, piece_file: str, byte_file: str, proof: token_counts.Proof | None = None):
        self.library = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        n = self.library.get_piece_size()
        if n > 1 << 16:
            raise ValueError("more than 65536 pieces")
        white = re.compile(f"(?!\\r)[{token_counts.WHITE}]")
        if any(white.search(p) or SPACE in p.lstrip(SPACE) for p in map(self.library.id_to_piece, range(n)) if len(p) > 1):
            raise ValueError("pieces go on over white space")
        self.space = self.library.piece_to_id(SPACE)
        self.is_byte = np.array([self.library.is_byte(i) for i in range(n)])
        self.counter = token_counts.counter(byte_file, proof)
        self.chunks = Memo(self._chunk, 500_000)

    def _chunk(self, chunk: str) -> bytes:
        return self._together([chunk])[0]

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Pieces of each chunk and how many byte-level tokens, marked by COUNT, as unsigned 32-bit numbers."""
        ids = self.library.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        count = self.counter._chunk
        return [array("I", (COUNT | count(c), *self._pieces(c, i))).tobytes() for c, i in zip(chunks, ids)]

    def _pieces(self, chunk: str, ids: list[int]) -> list[int]:
        """The pieces of a chunk from those that the library gives with a space before it, which stands alone before other white space."""
        if chunk[0] != " " and ids[0] == self.space:
            return ids[1:]
        return ids or [self.space]

    def measure(self, texts: list[str]) -> Iterator[tuple[int, float, float, int]]:
        """Pieces, share of byte-fallback pieces, entropy of the pieces in bits, byte-level tokens of each text."""
        memo = self.chunks
        for part in in_parts(texts):
            cut = [CHUNKS.findall(t) for t in part]
            # As the model puts a space before a text, its first chunk is one after a space; so it is looked up with one.
            for chunks in cut:
                if chunks:
                    chunks[0] = " " + chunks[0]
            new = memo.missing(chain.from_iterable(cut))
            memo.put(new, self._together(new))
            for text, chunks in zip(part, cut):
                if not chunks:
                    yield 0, 0.0, 0.0, 0
                    continue
                found = np.frombuffer(b"".join(map(memo.__getitem__, chunks)), np.uint32)
                is_count = found >= COUNT
                counts, ids = found[is_count] & (COUNT - 1), found[~is_count]
                n_bytes = int(counts[1:].sum(dtype=np.int64)) + self.counter.count(chunks[0][1:])
                if SPACE in text:
                    ids = np.array(self.library.encode(text), np.uint32)
                ids = np.sort(ids.astype(np.uint16))
                edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
                runs = np.diff(edges)
                share = float(runs[self.is_byte[ids[edges[:-1]]]].sum() / len(ids))
                yield len(ids), share, math.log2(len(ids)) - float((runs * np.log2(runs)).sum()) / len(ids), n_bytes


_FERTILITY: dict[tuple[str, str], Fertility] = {}


def fertility(piece_file: str, byte_file: str, proof: token_counts.Proof | None = None) -> Fertility:
    """One for each worker process and pair of files."""
    key = piece_file, byte_file
    if key not in _FERTILITY:
        _FERTILITY[key] = Fertility(piece_file, byte_file, proof)
    return _FERTILITY[key]


def joint_score(chars: int, n_words: int, n_pieces: int, n_bytes: int, entropy: float, weights: tuple[float, ...]) -> float:
    length = min(max(math.log2(n_pieces), JOINT_LENGTH[0]), JOINT_LENGTH[1])
    figures = (1.0, chars / n_pieces, chars / n_bytes, n_pieces / n_words, n_bytes / n_words, min(entropy, JOINT_ENTROPY), length, n_pieces**-0.5)
    return math.sumprod(weights, figures)


def verdict(chars: int, n_words: int, n_pieces: int, fallback: float, entropy: float, n_bytes: int, band: Band) -> bool:
    """Whether the fertility of a text lies in its bands under both vocabularies; a text without tokens does not."""
    if not n_pieces or fallback > band.fallback or n_pieces >= ENTROPY_TOKENS and not band.low <= entropy <= band.high:
        return False
    if band.joint and joint_score(chars, max(1, n_words), n_pieces, n_bytes, entropy, band.joint) < 0:
        return False
    return chars / n_pieces + ALLOWANCE / math.sqrt(n_pieces) >= band.pieces or chars / n_bytes + ALLOWANCE / math.sqrt(n_bytes) >= band.bytes


_FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_pieces", "long"), ("fallback_share", "double"), ("entropy", "double"), ("chars_per_token", "double")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _measured(df: DataFrame, folder: str | None):
    """Gives a worker its Fertility; the proof of the byte-level counts is made here, once."""
    piece_file, byte_file = vocabularies.path("piece_bpe_32k.model", folder), vocabularies.path("byte_bpe_50k.json", folder)
    proof = df.sparkSession.sparkContext.broadcast(token_counts.prove(byte_file))
    return lambda: fertility(piece_file, byte_file, proof.value)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: Mapping[str, Band] = BANDS, folder: str | None = None) -> DataFrame:
    """Figures and verdict for each row of df, in one pass without a shuffle."""
    small_batches(df.sparkSession)
    measured = _measured(df, folder)

    def one(text: str, lang: str | None, n: int, share: float, entropy: float, n_bytes: int) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
        repeat = repeated_words(words)
        failed = base_failed(words, repeat)
        kept = not failed and verdict(len(text), len(words), n, share, entropy, n_bytes, band_of(lang, text, bands))
        return len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeat, failed, kept, n, share, entropy, len(text) / n if n else 0.0

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in rows["text"]]
        found = [one(t, lang, *m) for t, lang, m in zip(texts, rows["lang"], measured().measure(texts))]
        return {id_col: rows["id"]} | {name: [x[i] for x in found] for i, (name, _) in enumerate(_FIELDS)}

    schema = pa.schema([(id_col, pa.int64()), *((name, _ARROW[kind]) for name, kind in _FIELDS)])
    ddl = ", ".join([f"`{id_col}` long", *(f"{name} {kind}" for name, kind in _FIELDS)])
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))).mapInArrow(by_batch(run, schema), ddl)


def kept_rows(df: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: Mapping[str, Band] = BANDS, folder: str | None = None) -> DataFrame:
    """The rows of df that the rules keep, with all their columns; rows are judged where they are read, so nothing is joined or shuffled."""
    small_batches(df.sparkSession)
    measured = _measured(df, folder)

    def run(batches):
        model = measured()
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
            base = [base_failed(w := t.encode("utf-8", "surrogatepass").split(), repeated_words(w)) for t in texts]
            rest = model.measure([t for t, failed in zip(texts, base) if not failed])
            keep = []
            for t, lang, failed in zip(texts, batch.column(names.index(lang_col)).to_pylist(), base):
                keep.append(not failed and verdict(len(t), len(t.encode("utf-8", "surrogatepass").split()), *next(rest), band_of(lang, t, bands)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spread(df).mapInArrow(run, df.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures of op7_quality_rules, which SQL can express; its verdict is the tokenisers'."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from d where len(w) > 7),
x as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as said from k),
r as (select doc_id, i from x qualify count(*) over (partition by doc_id, said) > 1),
c as (select doc_id, count(distinct i + j) as n from r, range(0, 8) v(j) group by 1),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as lines from d)
select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(w) < 20 or 100 * coalesce(c.n, 0) > 30 * len(w) as base_failed
from d join l using (doc_id) left join c using (doc_id)
"""
