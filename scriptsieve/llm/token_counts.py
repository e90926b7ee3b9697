"""Token counts of whole texts under a byte-level BPE vocabulary, without building the tokens.

Method: a whole-token shortcut. Offline - once, by the driver, before any text is read - every vocabulary string is run through the
merges; those that come out as a single token are proven to count as one wherever they stand as a pre-token. The proof, which the
vocabulary bounds, goes to the workers with the digest of the file that it is of. Texts are cut into pre-tokens, proven ones are counted
directly, and only the rest is merged, by the library's merges.

A null text counts as empty and an empty text has no tokens; texts of any length are counted whole, in memory bounded by the text;
rows repeat as given, an empty table gives no rows; columns other than the id and the text are ignored, so their names can't clash. The special string <|endoftext|> inside a text is one token, which is the
library's default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import vocabularies
from .common import Memo, by_batch, small_batches, spread, table

#: Characters with Unicode's White_Space property (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space, then other characters: no pre-token goes on from the latter to the former.
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The byte-level pre-tokens (fixed values).
PRE_TOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: The same for texts of Latin-1 characters, whose letters, numbers and white space are named.
LATIN_1 = re.compile("[\x00-\xff]*")
_LATIN_1_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[{0}]+| ?[{1}]+| ?[^{0}{1}{2}]+|[{2}]+(?![^{2}])|[{2}]+".format("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"))


def pre_tokens(text: str) -> list[str]:
    return (_LATIN_1_PRE_TOKENS if LATIN_1.fullmatch(text) else PRE_TOKENS).findall(text)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes that print stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_LETTERS = byte_letters()


def mapped(text: str) -> str:
    """The letters of a text's bytes."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _LETTERS[32])
    return "".join([_LETTERS[b] for b in text.encode("utf-8", "surrogatepass")])


class ByteBpe:
    """Merges of a byte-level BPE vocabulary in the tokenizers library's JSON."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        self.strings = [s for s in spec["model"]["vocab"] if s not in special]

    def merged(self, parts: list[str]) -> list[str]:
        """The tokens of one pre-token: the lowest-ranked pair first, the leftmost among equals."""
        if len(parts) > 48:
            return self._merged_long(parts)
        rank, none, parts = self.ranks.get, 1 << 60, list(parts)
        found = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            both = parts[at] + parts.pop(at + 1)
            parts[at] = both
            del found[at]
            if at:
                found[at - 1] = rank((parts[at - 1], both), none)
            if at < len(found):
                found[at] = rank((both, parts[at + 1]), none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap over linked positions, for long pre-tokens."""
        ranks, parts = self.ranks, list(parts)
        left, right = [i - 1 for i in range(len(parts))], [i + 1 for i in range(len(parts))]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = k = right[j]
            if k < len(parts):
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < len(parts) and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]


@dataclass(frozen=True)
class Proof:
    """The vocabulary strings that are whole pre-tokens and that the merges turn into one token; sha256 of the vocabulary's file."""

    digest: str
    strings: frozenset[str]


def _digest(file: str) -> str:
    with open(file, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@lru_cache(4)
def prove(file: str) -> Proof:
    bpe = ByteBpe(file)
    to_byte = {c: b for b, c in enumerate(bpe.letters)}
    found = set()
    for s in bpe.strings:
        try:
            text = bytes(to_byte[c] for c in s).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        if len(bpe.merged(list(s))) == 1 and PRE_TOKENS.findall(text) == [text]:
            found.add(text)
    return Proof(_digest(file), frozenset(found))


class TokenCounter:
    def __init__(self, file: str, proof: Proof):
        if _digest(file) != proof.digest:
            raise ValueError(f"the proof is not of this {file}")
        self.library, self.proven = Tokenizer.from_file(file), proof.strings
        self.merges = self.library.model
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.starts = tuple({s[:2] for s in special})
        self.chunks, self.pre_tokens = Memo(self._chunk, 300_000), Memo(self._pre_token, 300_000)

    def _pre_token(self, text: str) -> int:
        return len(self.merges.tokenize(mapped(text)))

    def _chunk(self, chunk: str) -> int:
        """Tokens of a piece of text that starts and ends where no pre-token goes on."""
        if any(s in chunk for s in self.starts) and (found := self.specials.findall(chunk)):
            return len(found) + sum(map(self._chunk, filter(None, self.specials.split(chunk))))
        if chunk in self.proven:
            return 1
        proven, merged, total = self.proven, self.pre_tokens, 0
        for p in pre_tokens(chunk):
            total += 1 if p in proven else merged[p]
        return total

    def count(self, text: str | None) -> int:
        return sum(map(self.chunks.__getitem__, CHUNKS.findall(text))) if text else 0


_COUNTERS: dict[str, TokenCounter] = {}


def counter(file: str, proof: Proof | None = None) -> TokenCounter:
    """One for each worker process and file; without a proof it is made here."""
    if file not in _COUNTERS:
        _COUNTERS[file] = TokenCounter(file, proof or prove(file))
    return _COUNTERS[file]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """id_col, n_bytes, n_tokens for each row of df. One pass without a shuffle."""
    small_batches(df.sparkSession)
    file, kind = vocabularies.path(vocabulary, folder), df.schema[id_col].dataType
    proof = df.sparkSession.sparkContext.broadcast(prove(file))  # no larger than the vocabulary

    def run(rows: dict[str, list]) -> dict[str, list]:
        count = counter(file, proof.value).count
        return {id_col: rows["id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in rows["text"]], "n_tokens": [count(t) for t in rows["text"]]}

    schema = pa.schema([(id_col, _arrow(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(by_batch(run, schema), f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


OVER_LIMIT = 512


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
