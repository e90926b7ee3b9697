"""Language-model scores of whole texts by a distributed trigram model in Elias-Fano tries.

Tokens: words between ASCII white space, A-Z lower-cased, then one end. Texts whose crc32(id as text) mod 7 is not 2 train. With
p(w) = (c(w) + 1) / (N + V + 1), the base, which sums to one over the known words and one unknown,
p(w|b) = (c(b w) + MU2 p(w)) / (c(b) + MU2) and p(w|a b) = (c(a b w) + MU3 p(w|b)) / (c(a b) + MU3); `score` is the sum of
log10 p(w|a b) over the text, whose first tokens follow two starts.

Method: an Elias-Fano n-gram trie in shards that are files of the shared folder, mapped into memory. A word's id is its place in a shard of
the first level, words with their counts. A shard of the n-gram levels has its words as a monotone sequence, and ranks
in it below: the middle words b with monotone pointers to the words w that follow them, relative to b, with log10 p(w|b) and
log10(c(b w) + MU3), and monotone pointers to the words a before them, relative to b w, with log10(c(a b w) + MU3 p(w|b)), all
quantised to 16-bit steps. A query is a successor search for b, one for w in b's range and one for a in that of b w.

The steps, each bounded by a batch of texts or a shard:

1. Texts are cut into batches of tokens, written as files. Different words go to the shards of the first level, whose answers give ids and counts.
2. Different trigrams of a batch go with their counts to the shard of their middle word, which builds its trie from the training ones and
   answers all from it, in their order. log10(c(a b w) + ..) belongs to the token, log10(c(b w) + MU3) to the one after it.
3. A batch adds up the answers by text.

A middle word with a fraction of a shard's tokens or more is dealt by b w, and a pair of words with as many by a b w; their counts, which one shard alone
then can't know, are sent to all: no more than 2**20 words and 2**20 pairs, as each has that share of all tokens or more. N, V and the
number of training texts are the only other figures that reach the driver. Words are known by 64-bit hashes.

`fit` gives the model and the scores of the texts it was asked for; `score` asks a model for other texts; `scores` gives the scores alone and keeps no shard of the n-gram levels. A null text counts as empty (the
end alone), a null id trains as the text "null"; rows that repeat are each returned and each train; an empty table gives no rows and an
empty model. A text of any length is whole in one batch. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import partitions, shared_folder, small_batches, spread, table, written
from .suffixes import pack, unpack

#: Set on held-out texts of the supplied tables: -3.568 a token; MU3 5, 60 and 200 gave -3.559, -3.603 and -3.658, MU2 500 and 200 -3.591 and
#: -3.636; order 2 alone -3.808 (-3.801 with 500), the base -4.167. Part of them are near copies of training texts, hence no smaller MU3.
MU2, MU3 = 1000.0, 20.0
FOLDS, HELD = 7, 2
#: Tokens of a batch and of a shard, about.
BATCH, SHARD = 1 << 21, 1 << 21
#: Words of a batch that its files have by frequency.
FREQUENT = 4096
#: Tokens from which a word or pair is dealt over several shards: this many, or this share of all.
HOT, HOT_SHARE = SHARD // 32, 1 << 20
END_HASH = np.uint64(0x0E4D0E4D0E4D0E4D)
START, UNKNOWN, END, WORDS = 0, 1, 2, 1 << 32
_BASE = 0x9E6C63D0876A9A47 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = (np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.int64) * 2 + 1).astype(np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Logarithms are stored in 65,536 steps of STEP from -ZERO * STEP.
ZERO, STEP = 1 << 15, 24.0 / (1 << 15)


def _powers(base: int, n: int) -> np.ndarray:
    """base**k mod 2**64 for k < n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


class Hasher:
    """64-bit hashes of the words of texts, all at once."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and hashes of the words in an array of bytes."""
        if len(data) > len(self.up):
            n = max(1 << 16, 2 * len(data))
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        inside = np.concatenate(([False], _WORD[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return starts, h ^ (h >> np.uint64(29))


def tokens(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the predecessor, text number) of all tokens of texts, ends included."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    starts, h = hasher(data)
    text = np.searchsorted(stops, starts, "right")
    at = np.searchsorted(text, np.arange(len(texts)), "right")
    h, text = np.insert(h, at, END), np.insert(text, at, np.arange(len(texts)))
    before = np.concatenate((h[:1], h[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))] = START
    return h, before, text


def tokens(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, ends included, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    starts, h = hasher(data)
    text = np.searchsorted(stops, starts, "right")
    at = np.searchsorted(text, np.arange(len(texts)), "right")
    return np.insert(h, at, END_HASH), np.diff(at, prepend=0) + 1


# ---- Elias-Fano


class EliasFano:
    """A monotone sequence in low bits and a bitmap of high parts, with the ones counted by word for select and successor search."""

    def __init__(self, values: np.ndarray | None = None):
        if values is None:
            return
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.bits = n, max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        self.low = self._packed(values & np.uint64((1 << self.bits) - 1))
        high = (values >> np.uint64(self.bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(high[-1]) if n else 0) // 64 + 2) * 64, np.uint8)
        flags[high] = 1
        self.high = np.packbits(flags, bitorder="little").view("<u8")
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))))

    def _packed(self, low: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low) * self.bits // 64 + 2, np.uint64)
        if self.bits and len(low):
            at = np.arange(len(low)) * self.bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[first]] = np.bitwise_or.reduceat(low << shift, first)
            over = np.flatnonzero(shift + np.uint64(self.bits) > np.uint64(64))
            out[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits]), self.low, self.high, self.ones]

    @classmethod
    def of(cls, spec: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> EliasFano:
        self = cls()
        self.low, self.high, self.ones = low, high, ones
        self.n, self.bits = (int(x) for x in spec)
        return self

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.bits) - 1)

    @staticmethod
    def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The position of the r-th one in each word, by halves."""
        at, r = np.zeros(len(words), np.int64), r.astype(np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (words >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            go = r >= count
            r = np.where(go, r - count, r)
            at += half * go
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + self._in_word(self.high[word], i - self.ones[word])
        return (((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)).astype(np.int64)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below `high`: the ones before the (high-1)-th zero."""
        k = np.maximum(high - 1, 0)
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.minimum(np.searchsorted(zeros, k, "right") - 1, len(self.high) - 1)
        at = word * 64 + self._in_word(~self.high[word], k - zeros[word])
        return np.where(high > 0, np.minimum(at - k, self.n), 0)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose value is x or more, n if there is none, and whether it is x: the high part by the bitmap, the low bits by halving."""
        x = x.astype(np.uint64)
        most = len(self.high) * 64 - self.n - 2
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        beyond = high > most
        high = np.minimum(high, most)
        low = x & np.uint64((1 << self.bits) - 1)
        at, end = self._before(high), self._before(high + 1)
        stop = end.copy()
        todo = np.flatnonzero(at < stop)
        while len(todo):
            middle = (at[todo] + stop[todo]) >> 1
            less = self._low(middle) < low[todo]
            at[todo[less]] = middle[less] + 1
            stop[todo[~less]] = middle[~less]
            todo = todo[at[todo] < stop[todo]]
        at[beyond] = self.n
        hit = (at < end) & ~beyond
        k = np.flatnonzero(hit)
        hit[k] = self._low(at[k]) == low[k]
        return at, hit


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x / STEP) + ZERO, 0, 2 * ZERO - 1).astype(np.uint16)


def restored(steps: np.ndarray) -> np.ndarray:
    return STEP * (steps.astype(np.int64) - ZERO)


def _to_file(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file: a line that names their types and lengths, then each at a multiple of 8 bytes."""
    spec = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    draft = files.Draft(folder, name)
    try:
        draft.write(spec + b" " * (-len(spec) % 8 + 7) + b"\n")
        for a in arrays:
            draft.write(a.tobytes() + bytes(-a.nbytes % 8))
        draft.commit()
    except BaseException:
        draft.drop()
        raise


def _from_file(folder: str, name: str) -> list[np.ndarray]:
    """The arrays, mapped into memory where the file system is a local one."""
    buffer = files.mapped(f"{folder}/{name}")
    line = buffer[: min(buffer.size, 1 << 16)].to_pybytes().split(b"\n", 1)[0]
    at, out = len(line) + 1, []
    for kind, n in json.loads(line):
        out.append(np.frombuffer(buffer, kind, n, at))
        at += -(-out[-1].nbytes // 8) * 8
    return out


class Words:
    """A shard of the first level: words by hash, with counts."""

    def __init__(self, arrays: list[np.ndarray]):
        self.hashes, self.sums = EliasFano.of(*arrays[:4]), EliasFano.of(*arrays[4:8])

    @staticmethod
    def built(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        return [*EliasFano(hashes).arrays(), *EliasFano(np.append(0, np.cumsum(counts))).arrays()]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, -1 if it has none, and its count."""
        at, hit = self.hashes.successor(hashes)
        place, count = np.where(hit, at, -1), np.zeros(len(hashes), np.int64)
        at = at[hit]
        count[hit] = self.sums.get(at + 1) - self.sums.get(at)
        return place, count


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _relative(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that grow within ranges as one monotone sequence, and what is added in each range: each starts where that before it ended."""
    if not len(starts):
        return values, np.zeros(1, np.int64)
    shifts = np.append(0, np.cumsum(values[np.append(starts[1:], len(values)) - 1] + 1))
    return values + np.repeat(shifts[:-1], np.diff(np.append(starts, len(values)))), shifts


class Trie:
    """A shard of the n-gram levels."""

    PARTS = ("ranks", "middle", "to_words", "word_shifts", "words", "to_before", "before_shifts", "before")

    def __init__(self, arrays: list[np.ndarray], mu3: float):
        for k, name in enumerate(self.PARTS):
            setattr(self, name, EliasFano.of(*arrays[4 * k : 4 * k + 4]))
        self.context, self.pair, self.pair_context, self.triple = arrays[4 * len(self.PARTS) :]
        self.mu3 = mu3

    @classmethod
    def built(cls, ids, c_w, found: Keys, total: float, mu2: float, mu3: float, hot: Hot) -> list[np.ndarray]:
        """From sorted distinct trigrams, as places among the words `ids`, with counts; c_w: the words' own counts."""
        b, w, a, count, pairs, middles = found.b, found.w, found.a, found.count, found.pairs, found.middles
        c_pair = hot.pair_counts(ids[b[pairs]], ids[w[pairs]], np.add.reduceat(count, pairs) if len(pairs) else count)
        sums = np.add.reduceat(c_pair, middles) if len(middles) else c_pair
        c_b = hot.word_counts(ids[b[pairs][middles]], sums)
        p2 = (c_pair + mu2 * (c_w[w[pairs]] + 1) / total) / (c_b[found.middle_of_pair] + mu2)
        used = np.zeros(len(ids), bool)
        for x in (b, w, a):
            used[x] = True
        rank = np.cumsum(used) - 1
        words, word_shifts = _relative(rank[w[pairs]], middles)
        before, before_shifts = _relative(rank[a], pairs)
        levels = [ids[used], rank[b[pairs][middles]], np.append(middles, len(pairs)), word_shifts, words, np.append(pairs, len(b)), before_shifts, before]
        steps = [np.log10(c_b + mu2), np.log10(p2), np.log10(c_pair + mu3), np.log10(count + mu3 * p2[found.pair_of])]
        return [x for level in levels for x in EliasFano(level).arrays()] + [quantised(x) for x in steps]

    def answers(self, ids, c_w, asked: Keys, total: float, mu2: float, hot: Hot) -> np.ndarray:
        """log10 of the token's numerator, less that of its part as a context, of each trigram, in steps. Middle words, pairs and trigrams are each looked up once.
        What a word or pair that isn't here counts is 0, or known to all."""
        log_mu3, rank_there = math.log10(self.mu3), self.ranks.successor(ids)
        rank, there = rank_there[0], rank_there[1]
        # Middle words.
        b = asked.b[asked.pairs][asked.middles]
        middle, here = self.middle.successor(np.where(there[b], rank[b], self.ranks.n))
        here &= there[b]
        context_b = np.log10(hot.word_counts(ids[b], np.zeros(len(b), np.int64)) + mu2)
        context_b[here] = restored(self.context[middle[here]])
        shift, last = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        shift[here], last[here] = self.word_shifts.get(middle[here]), self.to_words.get(middle[here] + 1)
        # Pairs.
        of, w, pair_b = asked.middle_of_pair, asked.w[asked.pairs], asked.b[asked.pairs]
        c_pair = hot.pair_counts(ids[pair_b], ids[w], np.zeros(len(w), np.int64))
        p2, context = np.log10(c_pair + mu2 * (c_w[w] + 1) / total) - context_b[of], quantised(np.log10(c_pair + self.mu3))
        known = np.flatnonzero(here[of] & there[w])
        place, hit = self.words.successor(rank[w[known]] + shift[of[known]])
        hit &= place < last[of[known]]
        known, place = known[hit], place[hit]
        p2[known], context[known] = restored(self.pair[place]), self.pair_context[place]
        shift, last = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        shift[known], last[known] = self.before_shifts.get(place), self.to_before.get(place + 1)
        # Trigrams.
        of, a = asked.pair_of, asked.a
        score = quantised(p2 + log_mu3)[of]
        known = np.flatnonzero((last[of] > 0) & there[a])
        place, hit = self.before.successor(rank[a[known]] + shift[of[known]])
        hit &= place < last[of[known]]
        score[known[hit]] = self.triple[place[hit]]
        return score.astype(np.int32) - np.where(ids[w] == END, ZERO, context).astype(np.int32)[of]


class Keys:
    """Sorted distinct trigrams of places (b, w, a), with counts, and where their pairs and middle words start."""

    def __init__(self, b: np.ndarray, w: np.ndarray, a: np.ndarray, count: np.ndarray):
        self.b, self.w, self.a, self.count = b, w, a, count
        self.pairs = _firsts(b, w)
        self.middles = _firsts(b[self.pairs])
        self.pair_of = np.repeat(np.arange(len(self.pairs)), np.diff(np.append(self.pairs, len(b))))
        self.middle_of_pair = np.repeat(np.arange(len(self.middles)), np.diff(np.append(self.middles, len(self.pairs))))

    def where(self, keep: np.ndarray) -> Keys:
        return Keys(self.b[keep], self.w[keep], self.a[keep], self.count[keep])


def distinct(b: np.ndarray, w: np.ndarray, a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct rows of places below n, and which of them each row is."""
    pair, pairs = b * n + w, None
    if n**3 >= 1 << 63:
        pairs, pair = np.unique(pair, return_inverse=True)
    keys, of = np.unique(pair * n + a, return_inverse=True)
    pair, a = np.divmod(keys, n)
    b, w = np.divmod(pair if pairs is None else pairs[pair], n)
    return b, w, a, of


# ---- words and pairs that are dealt over several shards


@dataclass(frozen=True)
class Hot:
    """Frequent middle words (sorted ids) and pairs of words (sorted), with their counts."""

    ids: np.ndarray
    counts: np.ndarray
    pair_ids: np.ndarray
    pair_sums: np.ndarray

    def words(self, b: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, b), len(self.ids) - 1)
        return np.where(self.ids[at] == b, at, -1)

    def pairs(self, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Only pairs of frequent words are frequent; a pair is known by its words' places."""
        if not len(self.pair_ids):
            return np.full(len(b), -1)
        x, y = self.words(b), self.words(w)
        key = x * len(self.ids) + y
        at = np.minimum(np.searchsorted(self.pair_ids, key), len(self.pair_ids) - 1)
        return np.where((x >= 0) & (y >= 0) & (self.pair_ids[at] == key), at, -1)

    def word_counts(self, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = self.words(b)
        return np.where(at >= 0, self.counts[at], counts)

    def pair_counts(self, b: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = self.pairs(b, w)
        return np.where(at >= 0, self.pair_sums[at], counts) if len(self.pair_sums) else counts

    def shards(self, b: np.ndarray, w: np.ndarray, a: np.ndarray, shards: int) -> np.ndarray:
        key = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        often = self.words(b) >= 0
        key[often] ^= w[often].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        often = self.pairs(b, w) >= 0
        key[often] ^= a[often].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return _shard(key ^ key >> np.uint64(32), shards)


@dataclass(frozen=True)
class Model:
    """A fitted model: where its shards are, and the figures that all tasks need."""

    folder: str
    shards: int
    tokens: int
    kinds: int
    texts: int
    mu2: float
    mu3: float
    hot: Hot

    @property
    def total(self) -> float:
        return float(self.tokens + self.kinds + 1)

    def save(self) -> None:
        figures = {k: getattr(self, k) for k in ("shards", "tokens", "kinds", "texts", "mu2", "mu3")}
        draft = files.Draft(self.folder, "model.json")
        draft.write(json.dumps(figures).encode())
        draft.commit()
        _to_file(self.folder, "hot", [self.hot.ids, self.hot.counts, self.hot.pair_ids, self.hot.pair_sums])

    @staticmethod
    def load(folder: str) -> Model:
        with files.read(f"{folder}/model.json") as f:
            return Model(folder, hot=Hot(*_from_file(folder, "hot")), **json.loads(f.read()))


# ---- the distributed steps

_MOVE = pa.schema([("shard", pa.int32()), ("batch", pa.string()), ("data", pa.binary())])
_MOVE_DDL = "shard int, batch string, data binary"


def held_out(doc_id) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)).astype(np.int64) * shards) >> 32


def _cut(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by bucket, which is sorted."""
    edges = np.append(_firsts(bucket), len(bucket))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[s]), [c[s:e] for c in columns]


def _moved(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": [r[0] for r in rows], "batch": [r[1] for r in rows], "data": [r[2] for r in rows]}, schema=_MOVE)


def _runs(batches) -> Iterator[tuple[object, list[tuple]]]:
    """(key, its other columns) from rows in order of their first column."""
    at, held = None, []
    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(tuple(rest))
    if held:
        yield at, held


def _write_batches(folder: str, train: bool):
    """Texts (id, data) as files of about BATCH tokens: ids, which are null, which train, tokens of each, different words, tokens as places among them; frequent words come first, so that they compress."""
    schema = pa.schema([("batch", pa.string()), ("tokens", pa.int64())])

    def run(batches):
        hasher, part, k = Hasher(), TaskContext.get().partitionId(), 0
        held, ids, size = [], [], 0

        def ended():
            nonlocal held, ids, size, k
            h, lengths = (np.concatenate(x) for x in zip(*held))
            words, place, n = np.unique(h, return_inverse=True, return_counts=True)
            top = _by_count(n)[:FREQUENT].astype(np.uint32)
            code = np.arange(len(top), len(top) + len(words), dtype=np.uint32)
            code[top] = np.arange(len(top))
            name = f"batch-{part:06d}-{k:06d}"
            flags = np.array([(i is None, train and not held_out(i)) for i in ids], np.uint8)
            draft = files.Draft(folder, name)
            draft.write(pack(np.array([i or 0 for i in ids], np.int64), flags[:, 0], flags[:, 1], lengths, words, code[place], top, level=3))
            draft.commit()
            row = {"batch": [name], "tokens": [len(h)]}
            held, ids, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                held.append(tokens(texts, hasher))
                ids += names
                size += len(held[-1][0])
                if size >= BATCH:
                    yield ended()
        if held:
            yield ended()

    return run


def _batch(folder: str, name: str) -> list[np.ndarray]:
    with files.read(f"{folder}/{name}") as f:
        return unpack(f.read())


def _texts(folder: str, name: str) -> list[np.ndarray]:
    """What _write_batches wrote, tokens as places among the words."""
    *rest, words, code, top = _batch(folder, name)
    return [*rest, words, np.concatenate((top, np.arange(len(words), dtype=np.uint32)))[code]]


def _word_requests(folder: str, shards: int):
    """The different words of each batch by shard, with their counts in training texts and the number of these."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                _, _, train, lengths, words, place = _texts(folder, name)
                counts = np.bincount(place[np.repeat(train, lengths) > 0], minlength=len(words))
                texts = int(train.sum())
                rows = []
                for k, (shard, (h, c)) in enumerate(_cut(_shard(words, shards), words, counts)):
                    rows.append((shard, name, pack(np.diff(h, prepend=np.uint64(0)), c, np.array([0 if k else texts]))))
                yield _moved(rows)

    return run


_WORDS = pa.schema([("kind", pa.int32()), ("batch", pa.string()), ("shard", pa.int32()), ("data", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("texts", pa.int64()), ("hash", pa.int64())])
_WORDS_DDL = "kind int, batch string, shard int, data binary, id long, n long, kinds long, texts long, hash long"
ANSWER, FIGURES, OFTEN = range(3)


def _word_answers(folder: str, fitted: bool, hot: int):
    """A shard of the first level: built, unless it is there, and asked. Rows: answers by batch, figures of the shard, its frequent words."""

    def rows(kind, batch, shard, data, ids, n, kinds=(0,), texts=(0,), hashes=None):
        k = len(n)
        columns = [[kind] * k, batch, [shard] * k, data, ids, n, list(kinds) * k, list(texts) * k, [None] * k if hashes is None else hashes]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORDS)], schema=_WORDS)

    def run(batches):
        for shard, asked in _runs(batches):
            parts = [unpack(data) for _, data in asked]
            asked_for = [np.cumsum(step, dtype=np.uint64) for step, _, _ in parts]
            if not fitted:
                h, counts = np.concatenate(asked_for), np.concatenate([c for _, c, _ in parts])
                order = np.argsort(h, kind="stable")
                h, counts = h[order], counts[order]
                first = _firsts(h)
                h, counts = h[first], np.add.reduceat(counts, first)
                known = counts > 0
                h, counts = h[known], counts[known]
                _to_file(folder, f"words-{shard:07d}", Words.built(h, counts))
                yield rows(FIGURES, [None], shard, [None], [None], [int(counts.sum())], [len(h)], [int(sum(t[0] for _, _, t in parts))])
                often = np.flatnonzero((counts >= hot) & (h != END_HASH))
                yield rows(OFTEN, [None] * len(often), shard, [None] * len(often), (shard + 1) * WORDS + often, counts[often], hashes=h[often].view(np.int64))
            words = Words(_from_file(folder, f"words-{shard:07d}")) if files.there(f"{folder}/words-{shard:07d}") else Words(Words.built(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            for (name, _), h in zip(asked, asked_for):
                yield rows(ANSWER, [name], shard, [pack(*words.find(h))], [None], [len(h)])

    return run


def _ids(shards: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == END_HASH, END, np.where(place < 0, UNKNOWN, (shards + 1) * WORDS + place))


def _words_of(batch: list[np.ndarray], answers: list[tuple], shards: int):
    """The rank of each of a batch's words, and the ranks' ids and counts (0: the start), from the answers of the first level in order of shard."""
    _, _, _, _, words, _ = batch
    found = [unpack(data) for _, data in answers]
    at, count = (np.concatenate([f[c] for f in found]) for c in range(2))
    ids, first, rank = np.unique(_ids(_shard(words, shards), at, words), return_index=True, return_inverse=True)
    counts = np.where(ids == UNKNOWN, 0, count[first])
    return rank + 1, np.concatenate(([START], ids)), np.concatenate(([0], counts))


def _pair_counts(folder: str, hashes: np.ndarray):
    """Pairs of frequent words in the training texts of each batch, with counts. A word is known by its place among the frequent ones, of which the first is the start."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    order = np.argsort(hashes[1:])
    ordered = hashes[1:][order]

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                _, _, train, lengths, words, place = _texts(folder, name)
                at = np.minimum(np.searchsorted(ordered, words), len(ordered) - 1)
                w = np.where(ordered[at] == words, order[at] + 1, -1)[place]
                b = np.concatenate(([0], w[:-1]))
                b[np.cumsum(lengths) - lengths] = 0
                keep = (b >= 0) & (w >= 0) & (np.repeat(train, lengths) > 0)
                pair, n = np.unique(b[keep] * len(hashes) + w[keep], return_counts=True)
                yield pa.RecordBatch.from_pydict({"pair": pair, "n": n}, schema=schema)

    return run


class _Trigrams:
    """The different trigrams of a batch, in order of shard, from its tokens as ranks of words and the words' ids."""

    def __init__(self, lengths: np.ndarray, w: np.ndarray, kinds: np.ndarray, hot: Hot, shards: int):
        starts = np.cumsum(lengths) - lengths
        b = np.concatenate(([0], w[:-1]))
        b[starts] = 0
        a = np.concatenate(([0], b[:-1]))
        a[starts] = 0
        self.b, self.w, self.a, self.of_token = distinct(b, w, a, len(kinds))
        self.shard = hot.shards(kinds[self.b], kinds[self.w], kinds[self.a], shards)
        self.order = np.argsort(self.shard.astype(np.int32), kind="stable")

    def rows(self, train: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Of each shard: the words' ids and counts, and the trigrams as places among them, with how often they train. Places of w and a are those by falling counts, which compress."""
        n = np.bincount(self.of_token, train, len(self.b)).astype(np.uint32)
        used, place, popular = np.zeros(len(kinds), bool), np.zeros(len(kinds), np.uint32), np.zeros(len(kinds), np.uint32)
        for shard, (b, w, a, c) in _cut(self.shard[self.order], self.b[self.order], self.w[self.order], self.a[self.order], n[self.order]):
            for x in (b, w, a):
                used[x] = True
            own = np.flatnonzero(used)
            used[own] = False
            place[own] = np.arange(len(own), dtype=np.uint32)
            popular[own[_by_count(counts[own])]] = np.arange(len(own), dtype=np.uint32)
            yield shard, pack(np.diff(kinds[own], prepend=0), counts[own], np.diff(place[b], prepend=np.uint32(0)), popular[w], popular[a], c)


def _trigrams(folder: str, model: Model, hot):
    """Different trigrams of each batch by shard; base figures and the words' ids are kept in a file beside the batch."""

    def run(batches):
        for name, rows in _runs(batches):
            batch = _texts(folder, name)
            _, _, train, lengths, _, place = batch
            rank, kinds, counts = _words_of(batch, rows, model.shards)
            w = rank[place]
            text = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(text, np.log10((counts + 1) / model.total)[w], len(lengths))
            known = np.bincount(text, counts[w] > 0, len(lengths)).astype(np.int64)
            found = _Trigrams(lengths, w, kinds, hot.value, model.shards)
            draft = files.Draft(folder, f"{name}-words")
            draft.write(pack(known, base.view(np.int64), np.diff(rank, prepend=0), kinds))
            draft.commit()
            yield _moved([(shard, name, data) for shard, data in found.rows(train[text], kinds, counts)])

    return run


def _trigram_answers(model: Model, hot, fitted: bool, keep: bool):
    """A shard of the n-gram levels: built, unless it is there, and asked; keep: its file stays as a part of the model."""

    def run(batches):
        for shard, asked in _runs(batches):
            parts = [unpack(data) for _, data in asked]
            words = [np.cumsum(p[0]) for p in parts]
            ids, first, place = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
            c_w = np.concatenate([p[1] for p in parts])[first]
            del first
            edges = np.cumsum([0, *map(len, words)]).tolist()
            at = [place[s:e] for s, e in zip(edges[:-1], edges[1:])]
            # Places in a batch's words become places in the shard's.
            b = np.concatenate([x[np.cumsum(p[2], dtype=np.uint32)] for x, p in zip(at, parts)])
            at = [x[_by_count(p[1])] for x, p in zip(at, parts)]
            w, a = (np.concatenate([x[p[c]] for x, p in zip(at, parts)]) for c in (3, 4))
            b, w, a, of = distinct(b, w, a, len(ids))
            keys = Keys(b, w, a, np.bincount(of, np.concatenate([p[5] for p in parts]), len(b)).astype(np.int64))
            edges = np.cumsum([0, *(len(p[5]) for p in parts)]).tolist()
            del parts, words, place, at
            name = f"trie-{shard:07d}"
            if not fitted:
                arrays = Trie.built(ids, c_w, keys.where(keys.count > 0), model.total, model.mu2, model.mu3, hot.value)
                if keep:
                    _to_file(model.folder, name, arrays)
            elif files.there(f"{model.folder}/{name}"):
                arrays = _from_file(model.folder, name)
            else:
                arrays = Trie.built(ids, c_w, keys.where(np.zeros(len(b), bool)), model.total, model.mu2, model.mu3, hot.value)
            values = Trie(arrays, model.mu3).answers(ids, c_w, keys, model.total, model.mu2, hot.value)[of]
            out = [(shard, batch, pack(values[s:e])) for (batch, _), s, e in zip(asked, edges[:-1], edges[1:])]
            yield _moved(out)

    return run


_SCORES = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _sums(folder: str, shards: int, hot, start: float):
    """The answers of each batch's tokens, added up by text."""

    def run(batches):
        for name, rows in _runs(batches):
            ids, none, _, lengths, _, place = _texts(folder, name)
            known, base, rank, kinds = _batch(folder, f"{name}-words")
            found = _Trigrams(lengths, np.cumsum(rank)[place], kinds, hot.value, shards)
            values = np.empty(len(found.order), np.int32)
            values[found.order] = np.concatenate([unpack(data)[0] for _, data in rows])
            text = np.repeat(np.arange(len(lengths)), lengths)
            score = STEP * np.bincount(text, values[found.of_token], len(lengths)) - start
            columns = [pa.array(ids, mask=none > 0), lengths, known, base.view(np.float64), score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SCORES)

    return run


def _asked(df: DataFrame, id_col: str, text_col: str, model: Model | None, mu2: float, mu3: float, keep: bool = True) -> tuple[Model, DataFrame]:
    spark = df.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    spread(docs).mapInArrow(_write_batches(folder, model is None), "batch string, tokens long").write.json(f"{folder}/manifest")
    manifest = spark.read.schema("batch string, tokens long").json(f"{folder}/manifest")
    count, size = manifest.agg(F.count("*"), F.sum("tokens")).first()
    fitted, home = model is not None, model.folder if model else folder
    shards = model.shards if model else max(2, partitions(spark) // 2, math.ceil((size or 0) / SHARD))
    tasks = max(1, min(count, 4 * max(shards, partitions(spark))))

    def by_shard(rows: DataFrame) -> DataFrame:
        return rows.repartition(min(shards, 1 << 17), "shard").sortWithinPartitions("shard", "batch").select("shard", "batch", "data")

    def by_batch(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "batch").sortWithinPartitions("batch", "shard").select("batch", "shard", "data")

    batches = manifest.select("batch").repartition(tasks)
    asked = by_shard(batches.mapInArrow(_word_requests(folder, shards), _MOVE_DDL))
    words = written(asked.mapInArrow(_word_answers(home, fitted, HOT), _WORDS_DDL), "lm-words")
    answers = by_batch(words.where(F.col("kind") == ANSWER))
    if model is None:
        figures = words.where(F.col("kind") == FIGURES).agg(F.sum("n"), F.sum("kinds"), F.sum("texts")).first()
        n, kinds, texts = (x or 0 for x in figures)
        least = max(HOT, n // HOT_SHARE)
        often = words.where((F.col("kind") == OFTEN) & (F.col("n") >= least)).select("id", "n", "hash").collect()  # at most HOT_SHARE rows
        often = [(START, texts, 0), (END, texts, int(END_HASH)), *sorted((r.id, r.n, r.hash % (1 << 64)) for r in often)]
        none = np.zeros(0, np.int64)
        hot = Hot(*(np.array([r[k] for r in often], np.int64) for k in range(2)), none, none)
        pairs = batches.mapInArrow(_pair_counts(folder, np.array([r[2] for r in often], np.uint64)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = sorted(map(tuple, pairs.where(F.col("n") >= least).collect()))  # at most HOT_SHARE rows
        hot = Hot(hot.ids, hot.counts, *(np.array([r[k] for r in found], np.int64) for k in range(2)))
        model = Model(folder, shards, n, kinds, texts, mu2, mu3, hot)
        model.save()
    known = spark.sparkContext.broadcast(model.hot)  # bounded by HOT_SHARE
    asked = by_shard(answers.mapInArrow(_trigrams(folder, model, known), _MOVE_DDL))
    found = by_batch(asked.mapInArrow(_trigram_answers(model, known, fitted, keep), _MOVE_DDL))
    sums = found.mapInArrow(_sums(folder, shards, known, math.log10(model.texts + model.mu3)), "id long, n_tokens long, n_known long, base_score double, score double")
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), F.lit(FOLDS)) == HELD
    return model, sums.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu2: float = MU2, mu3: float = MU3) -> tuple[Model, DataFrame]:
    """The model of df's training texts, and id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df.

    The shards of the n-gram levels are written as the scores are computed; the model is whole once these have been read to the end."""
    return _asked(df, id_col, text_col, None, mu2, mu3)


def score(model: Model, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns for the rows of another table; nothing of it trains."""
    return _asked(df, id_col, text_col, model, model.mu2, model.mu3)[1]


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu2: float = MU2, mu3: float = MU3) -> DataFrame:
    """The rows of `fit` alone: shards of the n-gram levels aren't written, as each is asked only by the task that builds it."""
    return _asked(df, id_col, text_col, None, mu2, mu3, keep=False)[1]


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
