"""Token ids of whole texts in compressed binary files, in the order of the documents' ids, and their reader.

A file has sections; a section has a header, a compressed table of its documents (id or null, count) and blocks (ids, checksum, bytes),
and the blocks' code (`idcoder`); header and table have a checksum of their own. Texts are range-partitioned and sorted by id, one file a
partition, written under a temporary name and moved when complete; the manifest names files, ids and documents. Memory is
bounded by the section and the longest text.

Ids are those of the tokenizers library. Many texts at once are lower-cased and cut into pre-tokens here, as arrays of their bytes;
each different pre-token of them is looked up once in a bounded memo, and those that are not remembered are merged together, as columns of
an array. That holds for words of ASCII and Latin letters, as the vocabulary's pre-tokens end at white space; other words, and words that
could hold special strings, go to the library whole and are remembered too.

A null text counts as empty and has the end id alone. A null id comes first; rows that repeat an id follow each other, by the hash of
their texts. An empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import string
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import files, idcoder, vocabularies
from .common import Memo, partitions, shared_folder, small_batches, table
from .token_counts import byte_letters, mapped

MAGIC, VERSION = b"TIDS", 2
#: Ids of a section, about; text bytes of a file, about; files whose sizes one task adds up.
SECTION, FILE_BYTES, GROUP = 1 << 20, 16 << 20, 4096
#: Characters that are cut at once, about; pre-tokens that are merged at once.
SLICE, TOGETHER = 1 << 21, 1 << 13
_HEAD = struct.Struct("<4sHHIII")  # magic, version, bits of an id, documents, blocks, bytes of the table
_CRC = struct.Struct("<I")  # crc32 of header and table
#: Python takes these for white space, the library doesn't; texts that hold them are encoded whole.
CONTROL = re.compile("[\x1c-\x1f]")
#: How the vocabulary normalises texts and cuts words, checked against its file.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose lower case and pre-tokens are the same in Python: ASCII and the letters of Latin-1 that lower-case one to one.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Of these, letters and then punctuation, two pre-tokens at most.
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

#: Kinds of bytes: white space, letters (those of Latin-1 have two bytes), digits, other ASCII that prints, and what makes a word odd.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
KINDS = np.full(256, ODD, np.uint8)
KINDS[33:127] = OTHER
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[list(string.digits.encode())] = DIGIT
KINDS[[*string.ascii_letters.encode(), 0xC3, *range(0x80, 0xC0)]] = LETTER
KINDS[[0x97, 0xB7]] = ODD  # the signs of multiplication and division, after 0xC3
ODD_BYTES = rb"[\x00-\x08\x0e-\x1f\x7f\xc0-\xc2\xc4-\xff]|\xc3[\x97\xb7]"
#: What a byte of a word that isn't odd is in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[*string.ascii_uppercase.encode(), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 32
WHITE = re.compile("[\t-\r ]")


class Merges:
    """The merges of a byte-level vocabulary, for many pre-tokens at once: each is a column of symbols, linked both ways. In every step each
    column merges its pair of the lowest rank, the leftmost among equals, as the library does."""

    NONE = np.int64(1 << 62)

    def __init__(self, model: dict, kind: np.dtype):
        vocabulary, suffix, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.kind = kind
        self.within = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {(vocabulary[a] << 32 | vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(pairs)}
        self.pairs = np.array(sorted(made), np.int64)
        self.ranks = np.array([made[p][0] for p in self.pairs.tolist()] + [0], np.int64)
        self.pairs = np.append(self.pairs, self.NONE)
        self.product = np.zeros(len(pairs), np.int64)
        for rank, symbol in made.values():
            self.product[rank] = symbol

    def _keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Rank and place of the pairs a, b at a place; NONE if they don't merge."""
        pair = a << 32 | b
        found = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[found] == pair, self.ranks[found] << 32 | at, self.NONE)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, which isn't empty."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            longest = len(words[order[lo]]) * 5 // 4 + 1  # columns are as high as the longest
            hi = bisect_right(order, longest, lo, min(lo + TOGETHER, len(order)), key=lambda i: len(words[i]))
            some = order[lo:hi]
            for i, ids in zip(some, self._together([words[i] for i in some])):
                out[i] = ids
            lo = hi
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        most, whole = int(sizes.max()), np.frombuffer(b"".join(words), np.uint8)
        ends, column = np.cumsum(sizes), np.repeat(np.arange(n), sizes)
        symbols = np.full((most, n), -1, np.int64)
        symbols[np.arange(len(whole)) - (ends - sizes)[column], column] = self.within[whole]
        symbols[sizes - 1, np.arange(n)] = self.last[whole[ends - 1]]
        # Places are rows; `most` stands for none, and row `most` of keys takes what is said of it.
        keys = np.full((most + 1, n), self.NONE)
        for at in range(most - 1):
            both = np.flatnonzero(symbols[at + 1] >= 0)
            keys[at, both] = self._keys(symbols[at, both], symbols[at + 1, both], at)
        after = np.repeat(np.arange(1, most + 1)[:, None], n, axis=1)
        after[sizes - 1, np.arange(n)] = most
        before = np.repeat(np.arange(-1, most)[:, None], n, axis=1)  # row `most` takes what is said of none
        while True:
            best = keys.min(axis=0)
            c = np.flatnonzero(best < self.NONE)
            if not len(c):
                break
            best = best[c]
            at = best & 0xFFFFFFFF
            gone = after[at, c]
            right, left = after[gone, c], before[at, c]
            merged = self.product[best >> 32]
            symbols[at, c], symbols[gone, c] = merged, -1
            after[at, c], before[right, c] = right, at
            keys[gone, c] = keys[at, c] = self.NONE
            k = np.flatnonzero(right < most)
            keys[at[k], c[k]] = self._keys(merged[k], symbols[right[k], c[k]], at[k])
            k = np.flatnonzero(left >= 0)
            keys[left[k], c[k]] = self._keys(symbols[left[k], c[k]], merged[k], left[k])
        some = symbols.T >= 0
        packed = symbols.T[some].astype(self.kind).tobytes()
        edges = np.append(0, np.cumsum(some.sum(axis=1))) * self.kind.itemsize
        edges = edges.tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:])]


class WordEncoder:
    """The library's ids of texts."""

    def __init__(self, file: str):
        self.library = Tokenizer.from_file(file)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = False
        self.bits = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.code = "H" if self.bits <= 16 else "I"
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        simple = self._simple(spec)
        self.words = Memo(self._word, 100_000) if simple else Memo(self._library, 400_000)
        if simple:
            self.merges = self.library.model
            self.special = re.compile("|".join(sorted({re.escape(t["content"][:2]) for t in spec["added_tokens"]})) or "(?!)").search
            self.pre_tokens = Memo(self._pre_token, 50_000)  # of words that aren't cut with others
            self.starts = sorted({t["content"][:2].encode() for t in spec["added_tokens"]})
            self.odd = re.compile(b"|".join([ODD_BYTES, *map(re.escape, self.starts)])).search
            self.together = Merges(spec["model"], self.kind)
            self.runs = Memo(self._run, 600_000)

    @staticmethod
    def _simple(spec: dict) -> bool:
        """Whether words can be cut and merged here."""
        model, cut, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        parts = cut.get("pretokenizers", [{}])
        letters = [c + end for c in byte_letters() for end in ("", model.get("end_of_word_suffix") or "")]
        return (
            [n.get("type") for n in norm.get("normalizers", [])] == NORMALIZER
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": PATTERN} and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
            and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and bool(model["end_of_word_suffix"]) and not model.get("ignore_merges")
            and all(c in model["vocab"] for c in letters) and all(len(t["content"][:2].encode()) == 2 for t in spec["added_tokens"])
        )

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _library(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.pre_tokens[word.lower()]
        if self.special(word):
            return self._library(word)
        if found := LETTERS.fullmatch(word):
            letters, rest = found.groups()
            return self.pre_tokens[letters.lower()] + self.pre_tokens[rest] if rest else self.pre_tokens[letters.lower()]
        if SIMPLE.fullmatch(word):
            return b"".join(map(self.pre_tokens.__getitem__, PRE_TOKENS.findall(word.lower())))
        return self._library(word)

    def _pre_token(self, text: str) -> bytes:
        return self._packed([t.id for t in self.merges.tokenize(mapped(text))])

    def _by_word(self, text: str) -> bytes:
        if CONTROL.search(text):
            return self._library(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def _run(self, run: bytes) -> bytes:
        """The ids of what _cut finds, alone: white space, a pre-token or an odd word."""
        if run.isspace():
            return b""
        text = run.decode("utf-8", "surrogatepass")
        if not self.odd(run):
            return self._pre_token(text)
        return self._by_word(text) if CONTROL.search(text) or len(text.split()) > 1 else self._word(text)

    def _cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where white space, pre-tokens and odd words start in UTF-8, and its bytes in lower case, but for odd words."""
        raw = np.frombuffer(data, np.uint8)
        lower, kinds = LOWER[raw], KINDS[raw]
        first = np.ones(len(raw), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first |= kinds == DIGIT
        # An apostrophe that no other punctuation stands before, and what may follow it.
        marks = np.flatnonzero(lower == 39)
        marks = marks[first[marks]]
        one, two = (np.append(lower, (0, 0))[marks + k] for k in (1, 2))
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        first[marks[short | long] + 1] = False
        for which, size in ((short, 2), (long, 3)):
            ends = marks[which] + size
            first[ends[ends < len(raw)]] = True
        odd = np.flatnonzero(kinds == ODD)
        for a, b in self.starts:
            odd = np.append(odd, np.flatnonzero((raw[:-1] == a) & (raw[1:] == b)))
        if len(odd):
            white = np.concatenate(([-1], np.flatnonzero(kinds == SPACE), [len(raw)]))
            ends = np.zeros(len(white), bool)
            ends[np.searchsorted(white, odd)] = True
            k = np.flatnonzero(ends)
            edges = np.zeros(len(raw) + 1, np.int8)
            edges[white[k - 1] + 1], edges[white[k]] = 1, -1
            within = np.cumsum(edges[:-1], dtype=np.int8) > 0
            first &= ~within
            first[white[k - 1] + 1] = True
            np.copyto(lower, raw, where=within)
        return np.flatnonzero(first), lower

    def _slice(self, texts: list[str]) -> list[bytes]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(parts)
        if not data:
            return [b""] * len(texts)
        starts, lower = self._cut(data)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(lower)]).dictionary_encode()
        _, offsets, kept = runs.dictionary.buffers()
        kept, offsets, at = kept.to_pybytes(), np.frombuffer(offsets, np.int32, len(runs.dictionary) + 1).tolist(), runs.indices.to_numpy()
        found = [kept[a:b] for a, b in zip(offsets, offsets[1:])]
        packed = list(map(self.runs.get, found))
        unknown = [i for i, ids in enumerate(packed) if ids is None]
        new = [r for r in self.runs.missing(found[i] for i in unknown) if not r.isspace() and not self.odd(r)]
        self.runs.put(new, self.together.ids(new))
        for i in unknown:
            packed[i] = self.runs[found[i]]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        whole, begins, each = np.frombuffer(b"".join(packed), self.kind), np.cumsum(sizes) - sizes, sizes[at]
        before = np.append(0, np.cumsum(each))
        ids = whole[np.repeat(begins[at] - before[:-1], each) + np.arange(before[-1])].tobytes()
        ends = np.cumsum([len(p) + 1 for p in parts])
        edges = [0, *(before[np.searchsorted(starts, ends)] * self.kind.itemsize).tolist()]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def _long(self, text: str) -> bytes:
        """The ids of a text that is cut by slices, which end at white space."""
        out, at = [], 0
        while found := WHITE.search(text, at + SLICE):
            out += self._slice([text[at : found.start()]])
            at = found.end()
        return b"".join([*out, *self._slice([text[at:]])])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian numbers of `kind`."""
        if not hasattr(self, "together"):
            yield from map(self._by_word, texts)
            return
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > SLICE:
                yield from self._slice(held)
                held, size = [], 0
            if len(text) > SLICE:
                yield self._long(text)
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._slice(held)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def section(docs: list[int | None], counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = idcoder.encode(ids, bits)
    none = np.packbits([d is None for d in docs])
    names = zlib.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(counts, "<u8").tobytes() + np.array([(n, crc, len(code)) for n, crc, code in blocks], "<u8").tobytes() + none.tobytes(), 6)
    head = _HEAD.pack(MAGIC, VERSION, bits, len(docs), len(blocks), len(names))
    return b"".join((head, _CRC.pack(zlib.crc32(names, zlib.crc32(head))), names, *(code for _, _, code in blocks)))


def sections(stream):
    """(documents, counts, ids) of each section of a file."""

    def exactly(size: int) -> bytes:
        data = stream.read(size)
        if len(data) != size:
            raise idcoder.Damaged("the file ends inside a section")
        return data

    while first := stream.read(1):
        head = first + exactly(_HEAD.size - 1)
        magic, version, bits, n, blocks, size = _HEAD.unpack(head)
        if magic != MAGIC or version != VERSION:
            raise idcoder.Damaged("not a section of token ids")
        (crc,) = _CRC.unpack(exactly(_CRC.size))
        packed = exactly(size)
        if zlib.crc32(packed, zlib.crc32(head)) != crc:
            raise idcoder.Damaged("a section's header and table don't have their checksum")
        names = zlib.decompress(packed)
        found = np.frombuffer(names, "<u8", 3 * blocks, 16 * n).reshape(-1, 3).tolist()
        none = np.unpackbits(np.frombuffer(names, np.uint8, -1, 16 * n + 24 * blocks), count=n)
        docs = [None if x else d for d, x in zip(np.frombuffer(names, "<i8", n).tolist(), none)]
        yield docs, np.frombuffer(names, "<u8", n, 8 * n), idcoder.decode([(k, c, exactly(length)) for k, c, length in found], bits)


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int | None = 1, vocabulary_folder: str | None = None) -> DataFrame:
    """Writes the ids of df's texts under folder and returns the manifest: part, file, documents, ids. end_id is appended to each text."""
    spark, source = df.sparkSession, vocabularies.path(vocabulary, vocabulary_folder)
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // FILE_BYTES))
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])

    def run(batches):
        part = TaskContext.get().partitionId()
        coder, draft, docs, counts, held, size, total, n = encoder(source), None, [], [], [], 0, 0, 0
        wide = coder.kind.itemsize
        end = b"" if end_id is None else np.array([end_id], coder.kind).tobytes()

        def ended():
            nonlocal draft, docs, counts, held, size, total, n
            draft = draft or files.Draft(folder, f"ids-{part:06d}.bin")
            draft.write(section(docs, counts, np.frombuffer(b"".join(held), coder.kind), coder.bits))
            total, n = total + size, n + len(docs)
            docs, counts, held, size = [], [], [], 0

        try:
            for batch in batches:
                names, texts = (c.to_pylist() for c in batch.columns)
                for doc, ids in zip(names, coder.encode_all(texts)):
                    ids += end
                    docs.append(doc)
                    counts.append(len(ids) // wide)
                    held.append(ids)
                    size += counts[-1]
                    if size >= SECTION:
                        ended()
            if docs:
                ended()
            if draft is not None:
                draft.commit()
                yield pa.RecordBatch.from_pydict({"part": [part], "file": [draft.name.rsplit("/", 1)[1]], "documents": [n], "ids": [total]}, schema=schema)
                draft = None
        finally:
            if draft is not None:
                draft.drop()

    key = F.xxhash64("text")
    ordered = rows.withColumn("key", key).repartitionByRange(parts, "id", "key").sortWithinPartitions("id", "key").select("id", "text")
    made = ordered.mapInArrow(run, "part long, file string, documents long, ids long")
    made.write.json(f"{folder}/manifest")
    return spark.read.schema(made.schema).json(f"{folder}/manifest")


_READ = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def _read(manifest: DataFrame, folder: str, schema: pa.Schema, ddl: str, row) -> DataFrame:
    # The ids before a file: those of the groups of files before its own, a row each, and those of its group's files before it.
    before = lambda w, name: F.coalesce(F.sum("ids").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = manifest.withColumn("group", F.floor(F.col("part") / GROUP))
    groups = grouped.groupBy("group").agg(F.sum("ids").alias("ids"))
    groups = groups.select("group", before(Window, "group").alias("first"))
    placed = grouped.withColumn("own", before(Window.partitionBy("group"), "part")).join(groups, "group").withColumn("start", F.col("first") + F.col("own"))

    def run(batches):
        for batch in batches:
            for name, documents, total, start in zip(*(c.to_pylist() for c in batch.columns)):
                seen = 0
                with files.seekable(f"{folder}/{name}") as stream:
                    for docs, counts, ids in sections(stream):
                        edges = np.append(0, np.cumsum(counts.astype(np.int64)))
                        out = [row(d, start + int(a), ids[a:b]) for d, a, b in zip(docs, edges[:-1], edges[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        seen, start = seen + len(docs), start + int(edges[-1])
                if seen != documents:
                    raise idcoder.Damaged(f"{name} is not what the manifest says")

    return placed.select("file", "documents", "ids", "start").repartition(max(2, 2 * partitions(manifest.sparkSession)), "file").mapInArrow(run, ddl)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """id, start (ids of all documents before it), ids of each document."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return _read(manifest, folder, schema, "id long, start long, ids array<long>", lambda d, s, ids: (d, s, ids.astype(np.int64)))


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """id, start, n_tokens and the crc32 of the ids of each document."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _read(manifest, folder, schema, "id long, start long, n_tokens long, ids_crc32 long", lambda d, s, ids: (d, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "documents"), folder)
    return read_digests(manifest, folder).withColumnRenamed("id", "doc_id")
