"""SentencePiece encoding and decoding of whole texts.

Method: a streaming Viterbi over the lattice of vocabulary pieces. The lattice's paths are those whose neighbouring
pieces are compatible; for each end position exactly one piece survives, with a backpointer to where it starts. Only a
window of the longest piece's length is kept open: as soon as the paths of all positions from which a later piece can
start meet in one boundary, the ids up to that boundary are committed and forgotten.

The public model at hand is of the BPE kind, so a path's score is whether BPE keeps its neighbours apart
(compatible: 0, else minus infinity), which gives the library's ids exactly; the sum of piece scores would not. For a
unigram model the same window serves with summed scores (`UnigramModel`), the usual Viterbi.

Texts are cut before runs of spaces, which no piece crosses (checked against the vocabulary), and between a word and
a mark that no piece has after a letter; what is between such cuts goes through the window, and if it is no longer than 64
characters it is remembered in a bounded memo. The pieces of runs of spaces have the least score, all the same, so they merge after everything
else, from the left; as no piece joins two spaces to another character (checked as well), a run is merged by itself, on a stack.

Null texts count as empty; an empty text has no ids and decodes to itself; texts of any length take time in proportion and are whole in
memory; rows repeat as given, an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabularies
from .common import Memo, by_batch, small_batches, spread, table

SPACE = "▁"
#: Letters of the Latin blocks, and marks that may follow a word.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = ".,;:!?\n\"'()[]{}|*$%&#<>=+/-"


class PieceModel:
    """A piece vocabulary with byte fallback; normalisation is the identity with a space put before the text."""

    def __init__(self, file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.unknown = sp.unk_id()
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (i in self.special or sp.is_byte(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.ids))
        self._order()
        #: How long pieces are at most that end with three characters.
        self.ending: dict[str, int] = {}
        for p in self.usable:
            if len(p) > 2:
                self.ending[p[-3:]] = max(self.ending.get(p[-3:], 0), len(p))
        self._cuts()
        self.memo = Memo(self._encode_part, 400_000)

    def _order(self) -> None:
        """Ranks of the merged pieces, and of each the two pieces that its last merge joins; single characters have no parts."""
        merged = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.scores[self.ids[p]], self.ids[p]))
        self.rank = {p: k + 1 for k, p in enumerate(merged)}
        self.parts: dict[str, tuple[str, str]] = {}
        alone = set()
        for p in merged:
            tokens = self._merge_all(p, stop_at=p)
            if tokens is not None:
                self.parts[p] = tokens
                alone.add(p)
        #: Pieces that BPE makes of their own text; others can't stand in a path.
        self.usable = {p: self.ids[p] for p in self.ids if len(p) == 1 or p in alone}

    def _cuts(self) -> None:
        beside: set[tuple[str, str]] = {pair for p in self.usable for pair in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in beside):
            raise ValueError("pieces go on over a space")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.usable):
            raise ValueError("pieces join two spaces to another character")
        runs = [p for p in self.ids if len(p) > 1 and not p.strip(SPACE)]
        if runs and len({self.scores[self.ids[p]] for p in runs}) > 1 or any(self.scores[self.ids[p]] >= min(self.scores[i] for q, i in self.ids.items() if len(q) > 1 and q.strip(SPACE)) for p in runs):
            raise ValueError("runs of spaces don't merge last")
        #: Marks that no piece has after a Latin letter: a word ends where one of them follows.
        after_letter = {b for a, b in beside if re.match(f"[{LATIN}]", a)}
        marks = "".join(re.escape(c) for c in MARKS if c not in after_letter)
        self.cut = re.compile(rf"{SPACE}*[{LATIN}]++(?=[{SPACE}{marks}])|{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _merge_all(self, text: str, stop_at: str | None = None):
        """Plain BPE: the piece of the best score first, the leftmost among equals. With stop_at: the two parts of the last merge, if that makes the whole text."""
        parts, score, ids = list(text), self.scores, self.ids
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if best is None:
                break
            if stop_at is not None and len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None if stop_at is not None else parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE keeps pieces a and b apart when b follows a: their last merges are undone, latest first, until a pair that would have merged earlier is found or nothing is left to undo."""
        limit, rank, parts = 1 << 60, self.rank, self.parts
        while True:
            if rank.get(a + b, 1 << 60) < limit:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if ra > rb:
                limit, a = ra, parts[a][1] if a in parts else a
                if rank.get(a, 0) == ra:
                    return True
            elif rb:
                # Of equal ranks the left one merges first, so a pair of b's rank is still in time.
                limit, b = rb + 1, parts[b][0]
            else:
                return True

    def walk(self, text: str) -> Iterator[list[str]]:
        """Runs of pieces of `text`, committed as soon as they are certain."""
        longest, usable, compatible, ending = self.longest, self.usable, self._compatible_memo, self.ending.get
        last: dict[int, str] = {}
        done, before = 0, ""
        for end in range(1, len(text) + 1):
            for start in range(max(done, end - ending(text[end - 3 : end], 2)), end):
                piece = text[start:end]
                if end - start > 1 and piece not in usable:
                    continue
                left = before if start == done else last.get(start)
                if left == "" or left and compatible[left, piece]:
                    last[end] = piece
                    break
            if end - done >= 2 * longest and end < len(text):
                at = self._meeting(last, done, end)
                if at > done:
                    run = self._path(last, done, at)
                    before = run[-1]
                    yield run
                    for k in [k for k in last if k <= at]:
                        del last[k]
                    done = at
        if done < len(text):
            yield self._path(last, done, len(text))

    def _meeting(self, last: dict[int, str], done: int, end: int) -> int:
        """The latest boundary that the paths of all open positions share: later pieces start within the longest piece's length."""
        open_ends = {k for k in range(end - self.longest + 1, end + 1) if k in last}
        while len(open_ends) > 1:
            k = max(open_ends)
            open_ends.discard(k)
            open_ends.add(max(done, k - len(last[k])))
        return open_ends.pop() if open_ends else done

    @staticmethod
    def _path(last: dict[int, str], done: int, end: int) -> list[str]:
        run = []
        while end > done:
            run.append(last[end])
            end -= len(last[end])
        return run[::-1]

    @property
    def _compatible_memo(self) -> Memo:
        memo = self.__dict__.get("_pairs")
        if memo is None:
            memo = self.__dict__["_pairs"] = Memo(lambda pair: self.compatible(*pair), 200_000)
        return memo

    def _spaces(self, n: int) -> list[int]:
        """The ids of a run of spaces: equal scores merge from the left, so whatever could merge left of a space has done so before it is reached."""
        lengths: list[int] = []
        ids = self.ids
        for _ in range(n):
            lengths.append(1)
            while len(lengths) > 1 and SPACE * (lengths[-1] + lengths[-2]) in ids:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        return [ids[SPACE * k] for k in lengths]

    def _encode_part(self, part: str) -> tuple[int, ...]:
        word = part.lstrip(SPACE)
        spaces = len(part) - len(word)
        if spaces > 1:
            ids = self.memo[SPACE + word] if word else ()
            if word and ids[0] != self.ids[SPACE]:  # the word's first piece has the last space
                return (*self._spaces(spaces - 1), *ids)
            return (*self._spaces(spaces), *ids[1:])
        out: list[int] = []
        for run in self.walk(part):
            for p in run:
                k = self.ids.get(p)
                out.extend((k,) if k is not None else (self.bytes[b] for b in p.encode("utf-8", "surrogatepass")))
        return tuple(out)

    def parts_of(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no piece goes on."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        memo = self.memo
        return [k for part in self.parts_of(text or "") for k in memo[part]]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes joined and read as UTF-8, spaces restored, the first one taken off again."""
        out = bytearray()
        for k in ids:
            out += bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.special else self.pieces[k].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class UnigramModel:
    """The window with summed scores, for unigram vocabularies: pieces {text: score}; unknown characters cost `unknown`."""

    def __init__(self, pieces: dict[str, float], unknown: float = -20.0):
        self.pieces, self.unknown, self.longest = pieces, unknown, max(map(len, pieces))

    def walk(self, text: str) -> Iterator[list[str]]:
        best: dict[int, tuple[float, str]] = {0: (0.0, "")}
        done = 0
        for end in range(1, len(text) + 1):
            found = None
            for start in range(max(done, end - self.longest), end):
                piece = text[start:end]
                score = self.pieces.get(piece, self.unknown if end - start == 1 else None)
                if score is not None and start in best and (found is None or best[start][0] + score > found[0]):
                    found = (best[start][0] + score, piece)
            best[end] = found
            if end - done >= 2 * self.longest and end < len(text):
                last = {k: v[1] for k, v in best.items() if k > done}
                at = PieceModel._meeting(self, last, done, end)
                if at > done:
                    yield PieceModel._path(last, done, at)
                    best = {k: v for k, v in best.items() if k >= at}
                    done = at
        if done < len(text):
            yield PieceModel._path({k: v[1] for k, v in best.items()}, done, len(text))


@lru_cache(4)
def model(file: str) -> PieceModel:
    return PieceModel(file)


ENCODED = "ids array<int>, n_tokens long, decoded string, round_trip boolean"


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """id_col, ids, n_tokens, decoded (the text that the ids decode to) and round_trip for each row. One pass without a shuffle.

    round_trip holds if decoding gives the text again, with each U+2581 as the space that the model takes it for; null texts count as empty."""
    small_batches(df.sparkSession)
    file = vocabularies.path(vocabulary, folder)

    def run(rows: dict[str, list]) -> dict[str, list]:
        m = model(file)
        ids = [m.encode(t) for t in rows["text"]]
        texts = [m.decode(i) for i in ids]
        return {id_col: rows["id"], "ids": ids, "n_tokens": [len(i) for i in ids], "decoded": texts, "round_trip": [(t or "").replace(SPACE, " ") == d for t, d in zip(rows["text"], texts)]}

    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded", pa.string()), ("round_trip", pa.bool_())])
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(by_batch(run, schema, 128), f"`{id_col}` long, {ENCODED}")


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """As encode_texts, but with the crc32 of the ids (little-endian unsigned 32-bit) in place of ids and text."""
    small_batches(df.sparkSession)
    file = vocabularies.path(vocabulary, folder)

    def run(rows: dict[str, list]) -> dict[str, list]:
        m = model(file)
        ids = [m.encode(t) for t in rows["text"]]
        same = [(t or "").replace(SPACE, " ") == m.decode(i) for t, i in zip(rows["text"], ids)]
        return {id_col: rows["id"], "n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids], "round_trip": same}

    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(by_batch(run, schema, 256), f"`{id_col}` long, n_tokens long, ids_crc32 long, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
