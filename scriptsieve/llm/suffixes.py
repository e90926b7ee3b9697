"""Removal of byte strings that repeat across documents, by a sparse distributed suffix array.

A byte goes if a string of `length` bytes (50) covers it that also starts in a document with a smaller id. Texts are
judged as UTF-8 bytes on the input, and strings never cross documents.

Method: sampled splitters range-partition suffixes by their leading tokens; buckets sort locally by multikey quicksort, and
equal and neighbouring suffixes are compared. So as not to move a suffix for each byte, only suffixes at anchors are
sorted: an anchor is a position whose 16-byte leading token has the least hash of some window of `length` bytes. Equal
windows have the same anchors at the same places, so each repeated string is seen from an anchor within it, and nothing is
lost. The steps, each bounded by a batch of documents or a bucket:

1. Documents are written in batches, compressed, to files of the shared folder, which the later steps read; a document is known by its batch and
   place. Other columns are kept there as Arrow data, so they come back as they were.
2. Different tokens of a batch's anchors go to buckets by ranges of their hash that hold as many anchors each, with the id of a document that has them. A bucket answers each
   batch, in its order, which tokens two ids have, and which are frequent.
3. Each shared anchor becomes a suffix with the bytes before it that a window can reach. Copies of one context in a batch are combined: the
   smallest id goes on, the others are covered. Suffixes go to range buckets. There a multikey quicksort by 8-byte tokens brings equal contexts
   together (all but the smallest id are covered whole), and contexts that share the leading token are compared window by window.
   A frequent token, which would bring very many contexts to one bucket, is instead taken apart into the windows around it: each goes by its hash
   with the batch's smallest id, so that a bucket has no more rows of a window than there are batches (of a batch with very many different windows,
   parts). They are met part by part, and spans that touch are joined at once, so that a batch of nothing but frequent tokens takes no more memory.
4. Covered spans return to the batches and are cut out.

Windows are compared by 64-bit polynomial hashes; everything else by bytes. A null text counts as empty. A null id counts as 2**63 - 1, larger than
any other id but that one, and null ids don't count against each other; rows that repeat an id are judged one by one and don't count against each
other. An empty table gives no rows; a text of any length is whole in one batch, and its suffixes are moved in parts. Other columns are kept by
`without_repeats`, whatever their names, and not read otherwise.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import forget, partitions, shared_folder, small_batches, spread, table

LENGTH, TOKEN = 50, 16
REACH = LENGTH - TOKEN
#: Bytes of text for a bucket, anchors in the splitters' sample at most, suffixes that are combined at once, windows that are met at once, bytes of text of a batch.
BUCKET_BYTES, SAMPLE, COMBINE, MEET, HOLD = 8 << 20, 100_000, 100_000, 1 << 19, 8 << 20
#: Documents from which a token is frequent: a 64th of all, within these limits. It decides how windows travel, not what is found.
FREQUENT = (1024, 1 << 16)
LAST_ID = np.iinfo(np.int64).max
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_32 = np.uint64(32)
_BASE = 0x5851F42D4C957F2D
_BYTE = (np.random.default_rng(50).integers(1, 1 << 62, 256, dtype=np.int64) * 2 + 1).astype(np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte words at every position of a byte array."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw, out = data.tobytes(), np.empty(n, np.uint64)
    for r in range(min(8, n)):
        out[r::8] = np.frombuffer(raw, "<u8", (n - r + 7) // 8, r)
    return out


def token_hashes(data: np.ndarray) -> np.ndarray:
    w = words_at(data)
    h = w[: len(w) - 8] * _C[0] ^ ((w[8:] * _C[1]) >> np.uint64(29)) ^ w[8:] * _C[1]
    h *= _C[2]
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, fn) -> np.ndarray:
    """fn over each window of `width` values, by doubling."""
    step = 1
    out = x
    while step * 2 <= width:
        out = fn(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return fn(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's anchors and their tokens' hashes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = token_hashes(data)
    width = REACH + 1
    least = _sliding(h, width, np.minimum)
    room = np.zeros(REACH, np.uint64)
    most = _sliding(np.concatenate((room, least, room)), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one or two dimensions, compressed; numbers as byte planes, rows of bytes as they are."""
    head, parts = [len(arrays)], []
    for a in arrays:
        head += [len(a), a.shape[1] if a.ndim == 2 else 0, a.dtype.itemsize, "iu".index(a.dtype.kind)]
        parts.append(a.tobytes() if a.ndim == 2 else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=level).compress(np.array(head, "<i8").tobytes() + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 32 * n, []
    for count, width, size, kind in np.frombuffer(raw, "<i8", 4 * n, 8).reshape(n, 4).tolist():
        data = np.frombuffer(raw, np.uint8, count * size * max(1, width), at)
        at += len(data)
        out.append(data.reshape(count, width) if width else np.ascontiguousarray(data.reshape(size, count).T).reshape(-1).view(f"<{'iu'[kind]}{size}"))
    return out


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of tokens: sorted by the first token, then within runs of equal ones by the next, and so on. Returns the order and the number of each sorted row's run of equal rows."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    run = np.zeros(n, np.int64)
    for k in range(words.shape[1]):
        if k:
            sizes = np.bincount(run, minlength=int(run[-1]) + 1 if n else 0)
            open_rows = np.flatnonzero(sizes[run] > 1)
            if not len(open_rows):
                break
            inner = np.lexsort((words[order[open_rows], k], run[open_rows]))
            order[open_rows] = order[open_rows][inner]
        column = words[order, k]
        new = np.ones(n, bool)
        new[1:] = (column[1:] != column[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new) - 1
    return order, run


# ---- contexts: the bytes from REACH before an anchor to LENGTH after it, zero where the text ends

WIDTH = REACH + LENGTH


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context of each anchor, and how many bytes before the anchor and after its token it really has."""
    wide = np.concatenate((np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(wide, WIDTH)[at]
    return rows, np.minimum(at, REACH).astype(np.uint8), np.minimum(len(data) - at - TOKEN, REACH).astype(np.uint8)


def sort_words(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Contexts as big-endian tokens, the suffix first; what is before the anchor and how far the text reaches come last."""
    n = len(rows)
    parts = np.zeros((n, 12 * 8), np.uint8)
    parts[:, :LENGTH] = rows[:, REACH:]
    parts[:, 56 : 56 + REACH] = rows[:, :REACH]
    parts[:, 94], parts[:, 95] = before, after
    return parts.view(">u8").astype(np.uint64)


def combine(rows, before, after, ids):
    """Of equal contexts, which rows go on (those of the smallest id) and which are covered whole."""
    order, run = multikey_sort(sort_words(rows, before, after))
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(ids[order], starts) if len(run) else ids
    covered = np.zeros(len(rows), bool)
    covered[order] = ids[order] > least[run]
    return covered, order, run


def covered_spans(rows, before, after, ids) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the bytes before its anchor and after its token that windows also in a smaller id reach; -1 where there is none. All contexts of a leading token must be here."""
    n = len(rows)
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return left, right
    whole, order, run = combine(rows, before, after, ids)
    enough = before.astype(np.int64) + after >= REACH
    left[whole & enough], right[whole & enough] = before[whole & enough], after[whole & enough]
    # One row for each distinct context, with its smallest id, among tokens that have several contexts.
    first = order[np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))))
    token = np.ascontiguousarray(rows[first][:, REACH : REACH + TOKEN]).view(np.uint64).reshape(-1, 2)
    new = np.ones(len(first), bool)
    new[1:] = (token[1:] != token[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    several = np.flatnonzero(sizes[group] > 1)
    if len(several):
        far_l, far_r = np.full(len(first), -1, np.int64), np.full(len(first), -1, np.int64)
        for part in _slices(group[several], 20_000):
            k = several[part]
            far_l[k], far_r[k] = _windows(rows[first[k]], before[first[k]], after[first[k]], least[k], group[k])
        # The rows of a context that have its smallest id.
        head = ids[order] == least[run]
        at = order[head]
        left[at], right[at] = far_l[run[head]], far_r[run[head]]
    return left, right


def _slices(group: np.ndarray, rows: int) -> Iterator[slice]:
    """Slices of about `rows` rows that don't split a group."""
    at = 0
    while at < len(group):
        end = min(at + rows, len(group))
        end = int(np.searchsorted(group, group[end - 1], "right"))
        yield slice(at, end)
        at = end


def _windows(rows, before, after, ids, group):
    """The reach of windows that a smaller id of the same group has too, by the hash of each of the windows around the anchor."""
    n = len(rows)
    powers = np.array([pow(_BASE, k, 1 << 64) for k in range(WIDTH)], np.uint64)
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    salt = group.astype(np.uint64) * _C[0]
    weighted = _BYTE[rows] * powers[None, :]
    sums = np.zeros((n, WIDTH + 1), np.uint64)
    np.cumsum(weighted, axis=1, dtype=np.uint64, out=sums[:, 1:])
    del weighted
    for back in range(REACH + 1):
        ok = np.flatnonzero((before >= back) & (after >= REACH - back))
        if len(ok) < 2:
            continue
        start = REACH - back
        h = (sums[ok, start + LENGTH] - sums[ok, start]) * np.uint64(pow(_BASE, -start, 1 << 64)) + salt[ok]
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        if len(starts) == len(h):
            continue
        own = ids[ok][order]
        least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(h))))
        hit = ok[order[own > least]]
        left[hit] = np.maximum(left[hit], back)
        right[hit] = np.maximum(right[hit], REACH - back)
    return left, right


# ---- the distributed steps

_MOVE = pa.schema([("bucket", pa.int32()), ("batch", pa.string()), ("data", pa.binary())])
_MOVE_DDL = "bucket int, batch string, data binary"


def _rows(found: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ([], [], []), _MOVE)], schema=_MOVE)


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


def _cut(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by bucket; bucket need not be sorted."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
    for s, e in zip(edges[:-1], edges[1:]):
        yield int(bucket[s]), [c[order[s:e]] for c in columns]


def _write_batches(folder: str):
    """Rows (id, text, other columns) as files of about HOLD bytes of text: ids, lengths, texts, other columns as Arrow data."""
    schema = pa.schema([("batch", pa.string())])

    def run(batches):
        forget()
        held, size, part, k = [], 0, TaskContext.get().partitionId(), 0

        def ended():
            nonlocal held, size, k
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = rows.column(1).to_pylist()
            sink = pa.BufferOutputStream()
            rest = rows.select(list(range(2, rows.num_columns)))
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest)
            name = f"docs-{part:06d}-{k:06d}"
            draft = files.Draft(folder, name)
            draft.write(pack(rows.column(0).to_numpy(), np.array(list(map(len, texts)), np.int64), np.frombuffer(b"".join(texts), np.uint8), np.frombuffer(sink.getvalue(), np.uint8), level=3))
            draft.commit()
            held, size, k = [], 0, k + 1
            return pa.RecordBatch.from_pydict({"batch": [name]}, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += sum(len(t.as_buffer() or b"") for t in held[-1].column(1))
                if size >= HOLD:
                    yield ended()
        if held:
            yield ended()

    return run


def _documents(folder: str, name: str) -> tuple[np.ndarray, list[bytes], pa.Table]:
    with files.read(f"{folder}/{name}") as f:
        ids, lengths, raw, rest = unpack(f.read())
    ends, raw = np.cumsum(lengths), raw.tobytes()
    return ids, [raw[s:e] for s, e in zip((ends - lengths).tolist(), ends.tolist())], pa.ipc.open_stream(rest.tobytes()).read_all()


def _batch_tokens(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The places of each text's anchors; the anchors' tokens (48 bits of their hash), and their texts, one after the other."""
    found = [anchors(np.frombuffer(t, np.uint8)) for t in texts]
    tokens = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)]) >> np.uint64(16)
    return [at for at, _ in found], tokens, np.repeat(np.arange(len(texts)), [len(at) for at, _ in found])


def _token_splitters(buckets: int) -> np.ndarray:
    """Ranges of tokens (48 bits) that hold as many anchors each. An anchor has the least hash of a window, so small hashes are frequent: the share q**REACH * (1 + REACH * (1 - q)) of
    the tokens with a hash of 1 - q are anchors, which are spread by the integral of this."""
    x = np.linspace(0, 1, (1 << 20) + 1)
    n, q = REACH + 2, 1 - x
    part = 1 - q ** (n - 1) * (n - REACH * q) / 2
    return (np.interp(np.arange(1, buckets) / buckets, part, x) * 2.0**48).astype(np.uint64)


def _token_rows(folder: str, splitters: np.ndarray):
    """Step 2, map: the different tokens of a batch, whether several ids have them, one of these, and how many documents."""

    def run(batches):
        forget()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ids, texts, _ = _documents(folder, name)
                _, tokens, doc = _batch_tokens(texts)
                if not len(tokens):
                    continue
                order = np.argsort(tokens, kind="stable")
                tokens, doc = tokens[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                least, most = np.minimum.reduceat(ids[doc], first), np.maximum.reduceat(ids[doc], first)
                new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])))
                n = np.add.reduceat(new.astype(np.uint32), first, dtype=np.uint32)
                out = []
                for b, (t, one, several, count) in _cut(np.searchsorted(splitters, tokens[first], "right"), tokens[first], least, (least != most).astype(np.uint8), n):
                    kinds, place = np.unique(one, return_inverse=True)
                    out.append((b, name, pack(np.diff(t, prepend=np.uint64(0)), kinds, place.astype(np.uint32), several, count)))
                yield _rows(out)

    return run


def _token_answers(frequent: int):
    """Step 2, reduce: of each batch's tokens, which two ids have, and which of these are frequent."""

    def run(batches):
        for b, asked in _runs(batches):
            parts = []
            for _, data in asked:
                step, kinds, place, several, count = unpack(data)
                parts.append((np.cumsum(step, dtype=np.uint64), kinds[place], several, count.astype(np.int64)))
            tokens, ids, several, count = (np.concatenate([p[c] for p in parts]) for c in range(4))
            order = np.argsort(tokens, kind="stable")
            tokens, ids, several, count = tokens[order], ids[order], several[order], count[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            shared = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) | (np.maximum.reduceat(several, first) > 0)
            often = shared & (np.add.reduceat(count, first) >= frequent)
            flags = np.empty((2, len(tokens)), bool)
            flags[:, order] = shared[group], often[group]
            edges = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
            yield _rows([(b, name, pack(*(np.packbits(f[s:e]) for f in flags), np.array([e - s]))) for (name, _), s, e in zip(asked, edges[:-1], edges[1:])])

    return run


SUFFIXES, WINDOWS, SPANS = range(3)
_KINDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("batch", pa.string()), ("data", pa.binary())])
_KINDS_DDL = "bucket int, kind int, batch string, data binary"


def _kinds(found: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ([], [], [], []), _KINDS)], schema=_KINDS)


def _suffix_rows(folder: str, splitters: np.ndarray, buckets: int):
    """Step 3, map: suffixes at shared anchors, combined, by range buckets; windows of frequent tokens by buckets of their hash. What a batch can tell by itself is kept beside it."""

    def run(batches):
        forget()
        for name, answers in _runs(batches):
            found = [unpack(data) for _, data in answers]
            shared, often = (np.concatenate([np.unpackbits(f[c], count=int(f[2][0])) for f in found]).astype(bool) for c in range(2))
            ids, texts, _ = _documents(folder, name)
            places, tokens, doc = _batch_tokens(texts)
            kinds, token = np.unique(tokens, return_inverse=True)
            if len(kinds) != len(shared):
                raise ValueError(f"the answers aren't those of {name}")
            shared, often, own = shared[token], often[token], []
            edges = np.append(0, np.cumsum(list(map(len, places))))
            held, wide, size, windows = [], [], 0, 0
            for k, at in enumerate(places):
                s, o = (flags[edges[k] : edges[k + 1]] for flags in (shared, often))
                data = np.frombuffer(texts[k], np.uint8)
                if (s & ~o).any():
                    held.append((k, at[s & ~o], *contexts(data, at[s & ~o])))
                    size += len(held[-1][1])
                for part in range(0, int(o.sum()), MEET // (REACH + 1)):
                    start, h = _window_hashes(data, at[o][part : part + MEET // (REACH + 1)])
                    wide.append((np.full(len(start), k, np.int32), start.astype(np.int32), h))
                    windows += len(start)
                    if windows >= MEET:
                        wide = [_askers(wide, ids, own)]
                        windows = len(wide[0][0])
                        if 2 * windows >= MEET:
                            yield _kinds(_windows_asked(name, *wide[0], ids, buckets))
                            wide, windows = [], 0
                if size >= COMBINE:
                    yield _kinds(_combined(name, held, ids, splitters, buckets, own))
                    held, size = [], 0
            if held:
                yield _kinds(_combined(name, held, ids, splitters, buckets, own))
            if wide:
                yield _kinds(_windows_asked(name, *_askers(wide, ids, own), ids, buckets))
            if own:
                draft = files.Draft(folder, f"{name}-spans")
                draft.write(pack(*(np.concatenate([x[c] for x in own]) for c in range(3))))
                draft.commit()

    return run


def _combined(name, held, ids, splitters, buckets, own):
    sizes = [len(x[1]) for x in held]
    doc = np.repeat(np.array([x[0] for x in held], np.int32), sizes)
    at, rows, before, after = (np.concatenate([x[c] for x in held]) for c in (1, 2, 3, 4))
    covered, order, _ = combine(rows, before, after, ids[doc])
    k = np.flatnonzero(covered & (before.astype(np.int64) + after >= REACH))
    own.append(joined(doc[k], (at - before)[k].astype(np.int32), (at + TOKEN + after)[k].astype(np.int32)))
    k = order[~covered[order]]
    lead = np.ascontiguousarray(rows[k][:, REACH : REACH + 8]).view(">u8").reshape(-1).astype(np.uint64)
    out = []
    for b, (d, a, x, y, r) in _cut(np.searchsorted(splitters, lead, "right"), doc[k], at[k].astype(np.int32), before[k], after[k], rows[k]):
        used, place = np.unique(d, return_inverse=True)
        out.append((b, SUFFIXES, name, pack(used, ids[used], place.astype(np.uint32), a, x, y, r)))
    return out


def _window_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows around anchors, each once."""
    starts = np.unique((at[:, None] - np.arange(REACH + 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts <= len(data) - LENGTH)]
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    powers = np.array([pow(_BASE, k, 1 << 64) for k in range(LENGTH)], np.uint64)
    out = [(_BYTE[windows[starts[k : k + 8192]]] * powers).sum(axis=1, dtype=np.uint64) for k in range(0, len(starts), 8192)]
    h = np.concatenate([np.zeros(0, np.uint64), *out])
    return starts, (h ^ (h >> _32)) * _C[2]


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (int32), with those of a document that overlap or touch joined."""
    place = doc.astype(np.int64) << 32
    order = np.argsort(place | start, kind="stable")
    begin, reach = (place | start)[order], np.maximum.accumulate((place | end)[order])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(begin)), bool), begin[1:] > reach[:-1])))
    last = np.append(first[1:], len(begin))[: len(first)] - 1
    return (begin[first] >> 32).astype(np.int32), begin[first].astype(np.int32), reach[last].astype(np.int32)


def _askers(wide, ids, own):
    """Documents, starts and hashes of windows, of each those of the smallest id, by hash; the others are covered."""
    doc, start, h = (np.concatenate([x[c] for x in wide]) for c in range(3))
    order = np.argsort(h, kind="stable")
    doc, start, h = doc[order], start[order], h[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    least = np.minimum.reduceat(ids[doc], np.flatnonzero(new))[np.cumsum(new) - 1] if len(h) else ids[doc]
    covered = ids[doc] > least
    own.append(joined(doc[covered], start[covered], start[covered] + np.int32(LENGTH)))
    return doc[~covered], start[~covered], h[~covered]


def _windows_asked(name, doc, start, h, ids, buckets):
    out = []
    for b, (x, d, a) in _cut((h >> _32).astype(np.int64) * buckets >> 32, h, doc, start):
        used, place = np.unique(d, return_inverse=True)
        out.append((b, WINDOWS, name, pack(used, ids[used], place.astype(np.uint32), a, np.diff(x, prepend=np.uint64(0)))))
    return out


def _span_rows(batches):
    """Step 3, reduce: a bucket's suffixes are sorted and compared, and its windows; spans go back to the batches."""
    for _, asked in _runs(batches):
        for kind, answer in ((SUFFIXES, _compared), (WINDOWS, _least)):
            parts = [(name, *unpack(data)) for k, name, data in asked if k == kind]
            if not parts:
                continue
            ids = np.concatenate([p[2][p[3]] for p in parts])
            hit, start, end = answer(ids, [p[4:] for p in parts])
            edges = np.cumsum([0, *(len(p[3]) for p in parts)]).tolist()
            out = []
            for (name, used, _, place, *_), s, e in zip(parts, edges[:-1], edges[1:]):
                k = np.flatnonzero(hit[s:e])
                if len(k):
                    out.append((0, name, pack(*joined(used[place[k]], start[s:e][k], end[s:e][k]))))
            yield _rows(out)


def _compared(ids, parts):
    at, before, after, rows = (np.concatenate([p[c] for p in parts]) for c in range(4))
    left, right = covered_spans(rows, before, after, ids)
    return left >= 0, (at - left).astype(np.int32), (at + TOKEN + right).astype(np.int32)


def _least(ids, parts):
    start = np.concatenate([p[0] for p in parts])
    h = np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.empty(len(h), bool)
    hit[order] = ids[order] > least
    return hit, start, start + np.int32(LENGTH)


def kept_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text without the union of spans, and how many maximal runs were removed; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    begin = starts[first].tolist()
    end = ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)].tolist()
    out, at = [], 0
    for s, e in zip(begin, end):
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out), len(begin)


def _judged(df: DataFrame, id_col: str, text_col: str, rest: list[Column], ddl: str, output) -> DataFrame:
    """What output(texts, other columns, kept texts and numbers of removed runs) makes of each batch of documents."""
    spark = df.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    size, n = df.agg(F.sum(F.octet_length(F.col(text_col))), F.count("*")).first()
    buckets = max(partitions(spark), math.ceil((size or 0) / BUCKET_BYTES))
    frequent = min(max(n // 64, FREQUENT[0]), FREQUENT[1])
    docs = df.select(F.coalesce(df[id_col].cast("long"), F.lit(int(LAST_ID))).alias("id"), F.coalesce(df[text_col].cast("binary"), F.lit(b"")).alias("text"), *rest)
    splitters = _splitters(docs, size or 0, buckets)
    spread(docs).mapInArrow(_write_batches(folder), "batch string").write.json(f"{folder}/manifest")
    manifest = spark.read.schema("batch string").json(f"{folder}/manifest")
    count = max(1, manifest.count())
    tasks = min(count, 4 * max(buckets, partitions(spark)))
    batches = manifest.repartition(tasks)

    def by_bucket(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *order)

    def by_batch(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "batch").sortWithinPartitions("batch", "bucket").select("batch", "bucket", "data")

    tokens = by_bucket(batches.mapInArrow(_token_rows(folder, _token_splitters(buckets)), _MOVE_DDL), "batch").select("bucket", "batch", "data")
    answers = by_batch(tokens.mapInArrow(_token_answers(frequent), _MOVE_DDL))
    suffixes = by_bucket(answers.mapInArrow(_suffix_rows(folder, splitters, buckets), _KINDS_DDL), "kind", "batch")
    spans = suffixes.select("bucket", "kind", "batch", "data").mapInArrow(_span_rows, _MOVE_DDL)
    every = manifest.select(F.lit(-1).cast("int").alias("bucket"), "batch", F.lit(None).cast("binary").alias("data"))

    def run(rows):
        forget()
        for name, found in _runs(rows):
            _, texts, rest = _documents(folder, name)
            spans = [unpack(data) for _, data in found if data is not None]
            if files.there(f"{folder}/{name}-spans"):
                with files.read(f"{folder}/{name}-spans") as f:
                    spans.append(unpack(f.read()))
            kept = [(t, 0) for t in texts]
            if spans:
                doc, start, end = (np.concatenate([x[c] for x in spans]) for c in range(3))
                for k, (starts, ends) in _cut(doc, start, end):
                    kept[k] = kept_bytes(texts[k], starts, ends)
            yield from output(texts, rest, kept)

    return by_batch(spans.unionByName(every)).mapInArrow(run, ddl)


def _splitters(docs: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Quantiles of the leading tokens in a sample of documents that is drawn by hash; at most about SAMPLE numbers reach the driver."""
    share = max(1, math.ceil(size / 16 / SAMPLE))

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                data = np.frombuffer(t, np.uint8)
                at, _ = anchors(data)
                at = at[:: max(1, len(at) // 4096)]
                lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").reshape(-1) if len(at) else np.zeros(0, ">u8")
                yield pa.RecordBatch.from_pydict({"lead": [lead.astype("<u8").tobytes()]}, schema=pa.schema([("lead", pa.binary())]))

    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(share)) == 0).select("text").mapInArrow(run, "lead binary")
    lead = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in sample.collect())]))
    return lead[(np.arange(1, buckets) * len(lead)) // buckets] if len(lead) else np.zeros(0, np.uint64)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 for each row of df."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def output(texts, rest, kept):
        columns = [rest.column(0).to_pylist(), [len(t) for t in texts], [len(t) - len(k) for t, (k, _) in zip(texts, kept)], [n for _, n in kept], [hashlib.sha256(k).hexdigest() for k, _ in kept]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _judged(df, id_col, text_col, [df[id_col].cast("long").alias("c0")], f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", output)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with what is left of their texts; null texts stay null. Characters that lost a byte go whole; rows of which only white space is left go, if something was removed. The other columns stay with the texts, as they were."""
    others = [c for c in df.columns if c != text_col]

    def output(texts, rest, kept):
        left, keep = [], []
        for (text, n), none in zip(kept, rest.column(0).to_pylist()):
            keep.append(not n or bool(text.decode("utf-8", "ignore").encode("utf-8").strip()))
            if keep[-1]:
                left.append(None if none else text.decode("utf-8", "ignore" if n else "replace"))
        rows = rest.filter(pa.array(keep, pa.bool_()))
        columns = {c: rows.column(1 + k).combine_chunks() for k, c in enumerate(others)} | {text_col: pa.array(left, pa.string())}
        yield pa.RecordBatch.from_arrays([columns[c] for c in df_columns], names=df_columns)

    df_columns = df.columns
    rest = [df[text_col].isNull().alias("c0"), *(df[c].alias(f"c{k + 1}") for k, c in enumerate(others))]
    return _judged(df, id_col, text_col, rest, df.schema, output)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: The oracle of the query: every window of every document, in hexadecimal digits.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, unnest(range(0, length(h) // 2, 512)) as block from d),
q as (select doc_id, length(h) as size, block, substr(h, block * 2 + 1, 2 * (512 + 49)) as part from p),
w as (select doc_id, block + i as pos, substr(part, 2 * i + 1, 2) as b, case when 2 * (block + i) + 100 <= size then substr(part, 2 * i + 1, 100) end as said from q, range(0, 512) v(i) where 2 * (block + i) < size),
m as (select said, min(doc_id) as first from w where said is not null group by said),
s as (select w.doc_id, pos, b, coalesce(m.first < w.doc_id, false) as hit from w left join m on m.said = w.said),
c as (select doc_id, pos, b, max(hit::int) over (partition by doc_id order by pos rows between 49 preceding and current row) = 1 as gone from s),
r as (select *, lag(gone, 1, false) over (partition by doc_id order by pos) as before from c),
g as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where gone and not before) as n_spans, string_agg(b, '' order by pos) filter (where not gone) as kept from r group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join g using (doc_id)
"""
