"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently, each from a fresh model, with a checksum. In a block an id is found by one of
four events: as what the order-2 table predicts after the last two ids, as what the order-1 table predicts after the last id,
by order 0 among the ids seen so far, whose adaptive frequencies then say which, or as a new id, whose bits follow. Three adaptive
distributions of events - one of the block, one by the confidence of the order-1 prediction, one by that of order 2 - are mixed with
weights that follow how well each has predicted; mixture and frequencies give the interval that a range coder of 48 bits narrows.
All arithmetic is on integers, but for two quotients whose double-precision value is proven to have the
exact whole part, so that every machine decodes alike.

A block is cut into lanes, runs of ids with a coder each, that share the block's model: all lanes code a step at once, as the
elements of arrays. Predictions are learnt after every step, frequencies and weights at the end of a generation of steps.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, lanes of a block, ids of a lane at least, steps of a generation.
BLOCK, LANES, RUN, GENERATION = 1 << 20, 4096, 128, 8
#: Bits of ids at most, of the events' part of an interval, of order 0's part, of a word of code.
ID_BITS, EVENT_BITS, ORDER0_BITS, WORD = 25, 8, 16, 16
TOTAL_BITS = EVENT_BITS + ORDER0_BITS
HIT2, HIT1, KNOWN, NEW = range(4)
CONTEXTS = 32
#: A prediction is an id, two bits of confidence in order 2, two in order 1, and three bits that are zero.
_SHIFT, _SURE2, _SURE1 = 7, np.uint32(3 << 5), np.uint32(3 << 3)
_PLACES2 = 1 << 18
_U = np.uint64
_FULL, _LEAST, _LOW = _U(1 << 48), _U(1 << 32), _U((1 << 32) - 1)
_W, _TOTAL, _ORDER0 = _U(WORD), _U(TOTAL_BITS), _U(1 << ORDER0_BITS)


class Damaged(ValueError):
    """A block whose ids don't have its checksum."""


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids; only the last lane can be shorter than the steps."""
    steps = -(-n // max(1, min(LANES, n // RUN)))
    return -(-n // steps), steps


def _places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tables hold what follows a, and what follows b, a."""
    return (a ^ a >> 16) & 0xFFFF, ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 13) & (_PLACES2 - 1)


class _Model:
    """The state of a block: predictions with confidences, distributions of events and their weights. A context is the confidence
    of order 2, that of order 1, and whether both predict the same; a cell is a context and an event."""

    def __init__(self):
        self.after1, self.after2 = np.zeros(1 << 16, np.uint32), np.zeros(_PLACES2, np.uint32)
        self.seen = [np.ones(4, np.int64), np.ones((8, 4), np.int64), np.ones((8, 4), np.int64)]
        self.weight = [1 << 14] * 3
        self.mix()

    def mix(self) -> None:
        parts = [(s << 16) // s.sum(axis=-1, keepdims=True) for s in self.seen]
        c = np.arange(CONTEXTS)
        self.parts = [np.broadcast_to(parts[0], (CONTEXTS, 4)), parts[1][c & 7], parts[2][c >> 2 & 6 | c & 1]]
        w = [(x >> 4) ** 2 for x in self.weight]
        mixed = sum(p * ((x << 10) // sum(w)) for p, x in zip(self.parts, w)) >> 10
        mixed = 1 + mixed * ((1 << EVENT_BITS) - 4) // mixed.sum(axis=1, keepdims=True)
        mixed[c, mixed.argmax(axis=1)] += (1 << EVENT_BITS) - mixed.sum(axis=1)
        self.share = mixed.astype(np.uint64).ravel()
        self.begin = ((np.cumsum(mixed, axis=1) - mixed) << ORDER0_BITS).astype(np.uint64).ravel()

    def cells(self) -> np.ndarray:
        """The cell of each context and value of the events' part."""
        return np.repeat(np.arange(4 * CONTEXTS), self.share.astype(np.int64))

    def learn_events(self, cells: list[np.ndarray]) -> None:
        """Distributions and weights after a generation of cells."""
        n = sum(map(len, cells))
        joint = np.bincount(np.concatenate(cells), minlength=4 * CONTEXTS).reshape(CONTEXTS, 4)
        for k, p in enumerate(self.parts):
            self.weight[k] = max(64, self.weight[k] + ((int((p * joint).sum()) // n - self.weight[k]) >> 2))
        c = np.arange(CONTEXTS)
        self.seen[0] += joint.sum(axis=0)
        np.add.at(self.seen[1], c & 7, joint)
        np.add.at(self.seen[2], c >> 2 & 6 | c & 1, joint)
        for s in self.seen:
            while s.max() > 1 << 16:
                s -= s >> 1
        self.mix()

    def look(self, at1: np.ndarray, at2: np.ndarray) -> np.ndarray:
        """Predictions at places of the tables, and the cells of KNOWN in their contexts."""
        self.at1, self.at2 = at1, at2
        self.e1, self.e2 = self.after1[at1], self.after2[at2]
        cell = self.e2 & _SURE2
        cell |= self.e1 & _SURE1
        cell += ((self.e1 ^ self.e2) >> _SHIFT == 0) * np.uint32(4) + np.uint32(KNOWN)
        return cell.astype(np.int64)

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """ids: shifted. The confidence of predictions that held (hit: their lanes) grows; that of the others falls, until they are replaced."""
        for table, at, e, hit, one, most in ((self.after1, self.at1, self.e1, hit1, np.uint32(8), _SURE1), (self.after2, self.at2, self.e2, hit2, np.uint32(32), _SURE2)):
            fresh = np.where(e & most > one, e - one, ids + one)
            if len(hit):
                held = e[hit]
                fresh[hit] = held + (held & most != most) * one
            table[at] = fresh


def _ends(step: int) -> bool:
    """Whether a generation ends after a step: short ones first."""
    return step % GENERATION == GENERATION - 1 or step in (0, 1, 3)


def _frequencies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order 0's frequencies, which sum to 2**ORDER0_BITS: 0 for ids that weren't seen, at least 1 for the others; if those are too many, 0 for the rarest."""
    total = 1 << ORDER0_BITS
    some = counts > 0
    if some.sum() >= total:
        some[np.lexsort((ids, -counts))[total - 1 :]] = False
    counts = np.where(some, counts, 0)
    out = np.where(some, 1 + counts * (total - int(some.sum())) // counts.sum(), 0)
    out[out.argmax()] += total - out.sum()
    return out


def _plain(id_bits: int) -> list[tuple[int, int]]:
    """(bits, shift) of the parts in which a new id's bits are coded."""
    return [(min(WORD, id_bits - at), at) for at in range(0, id_bits, WORD)]


def _columns(values: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """The values of each step, a lane a column."""
    wide = np.zeros(lanes * steps, values.dtype)
    wide[: len(values)] = values
    return np.ascontiguousarray(wide.reshape(lanes, steps).T)


def _ranked(ids: np.ndarray, wide: np.ndarray, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and the rank among them of each of `wide`, which holds ids and zeros."""
    if id_bits > 20:
        kinds = np.unique(ids)
        return kinds, np.minimum(np.searchsorted(kinds, wide), len(kinds) - 1)
    some = np.bincount(ids, minlength=1 << id_bits) > 0
    return np.flatnonzero(some), np.maximum(np.cumsum(some) - 1, 0)[wide]


def encode_block(ids: np.ndarray, id_bits: int) -> bytes:
    """The code of a block of ids below 2**id_bits: words of each lane (uint16), then the words."""
    n = len(ids)
    lanes, steps = shape(n)
    before = np.zeros((steps + 2, lanes), np.int64)
    before[2:] = _columns(ids.astype(np.uint32), lanes, steps)
    at1, at2 = _places(before[1:-1], before[:-2])
    shifted = (before[2:] << _SHIFT).astype(np.uint32)
    kinds, slot = _ranked(ids, before[2:], id_bits)
    counts = np.zeros(len(kinds), np.int64)
    share0, begin0 = np.zeros(len(kinds), np.uint64), np.zeros(len(kinds), np.uint64)
    model, cells, since, complete = _Model(), [], 0, False
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
    owners, words = [], []
    last = n - (lanes - 1) * steps  # steps of the last lane

    def shift_out(low, span, which):
        k = np.flatnonzero(span < _LEAST)
        while len(k):
            out, wider = low[k], span[k] << _W
            owners.append(k if which is None else which[k])
            words.append((out >> _U(32)).astype(np.uint32))
            out &= _LOW
            out <<= _W
            low[k], span[k] = out, wider
            k = k[wider < _LEAST]

    for t in range(steps):
        m = lanes if t < last else lanes - 1
        s, x = slot[t, :m], shifted[t, :m]
        cell = model.look(at1[t, :m], at2[t, :m])
        hit1, hit2 = np.flatnonzero((model.e1 ^ x) >> _SHIFT == 0), np.flatnonzero((model.e2 ^ x) >> _SHIFT == 0)
        f, begin = share0[s], begin0[s]
        new = () if complete else np.flatnonzero(f == 0)
        if len(new):
            cell[new] += NEW - KNOWN
        cell[hit1] &= -4
        cell[hit1] += HIT1
        cell[hit2] &= -4
        for k in (hit1, hit2, new):
            if len(k):
                f[k], begin[k] = _ORDER0, 0
        share = model.share[cell]
        begin *= share
        begin += model.begin[cell]
        f *= share
        r = span[:m] >> _TOTAL
        begin *= r
        low[:m] += begin
        np.multiply(f, r, out=span[:m])
        shift_out(low[:m], span[:m], None)
        if len(new) and len(new := new[cell[new] & 3 == NEW]):
            for bits, at in _plain(id_bits):
                lo, sp = low[new], span[new] >> _U(bits)
                lo += (x[new].astype(np.uint64) >> _U(_SHIFT + at) & _U((1 << bits) - 1)) * sp
                shift_out(lo, sp, new)
                low[new], span[new] = lo, sp
        model.learn(x, hit1, hit2)
        cells.append(cell)
        if _ends(t):
            counts += np.bincount(np.concatenate([slot[u, : lanes if u < last else lanes - 1] for u in range(since, t + 1)]), minlength=len(kinds))
            share = _frequencies(kinds, counts)
            complete = bool(share.all())
            share0, begin0 = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
            model.learn_events(cells)
            cells, since = [], t + 1
    owners.append(np.arange(lanes))
    words.append(((low + _LOW) >> _U(32)).astype(np.uint32))
    owner, word = np.concatenate(owners), np.concatenate(words)
    word = word[np.argsort(owner.astype(np.uint16), kind="stable")]
    while (carry := word >> 16).any():
        word &= 0xFFFF
        word[:-1] += carry[1:]
    return np.bincount(owner, minlength=lanes).astype("<u2").tobytes() + word.astype("<u2").tobytes()


def _merged(seen: np.ndarray, counts: np.ndarray, fresh: np.ndarray, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of seen and fresh with their counts."""
    if id_bits <= 20:
        whole = np.bincount(fresh, minlength=1 << id_bits)
        whole[seen] += counts
        seen = np.flatnonzero(whole)
        return seen, whole[seen]
    kinds, more = np.unique(fresh, return_counts=True)
    out = np.union1d(seen, kinds)
    whole = np.zeros(len(out), np.int64)
    whole[np.searchsorted(out, seen)] += counts
    whole[np.searchsorted(out, kinds)] += more
    return out, whole


def decode_block(code: bytes, n: int, id_bits: int) -> np.ndarray:
    lanes, steps = shape(n)
    sizes = np.frombuffer(code, "<u2", lanes).astype(np.int64)
    raw = np.frombuffer(code, "<u2", -1, 2 * lanes)
    if len(raw) != sizes.sum():
        raise Damaged("a block's code doesn't have the length of its lanes")
    spare = 4  # what a lane reads beyond its end is zero
    words = np.zeros(len(raw) + spare * lanes, np.uint64)
    words[np.arange(len(raw)) + spare * np.repeat(np.arange(lanes), sizes)] = raw
    at = np.cumsum(sizes + spare) - sizes - spare
    code_at = words[at] << _U(32) | words[at + 1] << _W | words[at + 2]
    at += 3
    end = len(words) - 1
    span = np.full(lanes, _FULL, np.uint64)
    model, out = _Model(), np.zeros((steps, lanes), np.int64)
    before = np.zeros((steps + 2, lanes), np.int64)
    seen, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, share0, begin0 = np.zeros(1, np.int64), np.full(1, _ORDER0, np.uint64), np.zeros(1, np.uint64)
    slots, cell_at = np.zeros(1 << ORDER0_BITS, np.int64), model.cells()
    last, since, cells = n - (lanes - 1) * steps, 0, []
    top = float((1 << TOTAL_BITS) - 1)

    def shift_in(code, span, which):
        k = np.flatnonzero(span < _LEAST)
        while len(k):
            w, wider = k if which is None else which[k], span[k] << _W
            i = at[w]
            code[k] = code[k] << _W | words[i]
            at[w] = np.minimum(i + 1, end)
            span[k] = wider
            k = k[wider < _LEAST]

    for t in range(steps):
        m = lanes if t < last else lanes - 1
        known_cell = model.look(*_places(before[t + 1, :m], before[t, :m]))
        c, sp = code_at[:m], span[:m]
        r = sp >> _TOTAL
        # Quotients of numbers below 2**48 and 2**24: a fraction is 2**-24 at least and a double has 53 bits.
        v = np.minimum(c.astype(np.float64) / r.astype(np.float64), top).astype(np.int64)
        cell = cell_at[(known_cell >> 2 << EVENT_BITS) + (v >> ORDER0_BITS)]
        event = cell & 3
        share, begin = model.share[cell], model.begin[cell]
        within = v - begin.view(np.int64)
        # Half a step above, so that the product with the reciprocal can't fall below a whole quotient.
        s = slots[((within + 0.5) / share).astype(np.int64)]
        x, f, b = held[s], share0[s], begin0[s]
        other = np.flatnonzero(event != KNOWN)
        kind = event[other]
        hit1, hit2, new = other[kind == HIT1], other[kind == HIT2], other[kind == NEW]
        x[hit1], x[hit2] = model.e1[hit1] >> _SHIFT, model.e2[hit2] >> _SHIFT
        f[other], b[other] = _ORDER0, 0
        b *= share
        b += begin
        b *= r
        c -= b
        f *= share
        np.multiply(f, r, out=sp)
        shift_in(c, sp, None)
        if len(new):
            value, cn, sn = np.zeros(len(new), np.uint64), c[new], sp[new]
            for bits, part in _plain(id_bits):
                sn >>= _U(bits)
                p = np.minimum(cn // sn, _U((1 << bits) - 1))
                cn -= p * sn
                value |= p << _U(part)
                shift_in(cn, sn, new)
            c[new], sp[new] = cn, sn
            x[new] = value
        before[t + 2, :m] = x
        # A prediction that held is one even where another event was coded.
        shifted = (x << _SHIFT).astype(np.uint32)
        hit1 = np.flatnonzero((model.e1 ^ shifted) >> _SHIFT == 0)
        model.learn(shifted, hit1, hit2)
        cells.append(cell)
        if _ends(t):
            fresh = np.concatenate([before[u + 2, : lanes if u < last else lanes - 1] for u in range(since, t + 1)])
            seen, counts = _merged(seen, counts, fresh, id_bits)
            share = _frequencies(seen, counts)
            held = seen[share > 0]
            share = share[share > 0]
            share0, begin0 = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
            slots = np.repeat(np.arange(len(held)), share)
            model.learn_events(cells)
            cell_at, cells, since = model.cells(), [], t + 1
    return np.ascontiguousarray(before[2:].T).reshape(-1)[:n].astype(np.uint32)


def encode(ids: np.ndarray, id_bits: int) -> list[tuple[int, int, bytes]]:
    """(ids, crc32 of the ids as little-endian unsigned 32-bit, code) of each block of ids below 2**id_bits."""
    if not 0 < id_bits <= ID_BITS:
        raise ValueError(f"ids have 1 to {ID_BITS} bits")
    blocks = (np.asarray(ids[at : at + BLOCK], np.int64) for at in range(0, len(ids), BLOCK))
    return [(len(x), zlib.crc32(x.astype("<u4").tobytes()), encode_block(x, id_bits)) for x in blocks]


def decode(blocks: list[tuple[int, int, bytes]], id_bits: int) -> np.ndarray:
    """The ids of blocks from encode(); raises Damaged where a checksum is wrong."""
    out = [np.zeros(0, np.uint32)]
    for n, crc, code in blocks:
        ids = decode_block(code, n, id_bits)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise Damaged("a block's ids don't have its checksum")
        out.append(ids)
    return np.concatenate(out)
