"""Context-mixing range coder for token ids, many blocks side by side.

A segment's ids are predicted by three orders, fitted to the whole segment and kept in its header.
Order 2 and order 1 name the id that most often follows the last two ids (by a hash) or the last
id, with a level of confidence; order 0 is the frequency of each id where neither is right. The
orders are mixed by the rates seen in each joint state of both levels. A symbol of the range coder is
"order 2 is right", "order 1 is right" or an id of order 0.

A block of ids is coded alone: its contexts start anew, and a CRC of its ids is kept. Blocks are lanes of
numpy arrays and move in lockstep, so the cost of a step is shared by thousands of them. Carries of the coder's
low end go into the word before, after the last step. Quotients are taken in doubles, which is exact for
numerators below 2**48 and divisors up to 2**24: any machine decodes what another coded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PLTS"
VERSION = 2
#: Ids of a block at most and at least, and blocks of a segment that are aimed at.
BLOCK, SHORT, LANES = 4096, 256, 8192
#: Bits of an id, of all frequencies, of order 0's frequencies, of order 2's hash, and of a confidence.
ID_BITS, T_BITS, C_BITS, H2, K = 17, 24, 18, 20, 3
#: Rates of being right from which a context has the next higher level; below the first it predicts nothing.
LEVELS = np.array([1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 15 / 16])
#: A context's id is kept if it was right as often.
HITS = 16
#: Ids whose intervals are worked out together.
SLICE = 1 << 16

_T, _SMALL = 1 << T_BITS, 1 << 32
_STATES = 1 << 2 * K + 1
_NONE = -1 << K  # the entry of a context that predicts nothing: id -1 at level 0


def hashed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one * 40503 + two * 30011) & ((1 << H2) - 1)  # the low bits are right in 32 bits, too


def followers(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with an id that follows them often enough, and their entries: that id << K | level."""
    key = context.astype(np.int64) << ID_BITS
    key |= ids
    key.sort()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(start, append=len(key))
    key = key[start]
    owner = key >> ID_BITS
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    best = np.maximum.reduceat(count << ID_BITS | key & ((1 << ID_BITS) - 1), first)
    hits = best >> ID_BITS
    level = np.searchsorted(LEVELS, hits / np.add.reduceat(count, first), side="right")
    keep = (hits >= HITS) & (level > 0)
    return owner[first][keep], (best & ((1 << ID_BITS) - 1))[keep] << K | level[keep]


class Model:
    """What a segment's header says of its orders and their mixture."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays  # contexts and entries of order 1, of order 2; ids and frequencies of order 0; frequencies of states
        c1, e1, c2, e2, used, freq, both = arrays
        self.t1, self.t2 = np.full(1 << ID_BITS, _NONE, np.int32), np.full(1 << H2, _NONE, np.int32)
        self.t1[c1], self.t2[c2] = e1, e2
        self.f2, self.f1 = both[:_STATES].astype(np.int64), both[_STATES:].astype(np.int64)
        self.known = self.f2 + self.f1
        self.ids = used.astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(freq)]).astype(np.int64)

    @classmethod
    def fit(cls, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[Model, np.ndarray]:
        """The model of these ids, and the event of each of them: its state, behind the states of other kinds (order 2 is right, order 1 is, neither)."""
        empty = np.zeros(0, np.int64)
        orders = [*followers(one, ids), *followers(hashed(one, two), ids)] if len(ids) else [empty] * 4
        model = cls([*orders, empty, empty, np.zeros(2 * _STATES, np.int64)])
        event = np.empty(len(ids), np.int16)
        missed = np.zeros(1 << ID_BITS, np.int64)
        for i in range(0, len(ids), SLICE):
            x = ids[i : i + SLICE]
            p2, p1, state = model.predict(one[i : i + SLICE], two[i : i + SLICE])
            event[i : i + SLICE] = state + np.where(x == p2, 0, np.where(x == p1, _STATES, 2 * _STATES))
            missed += np.bincount(x[event[i : i + SLICE] >= 2 * _STATES], minlength=1 << ID_BITS)
        seen = np.bincount(event, minlength=3 * _STATES).reshape(3, _STATES)
        both = np.where(seen[:2] > 0, np.maximum(seen[:2] * (_T - (2 << C_BITS)) // np.maximum(seen.sum(axis=0), 1), 1), 0)
        used = np.flatnonzero(missed)
        if not len(used):
            used, missed[0] = np.array([0]), 1
        count = missed[used]
        freq = np.maximum(count * ((1 << C_BITS) - len(used)) // count.sum(), 1)
        freq[count.argmax()] += (1 << C_BITS) - freq.sum()
        return cls([*orders, used, freq, both.reshape(-1)]), event

    def pack(self) -> bytes:
        parts = [np.diff(a, prepend=0) if k in (0, 2, 4) else a for k, a in enumerate(self.arrays)]
        return zlib.compress(struct.pack("<7I", *map(len, parts)) + b"".join(a.astype("<u4").tobytes() for a in parts))

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        raw = zlib.decompress(data)
        stop = np.cumsum(struct.unpack("<7I", raw[:28]))[:-1]
        parts = np.split(np.frombuffer(raw, "<u4", offset=28).astype(np.int64), stop)
        return cls([np.cumsum(a) if k in (0, 2, 4) else a for k, a in enumerate(parts)])

    def predict(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both orders' ids, and the joint state of their levels."""
        e2, e1 = self.t2[hashed(one, two)], self.t1[one]
        p2, p1 = e2 >> K, e1 >> K
        level = (1 << K) - 1
        return p2, p1, ((e2 & level) << K + 1) + ((e1 & level) << 1) + (p2 == p1)

    def intervals(self, ids: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's share of all frequencies begins, and its width."""
        known = self.known.astype(np.int32)
        begins = np.concatenate([np.zeros(_STATES, np.int32), self.f2.astype(np.int32), known])
        widths = np.concatenate([self.f2, self.f1, _T - self.known]).astype(np.int32)
        begin, width = begins[event], widths[event]
        low, high = np.zeros(1 << ID_BITS, np.int32), np.zeros(1 << ID_BITS, np.int32)
        low[self.ids], high[self.ids] = self.edges[:-1], self.edges[1:]
        for i in range(0, len(ids), SLICE):
            at = np.flatnonzero(event[i : i + SLICE] >= 2 * _STATES)
            x, room = ids[i : i + SLICE][at], width[i : i + SLICE][at].astype(np.int64)
            a = room * low[x] >> C_BITS
            begin[i : i + SLICE][at] += a.astype(np.int32)
            width[i : i + SLICE][at] = (room * high[x] >> C_BITS) - a
        return begin, width


def block_length(n: int) -> int:
    """Ids of a block where a segment has n: short enough for many lanes."""
    return min(BLOCK, max(SHORT, -(-n // LANES)))


def grid(x: np.ndarray, block: int, lanes: int) -> np.ndarray:
    """A row for each step, a column for each lane."""
    full = np.zeros(lanes * block, x.dtype)
    full[: len(x)] = x
    return np.ascontiguousarray(full.reshape(lanes, block).T)


def encode_blocks(ids: np.ndarray, block: int | None = None) -> bytes:
    """A segment: header, model, directory (words and CRC of each block), coded blocks."""
    raw = np.asarray(ids).astype("<u4")
    if len(raw) and int(raw.max()) >> ID_BITS:
        raise ValueError(f"token ids must be below {1 << ID_BITS}")
    block = block or block_length(len(raw))
    lanes = -(-len(raw) // block)
    x = raw.astype(np.int32)
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[1:] = x[:-1]
    one[::block] = 0
    two[1:] = one[:-1]
    two[::block] = 0
    model, event = Model.fit(x, one, two)
    begin, width = (grid(a, block, lanes) for a in model.intervals(x, event))
    del x, one, two, event
    size = [block] * (lanes - 1) + [len(raw) - block * (lanes - 1)] if lanes else []
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    out = np.zeros((2 * block + 8) * lanes, np.uint32)  # a row for each word's place, a column for each lane
    place = np.arange(lanes)
    for t in range(block if lanes else 0):
        n = lanes if t < size[-1] else lanes - 1
        if not n:
            break
        lo, sp, at = low[:n], span[:n], place[:n]
        unit = sp >> T_BITS
        lo += unit * begin[t, :n]
        np.multiply(unit, width[t, :n], out=sp)
        small = (sp < _SMALL).astype(np.int64)
        while small.any():
            word = lo >> 32
            out[at] = word
            at += small * lanes
            lo -= (word * small) << 32
            small <<= 4
            lo <<= small
            sp <<= small
            small = (sp < _SMALL).astype(np.int64)
    for _ in range(3):
        out[place] = low >> 32
        place += lanes
        low = (low & (_SMALL - 1)) << 16
    over = np.flatnonzero(out >> 16)
    while len(over):
        out[over] &= 0xFFFF
        over -= lanes
        out[over] += 1
        over = over[out[over] > 0xFFFF]
    used = place // max(lanes, 1)
    rows = int(used.max(initial=0))
    words = out[: rows * lanes].astype(">u2").reshape(rows, lanes).T[np.arange(rows) < used[:, None]]
    crcs = [zlib.crc32(raw[i * block : i * block + n].tobytes()) for i, n in enumerate(size)]
    packed = model.pack()
    head = MAGIC + struct.pack("<IIII", VERSION, block, len(raw), len(packed))
    return head + packed + used.astype("<u4").tobytes() + np.array(crcs, "<u4").tobytes() + words.tobytes()


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of a segment; a wrong checksum is an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    version, block, total, length = struct.unpack("<IIII", data[4:20])
    if version != VERSION:
        raise ValueError(f"unknown version {version} of a token segment")
    try:
        model = Model.unpack(data[20 : 20 + length])
    except (zlib.error, struct.error) as e:
        raise ValueError("the model of a token segment is damaged") from e
    lanes = -(-total // block)
    size = [block] * (lanes - 1) + [total - block * (lanes - 1)] if lanes else []
    used, crcs = np.frombuffer(data, "<u4", lanes * 2, at := 20 + length).astype(np.int64).reshape(2, lanes)
    words = np.concatenate([np.frombuffer(data, ">u2", offset=at + lanes * 8).astype(np.int64), [0, 0, 0]])
    slot = np.repeat(np.arange(len(model.ids), dtype=np.int32), np.diff(model.edges))
    place = np.concatenate([[0], np.cumsum(used)])[:lanes]
    code = words.take(place, mode="clip") << 32 | words.take(place + 1, mode="clip") << 16 | words.take(place + 2, mode="clip")
    place += 3
    span = np.full(lanes, 1 << 48, np.int64)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    steps = np.zeros((block, lanes), np.uint32)
    for t in range(block if lanes else 0):
        n = lanes if t < size[-1] else lanes - 1
        if not n:
            break
        co, sp, at = code[:n], span[:n], place[:n]
        p2, p1, state = model.predict(one[:n], two[:n])
        f2, known = model.f2.take(state), model.known.take(state)
        unit = sp >> T_BITS
        v = (co / unit).astype(np.int64)
        np.minimum(v, _T - 1, out=v)
        np.maximum(v, 0, out=v)  # within bounds by itself, unless the segment is damaged
        room = _T - known
        hit2, miss = v < f2, v >= known
        begin = np.where(hit2, 0, f2)
        width = np.where(hit2, f2, known - f2)
        x = np.where(hit2, p2, p1)
        new = np.flatnonzero(miss)
        known, room = known[new], room[new]
        rank = slot.take(((((v[new] - known + 1) << C_BITS) - 1) / room).astype(np.int64))
        a = room * model.edges.take(rank) >> C_BITS
        begin[new] = known + a
        width[new] = (room * model.edges.take(rank + 1) >> C_BITS) - a
        x[new] = model.ids.take(rank)
        co -= unit * begin
        np.multiply(unit, width, out=sp)
        steps[t, :n] = x
        two[:n] = one[:n]
        one[:n] = x
        small = (sp < _SMALL).astype(np.int64)
        while small.any():
            word = words.take(at, mode="clip") * small
            at += small
            small <<= 4
            co <<= small
            co += word
            sp <<= small
            small = (sp < _SMALL).astype(np.int64)
    raw = steps.T.reshape(-1)[:total].astype("<u4", copy=False) if lanes else np.zeros(0, "<u4")
    for i in range(lanes):
        if zlib.crc32(raw[i * block : i * block + size[i]].tobytes()) != crcs[i]:
            raise ValueError(f"block {i} of a token segment is damaged")
    return raw
