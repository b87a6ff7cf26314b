"""Adaptive context-mixing range coder for blocks of token ids.

Every block starts from the same empty model, so blocks decode alone and in any order. A block lists
its distinct ids first (ascending, high parts in unary, low parts packed); its ids are then places in
that list. Three predictors look at the places before the next one: order 2 and order 1 each name one
(the last successor of a context, with a confidence), order 0 gives adaptive frequencies of the list.
The share of each predictor comes from counts gathered under both confidences and whether both name the
same. One interval of the range coder says "as order 2 said", "as order 1 said", or which place order 0
has after an escape.

A block is cut into up to WAYS stretches, each with a range coder of its own, that are coded in step and
share the block's model: at every step the model says what it has learned from all of them. All stretches
of many blocks are coded in step, one numpy lane each, which is what makes it affordable in Python.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"XWRE"
HEADER = struct.Struct("<4sIIII")  # magic, ids, distinct ids, crc32 of the ids, crc32 of the payload
BLOCK = 4096
#: Stretches of a block, and least ids of one where a block has several.
WAYS, LEAST_IDS = 8, 64
SLOTS = 1 << 11
GRID_BITS = 11
GAIN, SHARE_GAIN, SHARE_LIMIT = 8, 24, 1 << 12
# three shares of a context in one number, each with those before it: order 2, order 1, escape
_FIELD = (1 << 20) - 1
_FIRST = 1 | 2 << 20 | 4 << 40
_GAINS = np.array([SHARE_GAIN * (1 | 1 << 20 | 1 << 40), SHARE_GAIN * (1 << 20 | 1 << 40), SHARE_GAIN << 40])
_HALVES = _FIELD >> 1 | (_FIELD >> 1) << 20 | (_FIELD >> 1) << 40
_STEPS = 1 | 2 << 20 | 3 << 40
# an entry is a place and a confidence of 2 bits; no block has a place BLOCK
_NOTHING = BLOCK << 2
_LEAST, _WORD = 1 << 31, (1 << 32) - 1


class _Lanes:
    """The stretches of blocks of these sizes: block and size of each lane, longest lane first."""

    def __init__(self, sizes: np.ndarray):
        ways = np.clip(sizes // LEAST_IDS, 1, WAYS)
        self.first = np.concatenate([[0], np.cumsum(ways)]).astype(np.int64)
        self.length = -(-sizes // ways)
        block = np.repeat(np.arange(len(sizes)), ways)
        way = np.arange(len(block)) - self.first[block]
        size = np.clip(sizes[block] - way * self.length[block], 0, self.length[block])
        self.order = np.argsort(-size, kind="stable")
        self.block, self.steps = block[self.order], int(size.max(initial=0))
        #: lanes that have a place at each step
        self.active = np.searchsorted(-size[self.order], -np.arange(self.steps), side="left").tolist()

    def by_step(self, rows: np.ndarray) -> np.ndarray:
        """From a row a stretch, block after block, to a column a lane."""
        return np.ascontiguousarray(rows[self.order].T)

    def by_stretch(self, columns: np.ndarray) -> np.ndarray:
        rows = np.empty(columns.shape[::-1], dtype=columns.dtype)
        rows[self.order] = columns.T
        return rows


class _Model:
    """Predictors of each block, which its lanes share; `known` is the number of distinct ids of each."""

    def __init__(self, known: np.ndarray, lanes: _Lanes):
        edges = np.concatenate([[0], np.cumsum(known)]).astype(np.int64)
        self.edges, self.block = edges, lanes.block
        self.start, self.end = edges[lanes.block], edges[lanes.block + 1]
        self.local = (np.arange(edges[-1]) - np.repeat(edges[:-1], known)).astype(np.int16)
        self.counts = np.ones(edges[-1], dtype=np.int64)
        self.sums = np.zeros(edges[-1] + 1, dtype=np.int64)
        self.by_one = np.full(edges[-1], _NOTHING, dtype=np.int16)
        self.by_two = np.full(len(known) * SLOTS, _NOTHING, dtype=np.int16)
        self.shares = np.full(len(known) * 32, _FIRST, dtype=np.int64)
        self.slots, self.states = lanes.block * SLOTS, lanes.block * 32
        self.one = np.zeros(len(lanes.block), dtype=np.int64)
        self.mark = np.zeros(len(lanes.block), dtype=np.int64)  # of the place before the last one
        self.due, self.seen = 0, []

    def refresh(self, k: int) -> bool:
        """Takes over what was counted since the last time, less and less often: frequencies of order 0, and shares that have grown large."""
        if k < self.due:
            return False
        self.due = k + max(4, k >> 1)
        if self.seen:
            np.add.at(self.counts, np.concatenate(self.seen), GAIN)
            self.seen = []
        np.cumsum(self.counts, out=self.sums[1:])
        self.base = self.sums[self.start]
        self.total = self.sums[self.end] - self.base
        full = np.flatnonzero(self.shares >> 40 > SHARE_LIMIT)
        self.shares[full] = (self.shares[full] >> 1 & _HALVES) + _STEPS
        return True

    def list_places(self) -> None:
        """For find(): each block's sums in at most 2 ** GRID_BITS equal parts, and the place in which each part begins."""
        base, total = self.sums[self.edges[:-1]], np.diff(self.sums[self.edges])
        shift = np.maximum(np.frexp(total - 1)[1] - GRID_BITS, 0).astype(np.int64)
        parts = np.where(total > 0, (total - 1 >> shift) + 1, 0)
        first, known = np.cumsum(parts) - parts, np.diff(self.edges)
        begin = self.sums[:-1] - np.repeat(base, known)
        rounding, shifts = np.repeat((1 << shift) - 1, known), np.repeat(shift, known)
        begin = (begin + rounding >> shifts) + np.repeat(first, known)
        self.parts = np.repeat(self.local, np.diff(begin, append=parts.sum()))
        self.shift, self.first = shift[self.block], first[self.block]

    def find(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where order 0 counts the place that each number below the total falls on, and the sum with it."""
        n = len(inside)
        at = self.parts.take((inside >> self.shift[:n]) + self.first[:n]) + self.start[:n]
        inside = inside + self.base[:n]
        at += self.sums.take(at + 1) <= inside
        right = self.sums.take(at + 1)
        later = np.flatnonzero(right <= inside)
        at[later] = self.sums.searchsorted(inside[later], side="right") - 1
        right[later] = self.sums.take(at[later] + 1)
        return at, right

    def predict(self, n: int):
        """Places that orders 1 and 2 name, and the upper edges of the three shares."""
        one = self.one[:n]
        self.at1 = self.start[:n] + one
        mark = one * 2654435761
        mark >>= 7
        at2 = mark * 5
        at2 ^= self.mark[:n]
        at2 &= SLOTS - 1
        at2 += self.slots[:n]
        self.at2, self.mark = at2, mark
        self.e1, self.e2 = self.by_one.take(self.at1), self.by_two.take(at2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.c1, self.c2 = self.e1 & 3, self.e2 & 3
        self.state = self.states[:n] + (self.c1 | self.c2 << 2 | (self.p1 == self.p2) << np.int16(4))
        self.share = share = self.shares.take(self.state)
        return self.p1, self.p2, share & _FIELD, share >> 20 & _FIELD, share >> 40

    def learn(self, x: np.ndarray, in1: np.ndarray, in2: np.ndarray, flag: np.ndarray, at: np.ndarray) -> None:
        """x: the places (int16), in1, in2: whether orders 1 and 2 named them, flag: the predictor of each, at: where order 0
        counts them, which it does after an escape."""
        fresh = x << 2
        for table, context, hits, hit in ((self.by_one, self.at1, self.c1, in1), (self.by_two, self.at2, self.c2, in2)):
            table[context] = hits << 1 & 3 | fresh | hit
        self.shares[self.state] = self.share + _GAINS.take(flag)
        self.seen.append(at[flag == 2])
        self.one = x.astype(np.int64)


def _list_ids(known: np.ndarray, vocabulary: int) -> bytes:
    """Ascending distinct ids: low bits as they are, high parts as gaps in unary."""
    low = (vocabulary // max(1, len(known))).bit_length() - 1
    tails = np.packbits((known[:, None] >> np.arange(low) & 1).astype(np.uint8))
    heads = np.zeros((vocabulary >> low) + len(known) + 1, dtype=np.uint8)
    heads[(known >> low) + np.arange(len(known))] = 1
    return tails.tobytes() + np.packbits(heads).tobytes()


def _listed_ids(payload: memoryview, n: int, vocabulary: int) -> tuple[np.ndarray, int]:
    """The ids that _list_ids wrote, and the bytes they took."""
    low = (vocabulary // max(1, n)).bit_length() - 1
    split = (n * low + 7) // 8
    size = split + ((vocabulary >> low) + n + 8) // 8
    bits = np.unpackbits(np.frombuffer(payload[:split], dtype=np.uint8), count=n * low).reshape(n, low)
    tails = bits @ (1 << np.arange(low)) if low else 0
    heads = np.flatnonzero(np.unpackbits(np.frombuffer(payload[split:size], dtype=np.uint8)))
    return (heads - np.arange(n) << low) + tails, size


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block of at most BLOCK ids (uint32, below vocabulary) as header and payload."""
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    if sizes.max(initial=0) > BLOCK:
        raise ValueError(f"a block holds more than {BLOCK} ids")
    lanes, known = _Lanes(sizes), []
    count = len(lanes.block)
    rows = np.zeros((count, lanes.steps), dtype=np.int16)
    seen, rank = np.zeros(-(-vocabulary // 8) * 8, dtype=bool), np.zeros(vocabulary, dtype=np.int16)
    for ids, a, b, length in zip(blocks, lanes.first, lanes.first[1:], lanes.length):
        seen[ids] = True
        # eight flags at a time, as few are set
        some = np.flatnonzero(seen.view(np.uint64))
        near = np.flatnonzero(seen.reshape(-1, 8)[some])
        known.append(some[near >> 3] * 8 + (near & 7))
        rank[known[-1]] = np.arange(len(known[-1]))
        mine = np.zeros((b - a) * length, dtype=np.int16)
        mine[:len(ids)] = rank[ids]
        rows[a:b, :length] = mine.reshape(b - a, length)
        seen[known[-1]] = False
    places = lanes.by_step(rows)
    model = _Model(np.array([len(k) for k in known], dtype=np.int64), lanes)
    # a row a word, as the lanes are at about the same word
    words = np.zeros((2 * lanes.steps + 1, count), dtype=np.int64)
    flat, place = words.reshape(-1), np.arange(count)
    low, width = np.zeros(count, dtype=np.uint64), np.full(count, (1 << 63) - 1, dtype=np.int64)
    for k, n in enumerate(lanes.active):
        model.refresh(k)
        x = places[k, :n]
        p1, p2, edge2, edge1, edge = model.predict(n)
        in2, in1 = p2 == x, p1 == x
        flag = np.where(in2, 0, 2 - in1)
        total, at = model.total[:n], model.start[:n] + x
        step = width[:n] // (edge * total)
        first, second, rest, left = edge2 * total, edge1 * total, edge - edge1, model.sums.take(at)
        from_ = np.where(in2, 0, np.where(in1, first, second + rest * (left - model.base[:n])))
        size = np.where(in2, first, np.where(in1, second - first, rest * (model.sums.take(at + 1) - left)))
        low[:n] += (from_ * step).view(np.uint64)
        width[:n] = size * step
        short = np.flatnonzero(width[:n] < _LEAST)
        settled = low[short]
        # 32 bits and, above them, what is to be carried into the words before
        flat[place[short]] = (settled >> np.uint64(31)).view(np.int64)
        place[short] += count
        low[short] = (settled & np.uint64(_LEAST - 1)) << np.uint64(32)
        width[short] <<= 32
        model.learn(x, in1, in2, flag, at)
    # the last word names a number inside the interval; what follows is read as zeros
    flat[place] = (low + np.uint64(_LEAST - 1) >> np.uint64(31)).view(np.int64)
    used = place // max(count, 1) + 1
    words = words[:used.max(initial=0)]
    while (carry := words >> 32).any():
        words &= _WORD
        words[:-1] += carry[1:]
    used = lanes.by_stretch(used[None])[:, 0]
    words = lanes.by_stretch(words.astype("<u4"))
    out = []
    for ids, listed, a, b in zip(blocks, known, lanes.first, lanes.first[1:]):
        payload = _list_ids(listed, vocabulary) + used[a:b].astype("<u2").tobytes() + b"".join(w[:u].tobytes() for w, u in zip(words[a:b], used[a:b]))
        out.append(HEADER.pack(MAGIC, len(ids), len(listed), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload)) + payload)
    return out


def decode_blocks(coded: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block; raises if a header, a payload or the decoded ids fail their check."""
    heads = []
    for c in coded:
        magic, n, distinct, ids_crc, payload_crc = HEADER.unpack_from(c)
        if magic != MAGIC or zlib.crc32(memoryview(c)[HEADER.size:]) != payload_crc:
            raise ValueError("damaged block")
        heads.append((n, distinct, ids_crc))
    lanes = _Lanes(np.array([n for n, _, _ in heads], dtype=np.int64))
    count, known, used, held = len(lanes.block), [], [], []
    for c, (_, distinct, _), ways in zip(coded, heads, np.diff(lanes.first).tolist()):
        payload = memoryview(c)[HEADER.size:]
        ids, size = _listed_ids(payload, distinct, vocabulary)
        known.append(ids)
        used.append(np.frombuffer(payload[size:size + 2 * ways], dtype="<u2"))
        held.append(np.frombuffer(payload[size + 2 * ways:], dtype="<u4"))
    used = np.concatenate([np.zeros(0, dtype="<u2"), *used])
    by_stretch = np.zeros((count, int(used.max(initial=0)) + 2), dtype="<u4")
    by_stretch[np.arange(by_stretch.shape[1]) < used[:, None]] = np.concatenate([np.zeros(0, dtype="<u4"), *held])
    words = lanes.by_step(by_stretch)
    del by_stretch, held
    ahead = words[:2].astype(np.int64)
    code, width = ahead[0] << 31 | ahead[1] >> 1, np.full(count, (1 << 63) - 1, dtype=np.int64)
    # the low bit of a lane's second word stands before its third
    bit, place, words = ahead[1] & 1, np.arange(count) + 2 * count, words.reshape(-1)
    model = _Model(np.array([len(ids) for ids in known], dtype=np.int64), lanes)
    places = np.zeros((lanes.steps, count), dtype=np.int16)
    for k, n in enumerate(lanes.active):
        if model.refresh(k):
            model.list_places()
        p1, p2, edge2, edge1, edge = model.predict(n)
        total = model.total[:n]
        step = width[:n] // (edge * total)
        target = code[:n] // step
        first, second = edge2 * total, edge1 * total
        in2, in1 = target < first, target < second
        flag = 2 - in1 - in2.astype(np.int64)
        rest, base = edge - edge1, model.base[:n]
        # what the divisions leave over belongs to no place, nor does what lies before the escape
        at, right = model.find(np.minimum(np.maximum(target - second, 0) // rest, total - 1))
        left = model.sums.take(at)
        from_ = np.where(in2, 0, np.where(in1, first, second + rest * (left - base)))
        size = np.where(in2, first, np.where(in1, second - first, rest * (right - left)))
        x = np.where(in2, p2, np.where(in1, p1, (at - model.start[:n]).astype(np.int16)))
        code[:n] -= from_ * step
        width[:n] = size * step
        short = np.flatnonzero(width[:n] < _LEAST)
        word = words.take(place[short]).astype(np.int64)
        code[short] = code[short] << 32 | bit[short] << 31 | word >> 1
        bit[short] = word & 1
        place[short] += count
        width[short] <<= 32
        model.learn(x, p1 == x, p2 == x, flag, at)
        places[k, :n] = x
    rows, out = lanes.by_stretch(places), []
    for ids, (n, _, crc), a, b, length in zip(known, heads, lanes.first, lanes.first[1:], lanes.length):
        got = ids[rows[a:b, :length].reshape(-1)[:n]].astype(np.uint32)
        if zlib.crc32(got.astype("<u4").tobytes()) != crc:
            raise ValueError("decoded ids differ from the encoded ones")
        out.append(got)
    return out


def shift_crc32(crcs: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What byte strings with these crc32 give to that of a whole in which so many bytes stand behind each: their exclusive or is its crc32."""
    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # product modulo the CRC polynomial, bit-reversed
        out = np.zeros_like(a)
        for k in range(31, -1, -1):
            out ^= np.where(a >> k & 1, b, 0)
            b = b >> 1 ^ np.where(b & 1, 0xEDB88320, 0)
        return out

    out, rest = crcs.astype(np.int64), behind.astype(np.int64)
    square = np.array([0x00800000])  # x ** 8
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = times(out[odd], np.repeat(square, len(odd)))
        square = times(square, square)
        rest >>= 1
    return out
