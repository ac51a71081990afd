"""Adaptive context-mixing range coder for blocks of token ids.

A block names its ids by rank (order of first appearance).  First come its
distinct ids, then one rank after the other:

* the two ids before (order 2, else the one before: order 1) predict an id;
  the chance that it comes is a mix of three estimates: how often order-2
  predictions of that confidence came true, the same for order 1, and the
  share of the id in the block so far (order 0).  Weights and estimates move
  with every id;
* an id that was not predicted is coded by the order-0 counts of the block so
  far, with room for an id not seen yet.

All choices narrow one 48-bit arithmetic coder that sends 16 bits at a time.

Blocks are coded side by side: a block is one lane of every array operation
and has counts, weights and coder of its own, so its bytes do not depend on
its neighbours and it can be decoded alone.  Everything is integer arithmetic
or single float operations of fixed order, so encoder and decoder agree on
every machine.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 15
ONE = 1 << BITS
LANES = 2048                  # blocks side by side
GROUP, SHIFT = 16, 4          # ranks under one partial sum
PAIR_BITS = 11                # slots for two ids before, a lane
SURE = 7                      # highest confidence
KEEP, REST = np.float32(0.98), np.float32(0.02 / 3)
HEAD = np.dtype([("n", "<u4"), ("known", "<u4"), ("words", "<u4"), ("crc", "<u4")])  # crc: of the ids
SEAL = np.dtype("<u4")        # CRC-32 of all that follows it
_FIRST_GUESS = np.array([0, 8, 14, 18, 21, 24, 26, 28]) * ONE // 32  # chance by confidence, to begin with
# change of an entry by confidence and whether its prediction came
_MOVE = np.array([v for c in range(SURE + 1) for v in ((c >> 1) - c, int(c < SURE))], np.int64)
_ZERO, _UBITS, _U16, _U32 = (np.uint64(x) for x in (0, BITS, 16, 32))
_LEAST, _LOW32, _MASK48 = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 48) - 1)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


class Writer:
    """Arithmetic encoder of n lanes; ``low`` and ``span`` are narrowed by the
    caller on the first m lanes, then ``send`` sends what is settled."""

    def __init__(self, n: int, words: int):
        self.low, self.span = np.zeros(n, np.uint64), np.full(n, 1 << 48, np.uint64)
        self.sent, self.words = np.zeros(n, np.int64), np.zeros((n, words), np.uint32)

    def put(self, start: np.ndarray, count: np.ndarray, unit: np.ndarray) -> None:
        m = len(unit)
        self.low[:m] += start.astype(np.uint64) * unit
        self.span[:m] = unit * count.astype(np.uint64)
        self.send(m)

    def room(self, most: int) -> None:
        """Make sure that ``most`` more words fit."""
        if (short := int(self.sent.max(initial=0)) + most - self.words.shape[1]) > 0:
            more = max(short, self.words.shape[1] // 4)
            self.words = np.concatenate((self.words, np.zeros((len(self.words), more), np.uint32)), axis=1)

    def send(self, m: int) -> None:
        low, span = self.low[:m], self.span[:m]
        over = (low > _MASK48).nonzero()[0]
        if len(over):
            self.words[over, self.sent[over] - 1] += 1
            low[over] &= _MASK48
        while len(full := (span < _LEAST).nonzero()[0]):
            rest, at = low[full], self.sent[full]
            self.words[full, at] = rest >> _U32
            self.sent[full] = at + 1
            low[full] = (rest & _LOW32) << _U16
            span[full] <<= _U16

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        lane = np.arange(len(self.sent))
        for k in (32, 16, 0):
            self.words[lane, self.sent] = (self.low >> np.uint64(k)) & np.uint64(0xFFFF)
            self.sent += 1
        for col in range(int(self.sent.max()) - 1, 0, -1):  # carries to the word before
            self.words[:, col - 1] += self.words[:, col] >> np.uint32(16)
        return self.words.astype("<u2"), self.sent


class Reader:
    """Arithmetic decoder of n lanes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.last = words, words.shape[1] - 1
        self.code = (words[:, 0] << _U32) | (words[:, 1] << _U16) | words[:, 2]
        self.span, self.read = np.full(n, 1 << 48, np.uint64), np.full(n, 3, np.int64)

    def at(self, unit: np.ndarray, total) -> np.ndarray:
        """Where the code lies among ``total`` counts."""
        return np.minimum((self.code[:len(unit)] // unit).astype(np.int64), total - 1)

    def take(self, start: np.ndarray, count: np.ndarray, unit: np.ndarray) -> None:
        m = len(unit)
        self.code[:m] -= start.astype(np.uint64) * unit
        self.span[:m] = unit * count.astype(np.uint64)
        self.fill(m)

    def fill(self, m: int) -> None:
        code, span = self.code[:m], self.span[:m]
        while len(full := (span < _LEAST).nonzero()[0]):
            at = self.read[full]
            code[full] = (code[full] << _U16) | self.words[full, np.minimum(at, self.last)]
            self.read[full] = at + 1
            span[full] <<= _U16


class _Ids:
    """Model of the distinct ids: adaptive counts of their bit lengths after
    the bit length before, then even bits."""

    def __init__(self, n: int, bits: int):
        self.k = bits + 1
        self.count = np.ones((n, self.k, self.k), np.int64)
        self.before = np.zeros(n, np.int64)
        self.lane = np.arange(n)

    def row(self, m: int):
        counts = self.count[self.lane[:m], self.before[:m]]
        return np.concatenate((np.zeros((m, 1), np.int64), np.cumsum(counts, axis=1)), axis=1)

    def learn(self, size: np.ndarray) -> None:
        m = len(size)
        self.count[self.lane[:m], self.before[:m], size] += 8
        self.before[:m] = size


class _Ranks:
    """Order-0 counts, predictions of orders 1 and 2, and their mix."""

    def __init__(self, n: int, most: int):
        self.groups = -(-(most + 1) // GROUP)
        self.groups += -self.groups % 8
        self.width = self.groups * GROUP
        self.count = np.zeros((n * self.groups, GROUP), np.int32)     # [lane, group][rank in it]
        self.flat = self.count.reshape(-1)
        self.sums = np.zeros((n, self.groups), np.int32)              # of all groups up to each
        self.number = np.arange(self.groups, dtype=np.int16)
        slots = self.width + (1 << PAIR_BITS)
        self.pred = np.zeros(n * slots, np.int32)                     # prediction << 3 | confidence
        self.true = np.tile(_FIRST_GUESS, 2 * n)                      # [lane][order][confidence]
        self.weight = np.full((3, n * 4), 1.0 / 3.0, np.float32)
        self.lane = np.arange(n, dtype=np.int64)
        self.slot = np.stack((self.lane * slots, self.lane * slots + self.width))
        self.cell = np.stack((self.lane * 16, self.lane * 16 + 8))
        self.ctx = np.zeros((2, n), np.int64)                         # the last rank; hash of the last two
        self.known = np.zeros(n, np.int64)

    def guess(self, t: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(predicted rank, its chance in 1 / ONE)."""
        self.at = self.slot[:, :m] + self.ctx[:, :m]
        self.entry = self.pred.take(self.at)
        self.p, self.c = self.entry >> 3, self.entry & 7
        self.at_true = self.cell[:, :m] + self.c
        self.q = self.true.take(self.at_true)
        (p1, p2), (c1, c2) = self.p, self.c
        has2 = c2 > 0
        self.cand = np.where(has2, p2, p1)
        agree = (p1 == self.cand) & (c1 > 0)
        self.situation = self.lane[:m] * 4 + (has2.view(np.int8) * 2 + agree)
        est = np.empty((3, m), np.float32)
        est[0] = self.flat.take(self.lane[:m] * self.width + self.cand)
        est[0] *= np.float32(ONE / (t + 1.0))
        est[1] = np.where(agree, self.q[0], est[0])
        est[2] = np.where(has2, self.q[1], est[0])
        self.est, self.w = est, self.weight.take(self.situation, axis=1)
        part = self.w * est
        mixed = part[0] + part[1]
        mixed += part[2]
        np.maximum(mixed, np.float32(24), out=mixed)
        np.minimum(mixed, np.float32(ONE - 24), out=mixed)
        return self.cand, mixed.astype(np.uint64)

    def inner(self, g: np.ndarray) -> np.ndarray:
        """Running counts inside group ``g`` of each lane."""
        return np.cumsum(self.count.take(self.lane[:len(g)] * self.groups + g, axis=0), axis=1, dtype=np.int32)

    def learn(self, s: np.ndarray, hit: np.ndarray) -> None:
        m = len(s)
        lane = self.lane[:m]
        post = np.where(hit, self.est, np.float32(ONE) - self.est)
        post += np.float32(1)
        post *= self.w
        post *= KEEP / (post[0] + post[1] + post[2])
        post += REST
        for k in range(3):
            self.weight[k][self.situation] = post[k]
        came = self.p == s
        self.true[self.at_true] = self.q + ((came * np.int64(ONE) - self.q) >> 5)
        self.pred[self.at] = np.where((self.c < 2) & ~came, (s << 3) + 1, self.entry + _MOVE.take(self.c * 2 + came))
        self.flat[lane * self.width + s] += 1
        self.sums[:m] += self.number >= (s >> SHIFT).astype(np.int16)[:, None]
        a = self.ctx[0, :m]
        self.ctx[1, :m] = ((s * 40503 + a * 60493) >> 3) & ((1 << PAIR_BITS) - 1)
        self.ctx[0, :m] = s
        self.known[:m] += s == self.known[:m]


def _above(running: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each lane's running counts are at most ``at``."""
    flags = (running <= at[:, None]).view(np.uint64)
    ones = np.bitwise_count(flags)
    return ones.sum(1, dtype=np.int64) if ones.shape[1] > 4 else sum(ones[:, k].astype(np.int64) for k in range(ones.shape[1]))


def _lengths(size: np.ndarray):
    """Lanes in order of falling size, and how many are active at each step."""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")


def encode(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """Bytes of each block of ids (all below ``vocab``)."""
    out: list[bytes] = []
    for lo in range(0, len(blocks), LANES):
        out += _encode(blocks[lo:lo + LANES], max(int(vocab) - 1, 1).bit_length())
    return out


def _ranks_of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order of first appearance, rank of each id)."""
    ids, first, back = np.unique(block, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return ids[order].astype(np.int64), rank[back].astype(np.int32)


def _encode(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    n = len(blocks)
    size = np.array([len(b) for b in blocks], np.int64)
    order, active = _lengths(size)
    longest = len(active)
    split = [_ranks_of(blocks[k]) for k in order]
    known = np.array([len(ids) for ids, _ in split], np.int64)
    ranks = np.zeros((longest, n), np.int32)
    for lane, (_, r) in enumerate(split):
        ranks[:len(r), lane] = r
    out = Writer(n, longest * 5 // 8 + 64)

    by_known, some = _lengths(known)  # the distinct ids, most first
    names = np.zeros((len(some), n), np.int64)
    for at, lane in enumerate(by_known):
        names[:known[lane], at] = split[lane][0]
    first = Writer(n, 2 * len(some) + 16)
    model = _Ids(n, bits)
    for k in range(len(some)):
        m = int(some[k])
        v = names[k, :m]
        length = np.frexp(v.astype(np.float64))[1].astype(np.int64)
        row, lane = model.row(m), model.lane[:m]
        start, end = row[lane, length], row[lane, length + 1]
        first.put(start, end - start, first.span[:m] // row[:, -1].astype(np.uint64))
        rest = np.maximum(length - 1, 0)
        first.put(v - ((v > 0).astype(np.int64) << rest), np.ones(m, np.int64), first.span[:m] >> rest.astype(np.uint64))
        model.learn(length)
    names_words, names_sent = first.close()
    at_name = np.empty(n, np.int64)
    at_name[by_known] = np.arange(n)

    model = _Ranks(n, int(known.max(initial=0)))
    for t in range(longest):
        m = int(active[t])
        if t % 16 == 0:
            out.room(64)  # an id takes three words at most
        s, lane = ranks[t, :m].astype(np.int64), model.lane[:m]
        low, span = out.low[:m], out.span[:m]
        cand, chance = model.guess(t, m)
        hit = cand == s
        first_part = (span >> _UBITS) * chance
        seen = model.known[:m]
        room = np.where(seen < known[:m], seen + 1, 0)
        g, r = s >> SHIFT, s & (GROUP - 1)
        start = np.where(g > 0, model.sums[lane, g - 1], 0) + np.where(r > 0, model.inner(g)[lane, r - 1], 0)
        fresh = s == seen
        start = np.where(fresh, t, start)
        count = np.where(fresh, room, model.flat.take(lane * model.width + s))
        unit = (span - first_part) // np.maximum(t + room, 1).astype(np.uint64)
        low += np.where(hit, _ZERO, first_part + start.astype(np.uint64) * unit)
        span[:] = np.where(hit, first_part, count.astype(np.uint64) * unit)
        out.send(m)
        model.learn(s, hit)
    out.room(8)
    words, sent = out.close()
    result: list[bytes] = [b""] * n
    for lane, k in enumerate(order):
        at = at_name[lane]
        head = np.array([(size[k], known[lane], names_sent[at], checksum(blocks[k]))], HEAD)
        body = head.tobytes() + names_words[at, :names_sent[at]].tobytes() + words[lane, :sent[lane]].tobytes()
        result[k] = np.array([zlib.crc32(body)], SEAL).tobytes() + body
    return result


def decode(blocks: list[bytes], vocab: int) -> list[np.ndarray]:
    """Ids of each block; a block that does not fit its checksum is an error."""
    out: list[np.ndarray] = []
    for lo in range(0, len(blocks), LANES):
        out += _decode(blocks[lo:lo + LANES], max(int(vocab) - 1, 1).bit_length())
    return out


def _matrix(parts: list[np.ndarray]) -> np.ndarray:
    words = np.zeros((len(parts), max(3, *map(len, parts)) + 1), np.uint64)
    for i, p in enumerate(parts):
        words[i, :len(p)] = p
    return words


def _decode(blocks: list[bytes], bits: int) -> list[np.ndarray]:
    n = len(blocks)
    sealed, blocks = blocks, [b[SEAL.itemsize:] for b in blocks]
    for seal, b in zip(sealed, blocks):
        if len(b) < HEAD.itemsize or zlib.crc32(b) != int(np.frombuffer(seal, SEAL, 1)[0]):
            raise ValueError("block is damaged or cut short")
    heads = [np.frombuffer(b, HEAD, 1)[0] for b in blocks]
    body = [np.frombuffer(b, "<u2", offset=HEAD.itemsize) for b in blocks]
    size = np.array([int(h["n"]) for h in heads], np.int64)
    order, active = _lengths(size)
    longest = len(active)
    known = np.array([int(heads[k]["known"]) for k in order], np.int64)

    by_known, some = _lengths(known)
    first = Reader(_matrix([body[order[lane]][:heads[order[lane]]["words"]] for lane in by_known]))
    names = np.zeros((n, len(some) + 1), np.uint32)
    model = _Ids(n, bits)
    for k in range(len(some)):
        m = int(some[k])
        row, lane = model.row(m), model.lane[:m]
        unit = first.span[:m] // row[:, -1].astype(np.uint64)
        length = (row[:, 1:] <= first.at(unit, row[:, -1])[:, None]).sum(1)
        start, end = row[lane, length], row[lane, length + 1]
        first.take(start, end - start, unit)
        rest = np.maximum(length - 1, 0)
        unit = first.span[:m] >> rest.astype(np.uint64)
        v = first.at(unit, np.int64(1) << rest)
        first.take(v, np.ones(m, np.int64), unit)
        names[by_known[:m], k] = v + (np.minimum(length, 1) << rest)
        model.learn(length)

    src = Reader(_matrix([body[k][heads[k]["words"]:] for k in order]))
    model = _Ranks(n, int(known.max(initial=0)))
    ranks = np.zeros((longest, n), np.int32)
    for t in range(longest):
        m = int(active[t])
        lane = model.lane[:m]
        code, span = src.code[:m], src.span[:m]
        cand, chance = model.guess(t, m)
        first_part = (span >> _UBITS) * chance
        hit = code < first_part
        seen = model.known[:m]
        room = np.where(seen < known[:m], seen + 1, 0)
        total = np.maximum(t + room, 1)
        unit = (span - first_part) // total.astype(np.uint64)
        at = np.minimum(((code - first_part) // unit).astype(np.int64), total - 1)
        upto = model.sums[:m]
        g = np.minimum(_above(upto, at), model.groups - 1)
        below = np.where(g > 0, upto[lane, g - 1], 0)
        inner = model.inner(g)
        r = np.minimum(_above(inner, at - below), GROUP - 1)
        fresh = at >= t
        s = np.where(hit, cand, np.where(fresh, seen, g * GROUP + r))
        start = np.where(fresh, t, below + np.where(r > 0, inner[lane, r - 1], 0))
        count = np.where(fresh, room, model.flat.take(lane * model.width + s))
        code -= np.where(hit, _ZERO, first_part + start.astype(np.uint64) * unit)
        span[:] = np.where(hit, first_part, count.astype(np.uint64) * unit)
        src.fill(m)
        model.learn(s, hit)
        ranks[t, :m] = s
    result: list[np.ndarray] = [names[0, :0]] * n
    for lane, k in enumerate(order):
        got = names[lane].take(ranks[:size[k], lane], mode="clip")
        if checksum(got) != int(heads[k]["crc"]):
            raise ValueError("block does not fit its checksum")
        result[k] = got
    return result
