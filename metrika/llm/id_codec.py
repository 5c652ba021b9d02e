"""Token-id files: a context-mixing range coder over checksummed blocks in frames.

A frame of up to LANES blocks of up to BLOCK ids begins with tables: its ids by falling number,
their shares (slots), and the models' weights. Ids are coded by their ranks in the first. For
each id three models predict: order 2 and order 1 each put all their probability on the id that
followed the last two ids, or the last one, in the block so far; order 0 is the distribution of
the frame's ids. The three distributions are mixed: an id's interval is its order-0 share times
that model's weight, widened by the weights of the other models that name it, wherever it stands
in the order. The weights are those of the pair of confidences of the two naming models and of
whether they name the same id; they are how often such models named the id that came, over the
frame. A 64-bit range coder writes 32-bit words.

Blocks of a frame need its tables but not each other, so numpy codes many at once, one lane each,
all in integers. What the models say depends on the ids alone, so a writer finds it for whole
blocks, by sorting places by context; only the coder's ranges go id by id, and the code is the
sum of what they leave out. A reader learns id by id what follows a context. Ids must be below
65,536.

File: MAGIC; frames (bytes and crc32 of the tables, the tables by zlib, then blocks: n ids, bytes,
crc32 of the bytes, crc32 of the ids, and the code's words from the highest); the index (zlib:
documents' ids and numbers of ids; blocks' numbers of ids and bytes; frames' tables' bytes); a
trailer (index's offset, bytes, crc32, MAGIC). All frames but the last have LANES blocks. The
index lets a reader begin at any block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"MIDC4\n"
BLOCK = 8192
LANES = 2048  # of a frame, at most; that a reader decodes at once
_WIDE = 512  # lanes whose ranges a writer follows at once
_SHARE = 17  # bits of order-0 slots, of which every id of a frame has one at least
_WEIGHT = 12  # bits of weights
_BITS = _SHARE + _WEIGHT  # of an interval
_STATES = 32  # the models' confidences (2 bits each), and whether they agree
_CONTEXTS = 4096  # of ids that order 1 and order 2 keep, by hash
_GROUP = 32  # lanes whose models a writer finds at once
_PLACE = BLOCK.bit_length() - 1  # bits of a place in a block
_HEAD = struct.Struct("<IIII")
_FRAME = struct.Struct("<II")
_TAIL = struct.Struct("<QII6s")
U = np.uint64


def _context2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order 2's context of the last id and the one before (uint32)."""
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(20)


def _followers(ids: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lane, place]: the id that came after a place's context last, and a confidence: 0 new, 1 to 3 by how often it came again."""
    lanes, n = ids.shape
    keys = np.sort(context << np.uint32(_PLACE) | np.arange(n, dtype=np.uint32), axis=1)
    at = (keys & np.uint32(BLOCK - 1)).astype(np.int64) + np.arange(lanes)[:, None] * n
    own = ids.ravel().take(at)
    keys >>= np.uint32(_PLACE)
    same = np.zeros((lanes, n), bool)
    same[:, 1:] = keys[:, 1:] == keys[:, :-1]
    named = np.zeros((lanes, n), np.int32)
    named[:, 1:] = own[:, :-1]
    named *= same
    hit = same & (named == own)
    sure = same.astype(np.int32)
    sure[:, 1:] += hit[:, :-1]
    sure[:, 2:] += hit[:, :-2] & hit[:, 1:-1]
    sure *= same
    out = np.empty(lanes * n, np.int32)
    out[at.ravel()] = (named | sure << 16).ravel()
    out = out.reshape(lanes, n)
    return out & 0xFFFF, out >> 16


class Tables:
    """A frame's ids by rank, each one's first slot and slots, and order 2's and order 1's weights by state."""

    told2, told1 = np.arange(_STATES) >> 3 > 0, (np.arange(_STATES) >> 1 & 3) > 0  # a new context says nothing

    def __init__(self, ids: np.ndarray, slots: np.ndarray, two: np.ndarray, one: np.ndarray):
        self.ids, self.slots = ids, slots.astype(np.int32)
        self.first = (np.cumsum(self.slots) - self.slots).astype(np.int32)
        self.weigh(two, one)

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Tables:
        """Order 0 of all ids of a frame; the weights are nothing yet."""
        count = np.zeros(1 << 16, np.int64)
        for lo in range(0, len(blocks), _GROUP):
            count += np.bincount(np.concatenate(blocks[lo : lo + _GROUP]), minlength=len(count))
        own = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        count = count[own]
        slots = 1 + count * ((1 << _SHARE) - len(own)) // max(1, count.sum())
        slots[:1] += (1 << _SHARE) - slots.sum()
        return cls(own.astype(np.uint16), slots, np.zeros(_STATES, int), np.zeros(_STATES, int))

    def weigh(self, two: np.ndarray, one: np.ndarray) -> None:
        self.two, self.one = two.astype(np.int32), one.astype(np.int32)
        self.rest = (1 << _WEIGHT) - self.two - self.one

    def count(self, seen: np.ndarray) -> None:
        """seen [order 2 named the id that came, or else order 1 did, or else none; state]: how often."""
        n = seen.sum(axis=0) + 2
        # a model that names an id gives it something, as the frame may have it nowhere else
        two = np.clip(((seen[0] << _WEIGHT) + 512) // n, 1, 3700) * self.told2
        self.weigh(two, np.clip(((seen[1] << _WEIGHT) + 512) // n, 1, 3960 - two) * self.told1)

    def ranks(self) -> np.ndarray:
        """[id]: its rank."""
        out = np.zeros(1 << 16, np.uint16)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def pack(self) -> bytes:
        return zlib.compress(b"".join(x.tobytes() for x in (self.two.astype("<u2"), self.one.astype("<u2"), self.ids.astype("<u2"), self.slots.astype("<u4"))))

    @classmethod
    def unpack(cls, data: bytes) -> Tables:
        data = zlib.decompress(data)
        n = (len(data) - 4 * _STATES) // 6
        two, one = np.frombuffer(data, "<u2", 2 * _STATES).reshape(2, -1)
        return cls(np.frombuffer(data, "<u2", n, 4 * _STATES), np.frombuffer(data, "<u4", n, 4 * _STATES + 2 * n), two, one)


def _named(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lane, place]: what the models name (order 2's | order 1's << 16), and their state."""
    a, b = np.zeros((2, *ranks.shape), np.uint32)
    a[:, 1:], b[:, 2:] = ranks[:, :-1], ranks[:, :-2]
    id1, c1 = _followers(ranks, a & np.uint32(_CONTEXTS - 1))
    id2, c2 = _followers(ranks, _context2(a, b))
    return (id2 | id1 << 16).view(np.uint32), (c2 << 3 | c1 << 1 | (id1 == id2)).astype(np.uint8)


def _events(ranks: np.ndarray, named: np.ndarray, state: np.ndarray) -> np.ndarray:
    """How often, by state, order 2 named the id that came, or else order 1 did, or else none."""
    hit2, hit1 = (named & 0xFFFF == ranks) & Tables.told2[state], (named >> 16 == ranks) & Tables.told1[state]
    kind = np.where(hit2, 0, np.where(hit1, _STATES, 2 * _STATES)).astype(np.uint8) + state
    return np.bincount(kind.ravel(), minlength=3 * _STATES).reshape(3, _STATES)


def _intervals(tables: Tables, ranks: np.ndarray, named: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size): what stands before an id, and all that the mixed models give it."""
    id2, id1 = (named & 0xFFFF).astype(np.int32), (named >> 16).astype(np.int32)
    at, at2, at1 = tables.first.take(ranks), tables.first.take(id2), tables.first.take(id1)
    f2, f1, rest = (tables.two << _SHARE).take(state), (tables.one << _SHARE).take(state), tables.rest.take(state)
    begin = at * rest + f2 * (at2 < at) + f1 * (at1 < at)
    return begin, tables.slots.take(ranks) * rest + f2 * (id2 == ranks) + f1 * (id1 == ranks)


def _ranges(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[place, lane] of sizes out of 1 << _BITS: what a slot of each is worth, and whether a word is written after it."""
    worth, due = np.empty(size.shape, U), np.empty(size.shape, bool)
    left, short, word = np.full(size.shape[1], 2**64 - 1, U), U(1 << 32), U(32)
    for r, n, d in zip(worth, size, due):
        np.right_shift(left, U(_BITS), out=r)
        np.multiply(r, n, out=left)
        np.less(left, short, out=d)
        np.left_shift(left, word, out=left, where=d)
    return worth, due


def _words(added: np.ndarray, due: np.ndarray) -> list[bytes]:
    """The code of each lane: the sum of `added` [lane, place], a word lower after each that is due."""
    first = np.ones(due.shape, bool)
    first[:, 1:] = due[:, :-1]
    lane_words = first.sum(axis=1) + 1
    ends = np.cumsum(lane_words)
    starts, mask, word = np.flatnonzero(first.ravel()), U(0xFFFFFFFF), U(32)
    added = added.ravel()
    high = np.arange(len(starts)) + np.repeat(np.arange(len(ends)), lane_words - 1)
    words = np.zeros(int(ends[-1]), U)
    words[high] = np.add.reduceat(added >> word, starts)
    words[high + 1] += np.add.reduceat(added & mask, starts)
    while True:
        carry = words >> word
        if not carry.any():
            break
        words &= mask
        words[:-1] += carry[1:]  # a lane's first word has none
    words = words.astype("<u4")
    return [words[e - n : e].tobytes() for e, n in zip(ends.tolist(), lane_words.tolist())]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """A frame's tables, then the bytes of each block (uint16 ids, any lengths up to BLOCK; shorter ones are padded within their lane)."""
    lanes, steps = len(blocks), max(map(len, blocks))
    tables = Tables.of(blocks)
    rank_of = tables.ranks()
    ranks, named, state = np.zeros((lanes, steps), np.uint16), np.empty((lanes, steps), np.uint32), np.empty((lanes, steps), np.uint8)
    seen = np.zeros((3, _STATES), np.int64)
    for i, b in enumerate(blocks):
        ranks[i, : len(b)] = rank_of.take(b)
    for lo in range(0, lanes, _GROUP):
        g = slice(lo, lo + _GROUP)
        named[g], state[g] = _named(ranks[g].astype(np.int32))
        seen += _events(ranks[g], named[g], state[g])
    tables.count(seen)
    out = [tables.pack()]
    for lo in range(0, lanes, _WIDE):
        n = min(_WIDE, lanes - lo)
        begin, size = np.empty((n, steps), np.uint32), np.empty((steps, n), np.uint32)
        for at in range(0, n, _GROUP):
            own, g = slice(at, min(at + _GROUP, n)), slice(lo + at, min(lo + at + _GROUP, lo + n))
            begin[own], sizes = _intervals(tables, ranks[g].astype(np.int32), named[g], state[g])
            size[:, own] = sizes.T
        worth, due = _ranges(size)
        for at in range(0, n, _GROUP):
            own = slice(at, at + _GROUP)
            out += _words(np.ascontiguousarray(worth[:, own].T) * begin[own], np.ascontiguousarray(due[:, own].T))
    return out


def decode(parts: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Blocks of encode(): parts are a frame's tables, then the bytes of any of its blocks."""
    tables, parts = Tables.unpack(parts[0]), parts[1:]
    lanes, steps = len(parts), max(sizes)
    # the lanes' words, one lane's after another's; words of 0 follow the last
    words = np.frombuffer(b"".join(p + bytes(8) for p in parts), "<u4")
    at_word = np.cumsum([2] + [len(p) // 4 + 2 for p in parts])[:-1]
    code, left = words[at_word - 2].astype(U) << U(32) | words[at_word - 1], np.full(lanes, 2**64 - 1, U)

    ranks = np.zeros((steps, lanes), np.uint16)
    of_slot = np.repeat(np.arange(len(tables.ids), dtype=np.uint16), tables.slots)
    first, slots, rests = tables.first, tables.slots, tables.rest
    two, one = tables.two << _SHARE, tables.one << _SHARE
    # rows 0 and 1 are of order 2 and order 1; what came last [row, context, lane]: rank | confidence << 16
    last = np.zeros(2 * _CONTEXTS * lanes, np.int32)
    base = np.arange(2)[:, None] * (_CONTEXTS * lanes) + np.arange(lanes)
    key, was = base.copy(), np.zeros(lanes, np.uint32)
    most, short, bits, word = U((1 << _BITS) - 1), U(1 << 32), U(_BITS), U(32)
    by_last, by_both, top = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(20)
    context = np.empty((2, lanes), np.uint32)
    for t in range(steps):
        e = last.take(key)
        named = e & 0xFFFF
        e >>= 16
        state = e[0] << 3
        state |= e[1] << 1
        state += named[0] == named[1]
        state = state.astype(np.int64)
        f, rest = np.array([two[state], one[state]]), rests[state]
        place = first.take(named)
        begins = place * rest
        before = place[1] < place[0]
        begins[0] += f[1] * before
        begins[1] += f[0] * ~before
        worth = left >> bits
        v = np.minimum(code // worth, most).astype(np.int32)
        past = v - begins
        inside = past.view(np.uint32) < f.view(np.uint32)
        over = np.minimum(np.maximum(past, 0), f)
        # without what the models add, v is in its id's run, or at its beginning
        v -= over[0]
        v -= over[1]
        now = of_slot.take(v.view(np.uint32) // rest.view(np.uint32)).astype(np.int32)
        np.copyto(now, named[1], where=inside[1])
        np.copyto(now, named[0], where=inside[0])
        ranks[t] = now
        at = first.take(now)
        past = f * (place < at)
        at *= rest
        at += past[0]
        at += past[1]
        hit = named == now
        f *= hit
        rest *= slots.take(now)
        rest += f[0]
        rest += f[1]
        code -= worth * at.view(np.uint32)
        left = worth * rest.view(np.uint32)
        due = np.flatnonzero(left < short)
        if len(due):
            left[due] <<= word
            own = at_word[due]
            code[due] = code[due] << word | words[own]
            at_word[due] = own + 1
        np.minimum(e, 2, out=e)
        e *= hit
        e += 1
        e <<= 16
        e |= now
        last[key] = e
        now = now.view(np.uint32)
        np.multiply(now, by_last, out=context[0])
        context[0] += was
        context[0] >>= top
        np.bitwise_and(now, np.uint32(_CONTEXTS - 1), out=context[1])
        np.multiply(context, lanes, out=key)
        key += base
        was = now * by_both
    out = []
    for lo in range(0, lanes, _GROUP):
        out += list(tables.ids.take(np.ascontiguousarray(ranks[:, lo : lo + _GROUP].T)))
    return [x[:n] for x, n in zip(out, sizes)]


class FileWriter:
    """Documents' ids into an open binary stream."""

    def __init__(self, stream):
        self.stream, self.docs, self.blocks, self.frames, self.waiting, self.held = stream, [], [], [], [], 0
        self.at = stream.write(MAGIC) or len(MAGIC)
        self.n_ids = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("ids of 65,536 or more don't fit this format")
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids.astype(np.uint16))
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= LANES * BLOCK:
            self._flush(LANES * BLOCK)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint16)
        while len(flat) >= max(1, n):
            part, flat = flat[: LANES * BLOCK], flat[LANES * BLOCK :]
            blocks = [part[i : i + BLOCK] for i in range(0, len(part), BLOCK)]
            tables, *bodies = encode(blocks)
            self.frames.append(len(tables))
            self._write(_FRAME.pack(len(tables), zlib.crc32(tables)) + tables)
            for ids, body in zip(blocks, bodies, strict=True):
                self.blocks.append((len(ids), len(body)))
                self._write(_HEAD.pack(len(ids), len(body), zlib.crc32(body), zlib.crc32(ids.astype("<u2").tobytes())) + body)
        self.waiting, self.held = [flat], len(flat)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> int:
        """Write the rest and the trailer; the file's length."""
        self._flush(1)
        nulls = b"".join(b"\1" if d is None else b"\0" for d, _ in self.docs)
        columns = [np.array([d or 0 for d, _ in self.docs], "<i8"), np.array([n for _, n in self.docs], "<u4"), np.array(self.blocks, "<u4"), np.array(self.frames, "<u4")]
        table = zlib.compress(struct.pack("<QQ", len(self.docs), len(self.blocks)) + nulls + b"".join(c.tobytes() for c in columns), 1)
        start = self.at
        self._write(table)
        self._write(_TAIL.pack(start, len(table), zlib.crc32(table), MAGIC))
        return self.at


def index(stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a document's id is null, ids, numbers of ids; blocks as rows of ids and bytes; frames' tables' bytes) of a seekable stream; ValueError if damaged."""
    stream.seek(0)
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    stream.seek(0, 2)
    end = stream.tell()
    stream.seek(end - _TAIL.size)
    start, size, crc, magic = _TAIL.unpack(stream.read(_TAIL.size))
    stream.seek(start)
    table = stream.read(size)
    if magic != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("the tables are damaged")
    table = zlib.decompress(table)
    n, m = struct.unpack_from("<QQ", table)
    nulls, ids = np.frombuffer(table, np.uint8, n, 16), np.frombuffer(table, "<i8", n, 16 + n)
    sizes, blocks, frames = (np.frombuffer(table, "<u4", k, at).astype(np.int64) for k, at in ((n, 16 + 9 * n), (2 * m, 16 + 13 * n), (-(-m // LANES), 16 + 13 * n + 8 * m)))
    return nulls, ids, sizes, blocks.reshape(-1, 2), frames


def read_file(stream, first: int = 0, end: int | None = None):
    """Yield (doc_id, place of its first id in the file, ids as little-endian unsigned 32-bit numbers) of the documents that start in blocks first to end.

    ValueError if a checksum fails. What a document has in later blocks is read too.
    """
    nulls, names, sizes, blocks, frames = index(stream)
    places = np.concatenate([[0], np.cumsum(blocks[:, 0])])  # of the blocks' first ids
    # of the blocks' heads, and of the frames, each before its first block
    offsets = len(MAGIC) + np.concatenate([[0], np.cumsum(blocks[:, 1] + _HEAD.size)])[:-1] + np.repeat(np.cumsum(frames + _FRAME.size), LANES)[: len(blocks)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    end = len(blocks) if end is None else min(end, len(blocks))
    lo = int(np.searchsorted(starts[:-1], places[first]))
    hi = len(sizes) if end == len(blocks) else int(np.searchsorted(starts[:-1], places[end]))
    if lo == hi:
        return
    last = int(np.searchsorted(places, starts[hi]))  # the block before this one holds the last id

    def run():
        for at in sorted({first, *range(first - first % LANES + LANES, last, LANES)}):
            frame = at // LANES
            stream.seek(int(offsets[frame * LANES] - frames[frame]) - _FRAME.size)
            size, crc = _FRAME.unpack(stream.read(_FRAME.size))
            bodies, heads = [stream.read(size)], []
            if zlib.crc32(bodies[0]) != crc:
                raise ValueError("a frame's tables are damaged")
            stream.seek(int(offsets[at]))
            for _ in range(at, min(last, (frame + 1) * LANES)):
                head = _HEAD.unpack(stream.read(_HEAD.size))
                body = stream.read(head[1])
                if zlib.crc32(body) != head[2]:
                    raise ValueError("a block is damaged")
                heads.append(head)
                bodies.append(body)
            for h, block in zip(heads, decode(bodies, [h[0] for h in heads])):
                if zlib.crc32(block.astype("<u2").tobytes()) != h[3]:
                    raise ValueError("a block's ids are damaged")
                yield block

    found, buffer = run(), np.empty(0, np.uint16)
    skip = int(starts[lo] - places[first])
    for i in range(lo, hi):
        need, parts = skip + int(sizes[i]), []
        while need > len(buffer):
            parts.append(buffer)
            need -= len(buffer)
            buffer = next(found)
        parts.append(buffer[:need])
        buffer = buffer[need:]
        own = np.concatenate(parts)[skip:]
        skip = 0
        yield (None if nulls[i] else int(names[i])), int(starts[i]), own.astype("<u4").tobytes()
