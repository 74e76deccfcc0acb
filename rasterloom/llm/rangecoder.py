"""A context-mixing range coder for token ids that codes many independent blocks side by side.

A block starts from the frame's frequencies, read once for all blocks of a frame, and can be decoded without the other
blocks. For each id the range is mixed from three predictions: the id last seen in this block after the same two ids
(order 2), the frame's distribution of ids after the one before (order 1), and the frame's distribution of ids (order 0).
The weights of the mix adapt within a block, order 2's by how often that prediction has held lately, order 1's by how
much of what follows the id before the frame's distribution covers.

All blocks of a frame take a step at once, as numpy arrays with an entry for each block.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids are below this.
IDS = 1 << 16
#: Bits of the whole range, of the part that a weight deals, of an order-1 weight, and of the cumulated frequencies of order 1 and 0.
_TOP, _UNIT, _WEIGHT, _ONE, _ZERO = 62, 16, 15, 10, 16
#: The range is widened below this.
_LEAST = 1 << 30
#: Slots of a block's order-2 table; contexts of order 1 at most, how often one has to occur, and the ids that may follow one.
_SLOTS, CONTEXTS, _OFTEN, _FOLLOW = 9, 4096, 64, 8192
#: Where order-2 weights start, by how often the prediction has held, and between what bounds they stay; of order-1 weights, the bounds.
_START2, _LOW2, _HIGH2 = (1 << 7, 20_000, 36_000, 50_000), 1 << 7, 60_000
_LOW1, _HIGH1 = 1 << 9, int(0.985 * (1 << _WEIGHT))
#: Classes of contexts by the share of successors covered: none, and below these.
_COVERED = (0.75, 0.9, 0.97)
_CLASSES = 8
_BITS = np.array([0, _ONE, _ZERO])  # of the slots of each part
_NONE = IDS  # the context of a block's first id


def _dealt(counts: np.ndarray, row: np.ndarray, rows: int, total: int) -> np.ndarray:
    """Counts as frequencies of at least 1 that add up to total in each row; row is sorted, and no row has over `total` entries."""
    size, entries = np.bincount(row, counts, minlength=rows), np.bincount(row, minlength=rows)
    near = np.maximum(np.rint(counts * (total / size[row])), 1).astype(np.int64)
    safe = (1 + counts * (total - entries[row]) // size[row]).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    # what rounding leaves goes to the largest entry, unless it is too much for that
    order = np.lexsort((-counts, row))[first] if len(row) else first
    lack = total - np.bincount(row, near, minlength=rows).astype(np.int64)
    rough = np.zeros(rows, bool)
    rough[row[order]] = 2 * np.abs(lack[row[order]]) > near[order]
    out = np.where(rough[row], safe, near)
    lack = total - np.bincount(row, out, minlength=rows).astype(np.int64)
    out[order] += lack[row[order]]
    return out


class Frame:
    """The frequencies that a frame's blocks start from: entries (id, start, frequency), the first for the whole of a part, then
    those of each context, then those of order 0."""

    def __init__(self, contexts: np.ndarray, covered: np.ndarray, entries: np.ndarray, ids: np.ndarray, freqs: np.ndarray, all_ids: np.ndarray, all_freqs: np.ndarray):
        """contexts, and of each its class and number of entries; the entries' ids and frequencies in turn; those of order 0."""
        self.parts = (contexts, covered, entries, ids, freqs, all_ids, all_freqs)
        self.ones = 1 + len(ids)
        sym, freq = (np.concatenate([[one], x, y]).astype(np.int64) for one, x, y in ((0, ids, all_ids), (1, freqs, all_freqs)))
        cum = np.cumsum(freq) - freq - 1
        self.zero = 1 + (len(contexts) << _ONE)  # where the slots of order 0 begin
        cum[0] = 0
        cum[1 : self.ones] &= (1 << _ONE) - 1
        cum[self.ones :] -= self.zero - 1
        self.sym, self.start, self.freq = sym, cum, freq
        self.slots = np.repeat(np.arange(len(sym), dtype=np.int32), freq)
        self.base = np.zeros(IDS + 1, np.int64)
        self.base[contexts] = 1 + (np.arange(len(contexts)) << _ONE)
        self.kind = np.zeros(IDS + 1, np.int64)
        self.kind[contexts] = covered

    @staticmethod
    def of(ids: np.ndarray) -> Frame:
        """The frequencies of these ids and of their pairs; all of them are counted."""
        counts = np.bincount(ids, minlength=IDS)
        known = np.flatnonzero(counts)
        all_freqs = _dealt(counts[known].astype(np.float64), np.zeros(len(known), np.int64), 1, 1 << _ZERO) if len(known) else known
        pairs = ids[:-1].astype(np.uint32) << np.uint32(16) | ids[1:].astype(np.uint32)
        pairs.sort()
        at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([at, [len(pairs)]]))
        before, after = (pairs[at] >> np.uint32(16)).astype(np.int64), (pairs[at] & np.uint32(0xFFFF)).astype(np.int64)
        total = np.bincount(before, times, minlength=IDS)
        by_use = np.argsort(-counts, kind="stable")
        often = np.zeros(IDS, bool)
        often[by_use[:_FOLLOW]] = True
        context = np.zeros(IDS, bool)
        context[by_use[:CONTEXTS]] = True
        context &= total >= _OFTEN
        keep = np.flatnonzero(context[before] & often[after] & (times >= 3) & (times * float(1 << _ONE) >= 0.7 * total[before]))
        before, after, times = before[keep], after[keep], times[keep].astype(np.float64)
        # what would be more entries than a row has places, the rarest last
        order = np.lexsort((-times, before))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(before[order], before[order])
        keep = place < 1 << _ONE
        before, after, times = before[keep], after[keep], times[keep]
        contexts, row = np.unique(before, return_inverse=True)
        share = np.bincount(row, times, minlength=len(contexts)) / np.maximum(total[contexts], 1)
        covered = 1 + np.searchsorted(_COVERED, share, "right")
        return Frame(contexts, covered, np.bincount(row, minlength=len(contexts)), after, _dealt(times, row, len(contexts), 1 << _ONE), known, all_freqs)

    def entries(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The entry that codes each id after each id before it."""
        own = np.full(IDS, -1, np.int32)
        own[self.sym[self.ones :]] = np.arange(self.ones, len(self.sym))
        follow = np.unique(self.sym[1 : self.ones])
        column = np.full(IDS, len(follow), np.int64)
        column[follow] = np.arange(len(follow))
        width = len(follow) + 1
        row = np.full(IDS + 1, len(self.parts[0]), np.int64)
        row[self.parts[0]] = np.arange(len(self.parts[0])) * width
        row[self.kind == 0] = len(self.parts[0]) * width
        table = np.full((len(self.parts[0]) + 1) * width, -1, np.int32)
        table[np.repeat(np.arange(len(self.parts[0])) * width, self.parts[2]) + column[self.sym[1 : self.ones]]] = np.arange(1, self.ones)
        out = np.empty(len(ids), np.int32)
        for a in range(0, len(ids), 1 << 19):
            x = ids[a : a + (1 << 19)]
            found = table.take(row.take(before[a : a + (1 << 19)]) + column.take(x))
            out[a : a + (1 << 19)] = np.where(found < 0, own.take(x), found)
        return out

    def to_bytes(self) -> bytes:
        contexts, covered, entries, ids, freqs, all_ids, all_freqs = self.parts
        steps = np.diff(ids, prepend=0)
        steps[np.cumsum(entries) - entries] = ids[np.cumsum(entries) - entries]
        numbers = [np.array([len(contexts), len(ids), len(all_ids)]), np.diff(contexts, prepend=0), covered, entries, steps, freqs - 1, np.diff(all_ids, prepend=0), all_freqs - 1]
        flat = np.concatenate(numbers).astype("<u4").view(np.uint8).reshape(-1, 4)
        return np.ascontiguousarray(flat.T).tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Frame:
        flat = np.frombuffer(data, np.uint8).reshape(4, -1)
        x = np.ascontiguousarray(flat.T).view("<u4").ravel().astype(np.int64)
        n, m, k = x[:3].tolist()
        contexts, covered, entries, steps, freqs, all_ids, all_freqs = np.split(x[3:], np.cumsum([n, n, n, m, m, k]))
        total = np.cumsum(steps)
        first = np.cumsum(entries) - entries
        ids = total - np.repeat(total[first] - steps[first], entries)
        return Frame(np.cumsum(contexts), covered, entries, ids, freqs + 1, np.cumsum(all_ids), all_freqs + 1)


class _Blocks:
    """The adaptive part of the models of a number of blocks, which learn from each id in turn."""

    def __init__(self, n: int, frame: Frame):
        self.frame = frame
        self.lane2, self.lane1, self.slots = (np.arange(n, dtype=np.int64) << k for k in (2, 3, _SLOTS))
        self.table = np.full(n << _SLOTS, IDS << 2, np.int32)  # an id that never comes, held 0 times
        self.p2 = np.tile(np.array(_START2, np.int64), n)
        ones = np.array([0, *(int((a + b) / 2 * (1 << _WEIGHT)) for a, b in zip((0.4, *_COVERED), (*_COVERED, 1), strict=True))] + [0] * (_CLASSES - 2 - len(_COVERED)))
        self.p1 = np.tile(np.clip(ones, 0, _HIGH1), n)
        self.before, self.last = np.full(n, _NONE, np.int64), np.full(n, _NONE, np.int64)
        self.count, self.lane, self.bounds = n, np.arange(n), np.zeros((4, n), np.int64)
        self.flat = self.bounds.ravel()

    def predict(self, n: int, size: np.ndarray) -> None:
        """Cuts the ranges into the parts of order 2, 1 and 0: their bounds are 0, `two`, `one` and the size."""
        last = self.last[:n]
        self.at = self.slots[:n] + ((last * 40503 + self.before[:n]) * 2654435761 >> 22 & (1 << _SLOTS) - 1)
        e = self.table.take(self.at)
        self.id2, self.held = e >> 2, e & 3
        self.c2, self.c1 = self.lane2[:n] + self.held, self.lane1[:n] + self.frame.kind.take(last)
        self.f2, self.w1 = self.p2.take(self.c2), self.p1.take(self.c1)
        unit = size >> _UNIT
        self.two, self.one, self.whole = self.bounds[1, :n], self.bounds[2, :n], self.bounds[3, :n]
        np.multiply(unit, self.f2, out=self.two)
        unit *= ((1 << _UNIT) - self.f2) * self.w1 >> _WEIGHT
        np.add(self.two, unit, out=self.one)
        self.whole[:] = size

    def part(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part (0, 1, 2) of each block's range begins, and how much of it one slot of it has."""
        at = which * self.count + self.lane[:n]
        begin = self.flat.take(at)
        at += self.count
        return begin, self.flat.take(at) - begin >> _BITS.take(which)

    def learn(self, n: int, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        self.p2[self.c2] = self.f2 + (hit2 * (_HIGH2 - _LOW2) + _LOW2 - self.f2 >> 4)
        # order 1 is judged only where order 2 didn't answer; the first class has no order 1
        self.p1[self.c1] = self.w1 + ((hit1 * (_HIGH1 - _LOW1) + _LOW1 - self.w1) * ~hit2 >> 5)
        self.p1[::_CLASSES] = 0
        self.table[self.at] = (ids << 2) + 1 + hit2 * np.minimum(self.held, 2)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def encode(ids: np.ndarray, length: int, frame: Frame) -> list[bytes]:
    """Blocks of `length` ids (the last may be shorter), each with its own weights, table and checksum."""
    count = -(-len(ids) // length)
    if not count:
        return []
    tail = len(ids) - (count - 1) * length
    before = np.empty(len(ids), np.int32)
    before[1:] = ids[:-1]
    before[::length] = _NONE

    def by_step(x: np.ndarray) -> np.ndarray:
        whole = np.zeros(count * length, np.int32)
        whole[: len(x)] = x
        return np.ascontiguousarray(whole.reshape(count, length).T)

    chosen = by_step(frame.entries(before, ids))
    del before
    table = by_step(ids)
    model = _Blocks(count, frame)
    low, size = np.zeros(count, np.int64), np.full(count, 1 << _TOP)
    room = np.arange(count) * (length + 4)
    words = np.zeros(count * (length + 4), np.uint32)
    filled = np.zeros(count, np.int64)
    for step in range(length):
        n = count if step < tail else count - 1
        if not n:
            break
        now, e = table[step, :n], chosen[step, :n]
        model.predict(n, size[:n])
        hit2, one = model.id2 == now, e < frame.ones
        not2 = ~hit2
        # an id that order 2 gives has the whole of its part; of the others' part each has what its entry says
        e = e * not2
        begin, slot = model.part(n, (2 - one) * not2)
        at = slot * frame.start.take(e)
        at += begin
        at += low[:n]
        own = slot * frame.freq.take(e)
        over = np.flatnonzero(at >= 1 << _TOP)
        if len(over):
            at[over] -= 1 << _TOP
            place = room.take(over) + filled.take(over) - 1
            while len(place):
                words[place] += np.uint32(1)
                place = place[words.take(place) == 0] - 1
        out = np.flatnonzero(own < _LEAST)
        if len(out):
            to, value = filled.take(out), at.take(out)
            words[room.take(out) + to] = (value >> 30).astype(np.uint32)
            filled[out] = to + 1
            at[out] = (value & _LEAST - 1) << 32
            own[out] <<= 32
        low[:n], size[:n] = at, own
        model.learn(n, now, hit2, one)
    words[room + filled] = (low >> 30).astype(np.uint32)
    words[room + filled + 1] = ((low & _LEAST - 1) << 2).astype(np.uint32)
    filled += 2
    blocks = []
    for i, n in enumerate(filled.tolist()):
        body = (length if i < count - 1 else tail).to_bytes(4, "little") + words[room[i] : room[i] + n].astype("<u4").tobytes()
        blocks.append(zlib.crc32(body).to_bytes(4, "little") + body)
    return blocks


def decode(blocks: list[bytes], frame: Frame) -> np.ndarray:
    """The ids of blocks, one after another; raises ValueError where a checksum is wrong."""
    bodies = []
    for b in blocks:
        if zlib.crc32(b[4:]).to_bytes(4, "little") != b[:4]:
            raise ValueError("a block doesn't have its checksum")
        bodies.append(np.frombuffer(b, "<u4", offset=4))
    count = len(bodies)
    if not count:
        return np.zeros(0, np.int64)
    sizes = np.array([b[0] for b in bodies], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    bodies = [bodies[i] for i in order]
    stream = np.concatenate([*bodies, np.zeros(2, np.uint32)]).astype(np.int64)
    word = np.cumsum([0, *map(len, bodies)])[:-1] + 1
    packed = frame.sym << 34 | frame.start << 17 | frame.freq
    most = (1 << _BITS) - 1
    model = _Blocks(count, frame)
    off, size = stream[word] << 30 | stream[word + 1] >> 2, np.full(count, 1 << _TOP)
    stream[:-1] = (stream[:-1] & 3) << 30 | stream[1:] >> 2  # 32 bits from the third last of each word on
    word += 1
    length = int(sizes[0])
    found = np.zeros((length, count), np.int32)
    active = np.searchsorted(-sizes, -np.arange(length), "left")
    for step in range(length):
        n = int(active[step])
        at = off[:n]
        model.predict(n, size[:n])
        hit2, one = at < model.two, at < model.one
        which = (2 - one) * ~hit2
        begin, slot = model.part(n, which)
        at = at - begin
        place = np.minimum(at // slot, most.take(which))
        place += np.where(one, frame.base.take(model.last[:n]), frame.zero)
        place *= ~hit2
        e = packed.take(frame.slots.take(place))
        now = np.where(hit2, model.id2, e >> 34).astype(np.int32)
        at -= slot * (e >> 17 & (1 << 17) - 1)
        own = slot * (e & (1 << 17) - 1)
        out = np.flatnonzero(own < _LEAST)
        if len(out):
            to = word.take(out)
            at[out] = at.take(out) << 32 | stream.take(to)
            word[out] = to + 1
            own[out] <<= 32
        off[:n], size[:n] = at, own
        found[step, :n] = now
        model.learn(n, now, hit2, one)
    rows = found.T
    whole = np.empty_like(rows)
    whole[order] = rows
    lengths = np.empty_like(sizes)
    lengths[order] = sizes
    return whole[np.arange(length) < lengths[:, None]].astype(np.int64)
