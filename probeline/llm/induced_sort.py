"""Suffix order with common-prefix lengths by external induced sorting.

One level: positions are L (larger than their right neighbour's suffix) or S (smaller); the leftmost S of each run
are named by the piece of text up to the next one, the names are sorted by recursion, and from them one scan
upwards induces all L suffixes and one scan downwards all S suffixes. A scan takes tuples (symbol, position, common
prefix with the tuple before) from a priority queue and puts the left neighbours of what it scans back into it.
The queue keeps tuples by ranges of symbols; beyond its budget they go to run files in the shared folder, written
and read in sequence. Work is done on whole batches of tuples: a batch ends before the first tuple that one of its own
left neighbours may precede.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyarrow import fs

#: Common prefixes are exact below this length and equal to it beyond; it fits one byte.
CAP = 255
#: Names of a recursion that are few enough to be ordered in memory, by doubling.
BASE = 1 << 18
_FAR = np.int32((1 << 30) - 1)
_EMPTY = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))


class RunFiles:
    """Arrays in files of one task attempt below the shared folder; ``close`` removes them."""

    def __init__(self, folder: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.count = 0

    def write(self, arrays: tuple[np.ndarray, ...]) -> tuple:
        if not self.count:
            self.system.create_dir(self.path)
        self.count += 1
        name = f"{self.path}/run-{self.count}"
        with self.system.open_output_stream(name) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a))
        starts = np.cumsum([0, *(a.nbytes for a in arrays)]).tolist()
        return name, [(s, a.dtype) for s, a in zip(starts, arrays)]

    def read(self, run: tuple, low: int, high: int) -> tuple[np.ndarray, ...]:
        name, columns = run
        with self.system.open_input_file(name) as file:
            return tuple(
                np.frombuffer(file.read_at((high - low) * t.itemsize, start + low * t.itemsize), t) for start, t in columns
            )

    def close(self) -> None:
        if self.count:
            self.system.delete_dir(self.path)
            self.count = 0


class SymbolQueue:
    """Priority queue of tuples (symbol, position, prefix); ``pop`` gives those up to a symbol, by symbol, then arrival.

    Tuples wait in lists by areas of symbols. The area at the front is sorted once; later arrivals there are merged in.
    """

    def __init__(self, areas: np.ndarray, files: RunFiles, budget: int):
        self.areas, self.files, self.budget = areas, files, budget
        self.chunks: list[list] = [[] for _ in range(int(areas[-1]) + 1)]
        self.runs: list[tuple] = []
        self.held, self.area, self.front, self.fresh = 0, -1, _EMPTY, []

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """``symbols`` ascend; equal ones are in order of arrival."""
        of = self.areas[symbols]
        cuts = (np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(of)]):
            part = (symbols[low:high], positions[low:high], prefixes[low:high])
            if of[low] == self.area:
                self.fresh.append(part)
            else:
                self.chunks[of[low]].append(part)
        self.held += len(of)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        sizes = np.array([sum(len(c[0]) for c in chunks) for chunks in self.chunks])
        flat = [c for chunks in self.chunks for c in chunks]
        if flat:
            run = self.files.write(tuple(np.concatenate(x) for x in zip(*flat)))
            self.runs.append((run, np.concatenate(([0], np.cumsum(sizes)))))
        self.chunks = [[] for _ in self.chunks]
        self.held = 0

    def _enter(self, area: int) -> None:
        parts = [self.files.read(run, int(at[area]), int(at[area + 1])) for run, at in self.runs if at[area] < at[area + 1]]
        parts += self.chunks[area]
        self.held -= sum(len(c[0]) for c in self.chunks[area])
        self.chunks[area], self.area = [], area
        self.front = self._sorted(parts) if parts else _EMPTY

    @staticmethod
    def _sorted(parts: list[tuple]) -> tuple[np.ndarray, ...]:
        if len(parts) == 1:
            return parts[0]
        symbols, positions, prefixes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(symbols, kind="stable")
        return symbols[order], positions[order], prefixes[order]

    def pop(self, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tuples of symbols below ``end``, which lie in one area."""
        if self.areas[end - 1] != self.area:
            self._enter(int(self.areas[end - 1]))
        if self.fresh:
            self.front = self._sorted([self.front, *self.fresh])
            self.fresh = []
        n = int(np.searchsorted(self.front[0], end))
        out = tuple(x[:n] for x in self.front)
        self.front = tuple(x[n:] for x in self.front)
        return out


class Sequence:
    """Scanned tuples in blocks; full blocks beyond the budget lie in files."""

    def __init__(self, files: RunFiles, budget: int):
        self.files, self.budget, self.blocks, self.open, self.held = files, budget, [], [], 0

    def append(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.open.append(arrays)
            self.held += len(arrays[0])
            if self.held > self.budget:
                block = tuple(np.concatenate(x) for x in zip(*self.open))
                self.blocks.append((self.files.write(block), len(block[0])))
                self.open, self.held = [], 0

    def backwards(self):
        """Blocks from the last to the first."""
        if self.open:
            yield tuple(np.concatenate(x) for x in zip(*self.open))
        for run, n in reversed(self.blocks):
            yield self.files.read(run, 0, n)


class _Since:
    """For each symbol, the least common prefix scanned since a tuple of that symbol was put into the queue."""

    def __init__(self, n_symbols: int):
        self.batch = np.full(n_symbols, -1, np.int32)
        self.tail = np.zeros(n_symbols, np.uint8)
        self.ids: list[int] = []
        self.least: list[int] = []

    def prefixes(self, now: int, near: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Common prefix of each source with the source before it of the same symbol. The sources are sorted by
        ``symbols``, equal ones by their place ``at`` in the batch; ``near`` holds the batch's own prefixes."""
        first = np.empty(len(symbols), bool)
        first[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
        begin = np.zeros(len(at), np.int32)
        begin[1:] = at[:-1] + 1
        begin[first] = 0
        value = _range_least(near, begin, at)
        heads = np.flatnonzero(first)
        hs = symbols[heads]
        since = self.batch[hs]
        before = np.minimum(value[heads], self.tail[hs])
        if self.ids:
            k = np.searchsorted(self.ids, since + 1)
            before = np.minimum(before, np.array([*self.least, CAP], np.uint8)[k])
        value[heads] = before
        lasts = np.empty(len(heads), np.int64)
        lasts[:-1], lasts[-1] = heads[1:] - 1, len(symbols) - 1
        # what is scanned after the last push of each symbol
        rest = np.full(len(near) + 1, CAP, np.uint8)
        np.minimum.accumulate(near[::-1], out=rest[:-1][::-1])
        self.batch[hs], self.tail[hs] = now, rest[at[lasts] + 1]
        value = np.minimum(value, CAP - 1) + np.uint8(1)
        value[heads[since < 0]] = 0
        return value

    def scanned(self, now: int, least: int) -> None:
        while self.least and self.least[-1] >= least:
            self.least.pop()
            self.ids.pop()
        self.least.append(least)
        self.ids.append(now)


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of ``values`` in each ``[low, high]``, from a table over powers of two."""
    size = high - low + 1
    power = (np.frexp(size.astype(np.float32))[1] - 1).astype(np.int32)
    power -= (1 << power) > size  # a size rounded up to the next power
    n, most = len(values), int(power.max())
    table = np.empty((most + 1, n), np.uint8)
    table[0] = values
    for p in range(most):
        half = 1 << p
        np.minimum(table[p, : n - half], table[p, half:], out=table[p + 1, : n - half])
    table, row = table.reshape(-1), power * n
    return np.minimum(table[row + low], table[row + high - (1 << power) + 1])


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each symbol (about as many as the root of the tuples, of nearly equal share), and areas of ranges."""
    n = len(counts)
    if n <= 512:
        return np.arange(n), np.arange(n, dtype=np.int32)
    wanted = max(1, 2 * math.isqrt(int(counts.sum())))
    before = np.cumsum(counts) - counts
    of = np.unique(before * wanted // max(int(counts.sum()), 1), return_inverse=True)[1]
    return of, (of // math.isqrt(wanted)).astype(np.int32)


def _scan(text, mirror, wanted, runs, given, n_symbols, counts, files, budget):
    """Scan by symbol (``mirror - symbol`` where scanning down). In a symbol, tuples of the queue come before the
    given ones. ``given`` yields (positions, prefixes) in scan order. Yields (from the queue, positions, prefixes)."""
    kind = np.uint16 if n_symbols <= 65_536 else np.int32
    turned = (lambda s: s.astype(np.int32)) if mirror is None else (lambda s: np.int32(mirror) - s)
    # the symbol under which a position's left neighbour goes into the queue
    goal = np.full(len(text), _FAR, np.int32)
    goal[1:][wanted[:-1]] = turned(text[:-1][wanted[:-1]])
    ranges, areas = _ranges(counts)
    queue, since = SymbolQueue(areas, files, budget), _Since(n_symbols)
    given, rest, ended = iter(given), (np.zeros(0, np.int32), np.zeros(0, np.uint8)), False
    batch, last_key, last_position, width = 0, -2, -1, 4096
    ends = np.append(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, n_symbols).tolist()
    rest_symbols = np.zeros(0, np.int32)
    for end in ends:
        while not ended and (not len(rest_symbols) or rest_symbols[-1] < end):
            try:
                more = next(given)
            except StopIteration:
                ended = True
                break
            rest = tuple(np.concatenate(x) for x in zip(rest, more)) if len(rest[0]) else more
            rest_symbols = turned(text[rest[0]])
        n = int(np.searchsorted(rest_symbols, end))
        symbols, positions, prefixes = queue.pop(end)
        keys = symbols * np.int32(2)
        if n:
            others = rest_symbols[:n] * np.int32(2) + np.int32(1)
            pos, pre = rest[0][:n], rest[1][:n]
            rest, rest_symbols = (rest[0][n:], rest[1][n:]), rest_symbols[n:]
            if len(keys):
                keys, positions, prefixes = _merged((keys, positions, prefixes), (others, pos, pre))
            else:
                keys, positions, prefixes = others, pos, pre
        low, grown = 0, -1
        while low < len(keys):
            high = min(len(keys), low + width)
            k, p = keys[low:high], positions[low:high]
            target = goal[p]
            cut = high - low
            own = (target * np.int32(2)) == k
            if grown >= 0:
                own[k == grown] = False
                target[target * np.int32(2) == grown] = _FAR
            if own.any():
                cut = int(own.argmax())
                if not cut:  # the tuples of this symbol are complete: add those before them in runs of the symbol
                    grown = int(k[0])
                    n = int(np.searchsorted(keys, grown, "right"))
                    more = _runs_of(grown >> 1, goal, positions[low:n], prefixes[low:n])
                    old = (keys[low:], positions[low:], prefixes[low:])
                    keys, positions, prefixes = _merged(old, (np.full(len(more[0]), grown, np.int32), *more))
                    low = 0
                    continue
                k, p, target = k[:cut], p[:cut], target[:cut]
            least = np.minimum.accumulate(target) * np.int32(2)
            if least[-1] < k[-1]:
                early = least[:-1] < k[1:]
                first = int(early.argmax())
                if early[first]:
                    cut = first + 1
            width = width * 2 if cut == width else max(256, min(width, 4 * cut))
            k, p, target = k[:cut], p[:cut], target[:cut]
            # common prefix with the tuple scanned before
            change = np.empty(cut, np.int32)
            change[0] = int(k[0]) ^ last_key if last_key >= 0 else 2
            np.bitwise_xor(k[1:], k[:-1], out=change[1:])
            near = prefixes[low : low + cut] * (change == 0)
            meet = np.flatnonzero(change == 1)
            if len(meet):
                other = np.where(meet > 0, p[meet - 1], last_position)
                near[meet] = np.minimum(runs[p[meet]], runs[other])
            yield (k & 1) == 0, p, near
            low += cut
            at = np.flatnonzero(target < _FAR)
            if len(at):
                order = np.argsort(target[at].astype(kind), kind="stable")
                at = at[order].astype(np.int32)
                new = (target[at], p[at] - np.int32(1))
                new = (*new, since.prefixes(batch, near, new[0], at))
                here = int(np.searchsorted(new[0], end))
                if here:
                    left = (keys[low:], positions[low:], prefixes[low:])
                    keys, positions, prefixes = _merged(left, (new[0][:here] * np.int32(2), new[1][:here], new[2][:here]))
                    low = 0
                if here < len(at):
                    queue.push(*(x[here:] for x in new))
            since.scanned(batch, int(near.min()))
            batch, last_key, last_position = batch + 1, int(k[-1]), int(p[-1])


def _runs_of(symbol: int, goal: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tuples that the tuples of one symbol bring forth under the same symbol: one place further left in each round."""
    out, round_ = [], 1
    while True:
        alive = np.flatnonzero(goal[positions] == symbol)
        if not len(alive):
            break
        near = np.empty(len(alive), np.uint8)
        near[0] = min(round_, CAP)  # the round before has one symbol of the run less
        if len(alive) > 1:
            near[1:] = np.minimum(np.minimum.reduceat(prefixes[: alive[-1] + 1], alive[:-1] + 1), CAP - 1) + 1
        positions, prefixes = positions[alive] - np.int32(1), near
        out.append((positions, prefixes))
        round_ += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two sorted sets of tuples as one; of equal keys those of ``a`` come first."""
    if not len(a[0]) or a[0][-1] <= b[0][0]:
        return tuple(np.concatenate(x) for x in zip(a, b))
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    old = np.ones(len(a[0]) + len(b[0]), bool)
    old[at] = False
    out = []
    for x, y in zip(a, b):
        z = np.empty(len(old), x.dtype)
        z[at], z[old] = y, x
        out.append(z)
    return tuple(out)


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which positions are S, and how many equal symbols begin at each (up to ``CAP``). The last symbol is the smallest."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    lengths = np.diff(np.concatenate(([-1], differs)))
    smaller = np.repeat(text[differs] < text[differs + 1], lengths)
    ends = np.repeat(differs, lengths)
    runs = np.ones(n, np.uint8)
    runs[: n - 1] = np.minimum(ends - np.arange(n - 1) + 1, CAP)
    return np.append(smaller, True), runs


def _names(text: np.ndarray, starts: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pieces from each start to the next one, and their dense rank; of a piece and its beginning the
    beginning is the larger one."""
    n, m = len(text), len(starts)
    ends = np.append(starts[1:], starts[-1])
    bits = int(n_symbols + 1).bit_length()
    width, top = max(1, 63 // bits), (1 << bits) - 1

    def keys(which: np.ndarray, chunk: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        at, end = starts[which] + chunk * width, ends[which]
        for _ in range(width):
            out = (out << bits) | np.where(at <= end, text[np.minimum(at, n - 1)], top)
            at = at + 1
        return out

    first = keys(np.arange(m), 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    fresh = np.concatenate(([True], first[1:] != first[:-1]))
    chunk = 1
    while True:
        group = np.cumsum(fresh) - 1
        alone = fresh & np.append(fresh[1:], True)
        # a piece that ends with the chunk has shown no top symbol yet: it goes on too, with top symbols alone
        unended = ends[order] - starts[order] + 1 >= chunk * width
        at = np.flatnonzero(~alone & unended)
        if not len(at):
            break
        key = keys(order[at], chunk)
        place = np.lexsort((key, group[at]))
        # pieces of one group agree in whether they go on: a shorter one has ended with the top symbol
        order[at] = order[at][place]
        key, own = key[place], group[at]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        chunk += 1
    rank = np.empty(m, np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return order, rank


def _extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``known`` plus the common prefix at ``a`` and ``b``, up to ``CAP``."""
    out = np.minimum(known, CAP)
    active = np.flatnonzero(out < CAP)
    while len(active):
        active = active[text[a[active]] == text[b[active]]]
        out[active] += 1
        a[active] += 1
        b[active] += 1
        active = active[out[active] < CAP]
    return out


def _by_doubling(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a short text with the common prefix of each with the one before."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order].astype(np.int64)
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    rank, step = np.empty(n + 1, np.int64), 1
    while True:
        heads = np.flatnonzero(fresh)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        rank[n] = -1
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(open_):
            break
        some = order[open_]
        key = (rank[some] << 31) | (rank[np.minimum(some + step, n)] + 1)
        place = np.argsort(key, kind="stable")
        order[open_], key = some[place], key[place]
        fresh[open_[1:]] |= key[1:] != key[:-1]
        step *= 2
    shared = np.zeros(n, np.int64)
    shared[1:] = _extended(text, order[:-1].copy(), order[1:].copy(), shared[1:])
    return order, shared


def _sorted_starts(text, starts, n_symbols, files, budget):
    """Positions of the leftmost S in order of their suffixes, with common prefixes, by recursion on names."""
    order, names = _names(text, starts, n_symbols)
    n_names = int(names[order[-1]]) + 1
    if n_names == len(starts):
        ranked, shared = order, np.zeros(len(order), np.int64)
    elif len(starts) <= BASE:
        ranked, shared = _by_doubling(names)
    else:
        parts = list(_level(names.astype(np.int32), n_names, files, budget))  # from the largest suffix down
        ranked = np.concatenate([p for p, _ in parts])[::-1].astype(np.int64)
        down = np.concatenate([x for _, x in parts])
        shared = np.concatenate(([0], down[:0:-1])).astype(np.int64)
        del parts, down
    del names, order
    before = np.concatenate(([ranked[0]], ranked[:-1]))
    near = np.minimum(shared, len(starts) - 1 - np.maximum(ranked, before))
    a, b = starts[before + near], starts[ranked + near]
    prefixes = b - starts[ranked]
    prefixes[1:] = _extended(text, a[1:].copy(), b[1:].copy(), prefixes[1:])
    return starts[ranked].astype(np.int32), np.minimum(prefixes, CAP).astype(np.uint8)


def _level(text, n_symbols, files, budget):
    """(positions, prefixes) of all suffixes from the largest down; a prefix is shared with the suffix scanned before.
    ``text`` ends with a zero that occurs nowhere else."""
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.uint8)
        return
    small, runs = _kinds(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    given, prefixes = _sorted_starts(text, starts, n_symbols, files, budget)
    counts = np.bincount(text[~small], minlength=n_symbols)
    larger = Sequence(files, budget)
    for queued, positions, near in _scan(text, None, ~small, runs, [(given, prefixes)], n_symbols, counts, files, budget):
        larger.append(positions[queued].astype(np.int32), near[queued])
    del given, prefixes

    def downwards():
        carry = 0
        for positions, near in larger.backwards():
            turned = near[::-1]
            yield positions[::-1], np.concatenate(([carry], turned[:-1])).astype(np.uint8)
            carry = int(turned[-1])

    top = n_symbols - 1
    counts = np.bincount(top - text[small].astype(np.int64), minlength=n_symbols)
    for _, positions, near in _scan(text, top, small, runs, downwards(), n_symbols, counts, files, budget):
        yield positions.astype(np.int32), near
    yield np.array([n - 1], np.int32), np.zeros(1, np.uint8)


def suffixes_downwards(data: np.ndarray, folder: str, budget: int = 4 << 20):
    """Blocks (positions, prefixes) of the suffixes of ``data`` (unsigned symbols from 1 on) from the largest down.

    The prefix of each is the number of symbols, up to ``CAP``, that it shares with the one before. ``budget`` is the
    number of tuples each queue holds in memory; ``folder`` takes the run files, which are removed at the end. The
    symbols themselves stay in memory.
    """
    files = RunFiles(folder)
    try:
        text = np.append(data, data.dtype.type(0))
        for positions, near in _level(text, int(text.max()) + 1, files, budget):
            if positions[-1] == len(data):  # the end of the text
                positions, near = positions[:-1], near[:-1]
            if len(positions):
                yield positions, near
    finally:
        files.close()
