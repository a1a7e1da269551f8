"""Suffix sorting by induction.

A suffix is S if it is smaller than the next one, else L; an S after an L starts
a block.  From the sorted block starts all L suffixes are induced in ascending
order and from those all S suffixes in descending order: a suffix taken from a
symbol's queue puts the one before it into the queue of its symbol.  Queue
entries carry the common prefix with the entry before them: two entries that
follow each other under one symbol share one symbol more than the least common
prefix between the suffixes that put them there.  Only block starts and the
border between L and S suffixes of one symbol compare symbols, up to ``most``
of them.

There are two forms, with the same results up to the order of suffixes that
agree in ``most`` symbols.  ``sort_held`` works on a shard of bytes that memory
holds: whole queues are taken at a time as arrays, and block starts are ordered
by doubling over their names.  ``sort`` is for larger shards: queues, L suffixes
and block runs are in files beyond ``held`` entries, blocks are sorted in
external runs and named, and if names repeat, their sequence is sorted by the
same procedure.  Its text, one byte a symbol, its types and the numbers of
block starts stay in memory.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import numpy as np

#: Entries held by a queue, or bytes of blocks held by a run, before they go to a file.
HELD = 2_000_000
#: Blocks in a file of a run.
BLOCKS = 20_000


class Files:
    """Scratch files in one folder, through functions that reach the shared store; gone after ``close``."""

    def __init__(self, write: Callable[[str, bytes], None], read: Callable[[str], bytes], remove: Callable[[str], None]):
        self._write, self._read, self._remove, self._n, self._open = write, read, remove, 0, set()

    def put(self, data: bytes) -> str:
        self._n += 1
        name = f"{self._n:08d}"
        self._write(name, data)
        self._open.add(name)
        return name

    def take(self, name: str) -> bytes:
        data = self._read(name)
        self._remove(name)
        self._open.discard(name)
        return data

    def close(self) -> None:
        for name in self._open:
            with suppress(OSError):
                self._remove(name)


class Queue:
    """A priority queue by symbol, first come first out under a symbol; ascending or descending. Blocks of entries spill."""

    BLOCK = 1 << 15

    def __init__(self, files: Files, descending: bool, held: int):
        self.files, self.sign, self.held = files, -1 if descending else 1, held
        self.symbols: list[int] = []
        self.tails: dict[int, array] = {}
        self.blocks: dict[int, list] = {}
        self.size = 0

    def push(self, symbol: int, position: int, prefix: int) -> None:
        tail = self.tails.get(symbol)
        if tail is None:
            tail = self.tails[symbol] = array("q")
            if symbol not in self.blocks:
                self.blocks[symbol] = []
                heapq.heappush(self.symbols, self.sign * symbol)
        tail.append(position)
        tail.append(prefix)
        self.size += 1
        if self.size >= self.held:
            self._spill()

    def _spill(self) -> None:
        """Move the fullest tails to files; the order under a symbol is that of its blocks."""
        for symbol in sorted(self.tails, key=lambda s: len(self.tails[s]), reverse=True):
            tail = self.tails.pop(symbol)
            self.blocks[symbol].append(self.files.put(tail.tobytes()))
            self.size -= len(tail) // 2
            if self.size < self.held // 2:
                return

    def drain(self, symbol: int) -> Iterator[tuple[int, int]]:
        """(position, prefix) under the symbol, with what is pushed to it meanwhile."""
        while True:
            blocks = self.blocks.get(symbol)
            if blocks:
                own = array("q")
                own.frombytes(self.files.take(blocks.pop(0)))
            elif symbol in self.tails:
                own = self.tails.pop(symbol)
                self.size -= len(own) // 2
            else:
                self.blocks.pop(symbol, None)
                return
            for i in range(0, len(own), 2):
                yield own[i], own[i + 1]

    def pop_symbol(self, least: int | None) -> int | None:
        """The next symbol that has entries, if it does not come after ``least``; it must be drained."""
        if not self.symbols or (least is not None and self.symbols[0] > self.sign * least):
            return None
        return self.sign * heapq.heappop(self.symbols)


class _Least:
    """The least common prefix since an earlier suffix of the scan, from a stack of minima."""

    def __init__(self):
        self.at: list[int] = []
        self.low: list[int] = []
        self.now = 0
        self.last: dict[int, int] = {}

    def step(self, prefix: int) -> None:
        """The next suffix of the scan, sharing ``prefix`` symbols with the one before."""
        self.now += 1
        while self.low and self.low[-1] >= prefix:
            self.low.pop()
            self.at.pop()
        self.low.append(prefix)
        self.at.append(self.now)

    def induced(self, symbol: int, most: int) -> int:
        """The common prefix of an entry put now under symbol with the one put there before; -1 for the first."""
        before = self.last.get(symbol)
        self.last[symbol] = self.now
        if before is None:
            return -1
        return min(most, 1 + self.low[bisect_left(self.at, before + 1)])


def _common(text: Sequence[int], a: int, b: int, most: int) -> int:
    n = min(most, len(text) - max(a, b))
    if isinstance(text, bytes):
        low, high = 0, n
        if text[a : a + n] == text[b : b + n]:
            return n
        while low < high:  # text[a:a+low] equal, longest such
            mid = (low + high + 1) // 2
            if text[a : a + mid] == text[b : b + mid]:
                low = mid
            else:
                high = mid - 1
        return low
    i = 0
    while i < n and text[a + i] == text[b + i]:
        i += 1
    return i


def _blocks(text: Sequence[int], types: bytearray, starts: array, files: Files, held: int) -> Iterator[tuple[bytes, int]]:
    """(content, number) of all blocks in order of content: sorted runs, merged."""
    width = 1 if isinstance(text, bytes) else 5
    runs, own, size = [], [], 0

    def stored(run: list[tuple[bytes, int]]) -> list[str]:
        """A run as files of a few blocks, so that a merge holds one of each run."""
        return [files.put(b"".join(len(c).to_bytes(8, "big") + n.to_bytes(8, "big") + c for c, n in run[i : i + BLOCKS])) for i in range(0, len(run), BLOCKS)]

    def loaded(names: list[str]) -> Iterator[tuple[bytes, int]]:
        for name in names:
            data, at = files.take(name), 0
            while at < len(data):
                n = int.from_bytes(data[at : at + 8], "big")
                yield data[at + 16 : at + 16 + n], int.from_bytes(data[at + 8 : at + 16], "big")
                at += 16 + n

    for k, start in enumerate(starts):
        end = starts[k + 1] + 1 if k + 1 < len(starts) else len(text)
        # Symbol, then type: at the same symbol an L suffix is the smaller one. Past the end comes less than anything.
        if width == 1:
            content = bytearray(2 * (end - start))
            content[::2], content[1::2] = text[start:end], types[start:end]
            content = bytes(content)
        else:
            content = b"".join(text[i].to_bytes(4, "big") + types[i : i + 1] for i in range(start, end))
        own.append((content, k))
        size += len(content) + 100
        if size > held * 50:
            runs.append(stored(sorted(own)))
            own, size = [], 0
    own.sort()
    return heapq.merge(own, *map(loaded, runs)) if runs else iter(own)


def sort(text: Sequence[int], files: Files, *, most: int = 0, held: int = HELD) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the one before, at most ``most``) of all suffixes, in descending order of suffixes."""
    n = len(text)
    if n == 0:
        return
    types = bytearray(n)  # 1: S. The last suffix is L: what follows the end is less than anything.
    starts = array("q")
    after, was = text[n - 1], 0
    for i in range(n - 2, -1, -1):
        c = text[i]
        s = 1 if c < after or (c == after and was) else 0
        types[i] = s
        if was and not s:
            starts.append(i + 1)
        after, was = c, s
    starts.reverse()
    # Block starts in ascending order of their suffixes.
    name, names, last = -1, array("q", bytes(8 * len(starts))), None
    for content, k in _blocks(text, types, starts, files, held):
        if content != last:
            name, last = name + 1, content
        names[k] = name
    if name + 1 == len(starts):
        order = array("q", bytes(8 * len(starts)))
        for k, at in enumerate(names):
            order[at] = k
    else:
        order = array("q", (k for k, _ in sort(names, files, held=held)))
        order.reverse()
    # Ascending pass: seeds and the end give all L suffixes.
    seeds = Queue(files, True, held)
    upward, least = Queue(files, False, held), _Least()
    carry = most > 0
    # L suffixes in ascending order, kept for the descending pass by their symbol.
    found: dict[int, list] = {}
    tails: dict[int, array] = {}
    held_l = 0
    at, previous = 0, -1
    upward.push(text[n - 1], n - 1, 0)

    def induce(position: int, prefix: int) -> None:
        if carry:
            least.step(prefix)
        if position and not types[position - 1]:
            c = text[position - 1]
            upward.push(c, position - 1, max(0, least.induced(c, most)) if carry else 0)

    if carry:  # the end of the text comes before all suffixes and put the last one
        least.last[text[n - 1]] = 0
    while True:
        seed = text[starts[order[at]]] if at < len(order) else None
        symbol = upward.pop_symbol(seed)
        if symbol is not None:
            own = tails.get(symbol)
            if own is None:
                own = tails[symbol] = array("q")
            first = True
            for position, prefix in upward.drain(symbol):
                prefix = 0 if first else prefix
                first = False
                own.append(position)
                own.append(prefix)
                held_l += 1
                induce(position, prefix)
                previous = position
            if held_l >= held:
                for s, x in tails.items():
                    if len(x):
                        found.setdefault(s, []).append(files.put(x.tobytes()))
                tails, held_l = {}, 0
        elif seed is not None:
            # Seeds of one symbol come after all its L suffixes.
            while at < len(order) and text[starts[order[at]]] == seed:
                position = starts[order[at]]
                induce(position, _common(text, previous, position, most) if carry and previous >= 0 else 0)
                previous = position
                at += 1
        else:
            break
    # Descending pass: L suffixes, from the largest, give all S suffixes.
    downward, least = seeds, _Least()
    symbols = sorted({*found, *tails}, reverse=True)
    at, previous, first_of_all = 0, -1, True

    def out(position: int, prefix: int) -> tuple[int, int]:
        if carry:
            least.step(prefix)
        if position and types[position - 1]:
            c = text[position - 1]
            downward.push(c, position - 1, max(0, least.induced(c, most)) if carry else 0)
        return position, prefix

    while True:
        top = symbols[at] if at < len(symbols) else None
        symbol = downward.pop_symbol(top)
        if symbol is not None:
            first = True
            for position, prefix in downward.drain(symbol):
                yield out(position, 0 if first else prefix)
                first, previous = False, position
            # The border to the L suffixes of the same symbol is compared below.
        elif top is not None:
            own = [tails.pop(top, array("q"))]
            blocks = found.pop(top, [])
            shared_next = None  # the common prefix that the larger neighbour carried
            while own or blocks:
                if own:
                    entries = own.pop()
                else:
                    entries = array("q")
                    entries.frombytes(files.take(blocks.pop()))
                for i in range(len(entries) - 2, -2, -2):
                    position, prefix = entries[i], entries[i + 1]
                    if shared_next is None:
                        share = _common(text, previous, position, most) if carry and previous >= 0 else 0
                    else:
                        share = shared_next
                    shared_next = prefix
                    yield out(position, share)
                    previous = position
            at += 1
        else:
            break


def _words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zero past the end."""
    word, size = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64), 1
    while size < 8:
        word = word[:-size] << np.uint64(8 * size) | word[size:]
        size *= 2
    return np.concatenate((word[: len(text)], np.zeros(1, np.uint64)))


def _commons(word: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of the suffixes at a and b, at most ``most``."""
    n = len(word) - 1
    out = np.zeros(len(a), np.int64)
    room = np.minimum(most, n - np.maximum(a, b))
    left = np.arange(len(a))
    for k in range(0, most, 8):
        x = word[np.minimum(a[left] + k, n)] ^ word[np.minimum(b[left] + k, n)]
        equal = x == 0
        apart = left[~equal]
        # Equal leading bytes of words that differ: from the exponent of what differs.
        top = np.frexp((x[~equal] >> np.uint64(11)).astype(float))[1] + 11
        low = x[~equal] < 1 << 11
        out[apart] = k + np.where(low, 6 + (x[~equal] < 1 << 8), (64 - top) // 8)
        left = left[equal]
        if not len(left):
            break
    out[left] = most
    return np.minimum(out, room)


def _ordered(text: np.ndarray, types: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Numbers of block starts in ascending order of their suffixes, as far as ``most`` symbols tell."""
    m, n = len(starts), len(text)
    ends = np.append(starts[1:] + 1, n + 1)  # the last block holds the end of the text, a symbol less than all
    size = (ends - starts)[:m]
    # Nine bits a symbol with its type, 0 past the end; the largest symbol is never S.
    coded = np.concatenate((text.astype(np.uint64) * 2 + types + 1, np.zeros(8, np.uint64)))
    sevens = np.zeros(n + 1, np.uint64)
    for j in range(7):
        sevens = sevens << np.uint64(9) | coded[j : j + n + 1]
    mask = [np.uint64(((1 << 9 * j) - 1) << 9 * (7 - j)) for j in range(8)]
    masks = np.array(mask, np.uint64)

    def refined(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
        """Ranks, the place of a group's first, of the groups in ``some`` by a further key; in place."""
        order = np.lexsort((key, rank[some]))
        own, key = some[order], key[order]
        group = np.r_[True, rank[own][1:] != rank[own][:-1]]
        new = group | np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(own))
        begin = np.maximum.accumulate(np.where(group, at, 0))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[own] += first - begin

    # Names: blocks by their symbols, seven at a time; no block is the beginning of another.
    rank = np.zeros(m, np.int64)
    some, k = np.arange(m), 0
    while len(some):
        refined(rank, some, sevens[np.minimum(starts[some] + k, n)] & masks[np.clip(size[some] - k, 0, 7)])
        k += 7
        some = some[size[some] > k]
    # Doubling: a name and those after it; each stands for two symbols at least.
    step = 1
    while 2 * step < most + 2:
        times = np.bincount(rank, minlength=m)
        some = np.flatnonzero(times[rank] > 1)
        if not len(some):
            break
        after = some + step
        refined(rank, some, np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0))
        step *= 2
    return np.argsort(rank, kind="stable")


class _Queues:
    """Entries (position, common prefix) by symbol, put as arrays, first come first out."""

    def __init__(self, text: np.ndarray, most: int):
        self.text, self.most = text, most
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        #: The least common prefix scanned since a symbol last got an entry; -1: it has none.
        self.low = np.full(256, -1, np.int64)

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        own, self.held[symbol] = self.held[symbol], []
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*own, strict=True))

    def scan(self, position: np.ndarray, prefix: np.ndarray, wanted: np.ndarray) -> None:
        """The next suffixes of the scan; those before the ``wanted`` are put into their queues."""
        self._advance(position, prefix, np.flatnonzero(wanted))

    def _advance(self, position: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> None:
        before = position[at] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        new = np.r_[True, symbol[1:] != symbol[:-1]] if len(at) else np.zeros(0, bool)
        since = np.where(new, 0, np.r_[0, at[:-1] + 1]) if len(at) else at
        least = _range_least(prefix, since, at)
        had = self.low[symbol]
        least = np.where(new, np.where(had < 0, -1, np.minimum(least, had)), least)
        share = np.where(least < 0, 0, np.minimum(least + 1, self.most))
        whole = prefix.min() if len(prefix) else self.most
        self.low = np.where(self.low >= 0, np.minimum(self.low, whole), self.low)
        if not len(at):
            return
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        # After its last entry a symbol has seen only what follows in this scan.
        tails = np.minimum.accumulate(np.append(prefix, self.most)[::-1])[::-1]
        self.low[symbol[last]] = tails[at[last] + 1]
        for a, b in zip(first.tolist(), (last + 1).tolist(), strict=True):
            self.held[symbol[a]].append((before[a:b], share[a:b]))


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], both included, for each pair, from minima over powers of two."""
    length = high - low + 1
    level = np.frexp(length.astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, size = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] + 1 - size])
        if len(table) > size:
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def sort_held(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, common prefixes with the one before, at most ``most``) of all suffixes of bytes, in descending order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # S where the next different symbol is larger; what follows the end is less than anything.
    differs = np.flatnonzero(text[1:] != text[:-1])
    after = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]
    types = np.append(text[1:] > text[:-1], False)[after]
    starts = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    word = _words8(text)
    seeds = starts[_ordered(text, types, starts, most)]
    shares = np.zeros(len(seeds), np.int64)
    shares[1:] = _commons(word, seeds[:-1], seeds[1:], most)
    of = np.searchsorted(text[seeds], np.arange(257))  # seeds are in order of their symbols
    is_l = np.append(~types, False)  # of the suffix before; none is before the first
    upward = _Queues(text, most)
    upward.held[text[n - 1]].append((np.array([n - 1]), np.array([0])))
    upward.low[text[n - 1]] = 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for symbol in range(256):
        own, last = [], -1
        while True:
            position, prefix = upward.take(symbol)
            if not len(position):
                break
            if last < 0:
                prefix[0] = 0
            own.append((position, prefix))
            last = int(position[-1])
            upward.scan(position, prefix, is_l[position - 1])
        found.append(tuple(np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 2)
        position, prefix = seeds[of[symbol] : of[symbol + 1]], shares[of[symbol] : of[symbol + 1]].copy()
        if len(position):
            prefix[0] = _commons(word, np.array([last]), position[:1], most)[0] if last >= 0 else 0
            upward.scan(position, prefix, is_l[position - 1])
    downward, out = _Queues(text, most), []
    is_s = np.append(types, False)
    for symbol in range(255, -1, -1):
        last = -1
        while True:
            position, prefix = downward.take(symbol)
            if not len(position):
                break
            if last < 0:
                prefix[0] = 0
            out.append((position, prefix))
            last = int(position[-1])
            downward.scan(position, prefix, is_s[position - 1])
        position, prefix = (x[::-1] for x in found[symbol])
        if len(position):
            share = _commons(word, np.array([last]), position[:1], most)[0] if last >= 0 else 0
            prefix = np.append(share, prefix[:-1])
            out.append((position, prefix))
            downward.scan(position, prefix, is_s[position - 1])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
