"""Counts of many small integers: arrays of mappers, added up in a tree, and a minimal perfect hash over known keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv

U64 = np.uint64
#: What a mapper sends: for each block of its array the places that aren't zero, as distances, and the counts there.
PART = "block int, mapper int, at binary, n binary"
#: Arrays that one task adds up.
FAN = 32


def _narrow(values: np.ndarray) -> bytes:
    """Values that aren't negative, in as few bytes each as the greatest needs; a byte says how many."""
    size = next(n for n in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * n - 1))
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def packed(block: int, mapper: int, at: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A row of PART from ascending places and their counts."""
    return block, mapper, _narrow(np.diff(at, prepend=0)), _narrow(n)


def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_wide(at)), _wide(n)


def by_block(values: np.ndarray, block_bits: int, mapper: int) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of PART that count values, which are places in an array of blocks of 2 ** block_bits."""
    at, n = np.unique(values, return_counts=True)
    block = at >> block_bits
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(at) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(at)]
    return [packed(int(block[a]), mapper, at[a:b] & ((1 << block_bits) - 1), n[a:b]) for a, b in zip(cut.tolist(), ends, strict=True)]


def tree_sum(parts: DataFrame) -> DataFrame:
    """parts (PART, written) added up, FAN mappers at a time, to one row a block."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(0, np.int64)
        for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True):
            at, n = unpacked(at, n)
            if len(at) and at[-1] >= len(total):
                total = np.concatenate((total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)))
            total[at] += n
        at = np.flatnonzero(total)
        row = packed(key[0].as_py(), key[1].as_py(), at, total[at])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["block", "mapper", "at", "n"])

    mappers = parts.agg(F.max("mapper")).first()[0] or 0
    while True:
        parts = parts.groupBy("block", F.floor(F.col("mapper") / FAN).cast("int").alias("up")).applyInArrow(add, PART)
        mappers //= FAN
        if not mappers:
            return parts


class Slots:
    """A minimal perfect hash: n different 128-bit keys have the slots 0 to n - 1; another key's slot is refused, as the key stored there is a different one.

    What is stored of a key is 64 bits that all of its 128 are mixed into.

    At each level a key whose place no other key has takes it, the rest go on
    to the next level; a key's slot is the number of taken places before its own.
    """

    #: Places for each key that is left at a level.
    GAMMA = 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, stored: np.ndarray):
        self.sizes, self.bits, self.stored = sizes, bits, stored
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tv.mix(a ^ tv.mix(b + U64(level))) % U64(size)).astype(np.int64)

    @staticmethod
    def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tv.mix(a + tv.mix(b * U64(3) + U64(1)))

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Slots:
        """The hash of keys (a, b), which must differ; the keys are stored in the order of slots."""
        left, sizes, taken, at = np.arange(len(a)), [], [], 0
        while len(left):
            if len(sizes) == 200:  # different keys part long before
                raise ValueError("keys must differ")
            size = -(-max(len(left) * cls.GAMMA, 64) // 64) * 64
            place = cls._place(a[left], b[left], len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            taken.append(at + place[alone])
            left, at = left[~alone], at + size
            sizes.append(size)
        places = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        bits = np.zeros(at >> 6, U64)
        np.bitwise_or.at(bits, places >> 6, U64(1) << (places & 63).astype(U64))
        made = cls(np.array(sizes, np.int64), bits, np.zeros(len(a), U64))
        made.stored[made.candidates(a, b)] = cls._mixed(a, b)
        return made

    def candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The only slot that each key can have, -1 for none."""
        slot = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            place = self._place(a[left], b[left], level, size) + self.starts[level]
            word, bit = self.bits[place >> 6], (place & 63).astype(U64)
            here = (word >> bit) & U64(1) == 1
            at = np.flatnonzero(here)
            below = np.bitwise_count(word[at] & ((U64(1) << bit[at]) - U64(1)))
            slot[left[at]] = self.before[place[at] >> 6] + below
            left = left[~here]
        return slot

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't one of the n: its own stored key decides."""
        slot = self.candidates(a, b)
        at = np.flatnonzero(slot >= 0)
        slot[at[self.stored[slot[at]] != self._mixed(a[at], b[at])]] = -1
        return slot


SLOTS = "part int, sizes binary, bits binary, stored binary, known binary"


def slot_tables(keys: DataFrame, parts: int) -> DataFrame:
    """(SLOTS): a perfect hash for each part of keys (a, b, known), dealt by a; known, by slot, are counts that are there already."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (table[c].to_numpy().view(U64) for c in "ab")
        slots = Slots.of(a, b)
        known = np.zeros(len(a), np.int64)
        known[slots(a, b)] = table["known"].to_numpy()
        row = [key[0].as_py(), *(x.tobytes() for x in (slots.sizes, slots.bits, slots.stored)), _narrow(known)]
        return pa.Table.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(row)], [c.split()[0] for c in SLOTS.split(", ")])

    return keys.select(F.pmod("a", F.lit(parts)).cast("int").alias("part"), "a", "b", "known").groupBy("part").applyInArrow(build, SLOTS)


def loaded(row) -> tuple[Slots, np.ndarray]:
    """The hash and known counts of a row of SLOTS."""
    return Slots(np.frombuffer(row.sizes, np.int64), np.frombuffer(row.bits, U64), np.frombuffer(row.stored, U64)), _wide(row.known)


class Bits:
    """Places of an array that reach a count, as a bitmap."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def reached(sums: DataFrame, bits: int, block_bits: int, least: int) -> Bits:
    """The places of 2 ** bits whose counts (PART, added up) reach ``least``: a bitmap of 2 ** (bits - 3) bytes in the driver."""

    def pack(batches):
        for batch in batches:
            out = []
            for at, n in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), strict=True):
                at, n = unpacked(at, n)
                flags = np.zeros(1 << block_bits, bool)
                flags[at[n >= least]] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(out, pa.binary())], ["block", "flags"])

    data = np.zeros(1 << bits - 3, np.uint8)
    for row in sums.mapInArrow(pack, "block int, flags binary").collect():
        data[row.block << block_bits - 3 : row.block + 1 << block_bits - 3] = np.frombuffer(row.flags, np.uint8)
    return Bits(bits, data)


def bits_for(docs: DataFrame, column: str, bytes_each: int, least: int, most: int) -> int:
    """The power of two next above a text's bytes over ``bytes_each``, between two bounds."""
    return bits_of(docs.select(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0, bytes_each, least, most)


def bits_of(total: int, bytes_each: int, least: int, most: int) -> int:
    return int(np.clip(int(total // bytes_each).bit_length(), least, most))


def dropped(*tables: DataFrame) -> None:
    for table in tables:
        shared.dropped(table)
