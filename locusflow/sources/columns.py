"""SAM text as Arrow columns: places of newlines and tabs over a whole chunk, columns cut from its bytes, no object a record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MANDATORY = 11
#: The place of each named field in a record.
FIELDS = {name: i for i, name in enumerate(("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"))}
NUMBERS = {"flag": pa.int32(), "pos": pa.int64(), "mapq": pa.int32(), "pnext": pa.int64(), "tlen": pa.int32()}
NEWLINE, TAB, RETURN, AT = 10, 9, 13, 64


class Chunk:
    """Whole lines of a file.

    pieces and bases say where lines are: what starts at place o of the data, in
    the piece that starts at p with base b, has the number b + o - p.  Empty and
    blank lines and those of the header are left out; fields that a line lacks
    are empty, numbers that are none or don't fit are 0.
    """

    def __init__(self, data: bytes, pieces: np.ndarray, bases: np.ndarray):
        self.data = raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == NEWLINE)
        starts = np.concatenate(([0], ends + 1))
        ends = np.concatenate((ends, [len(raw)]))
        while len(at := np.flatnonzero((ends > starts) & (raw[np.maximum(ends - 1, 0)] == RETURN))):
            ends[at] -= 1
        keep = ends > starts
        first = raw[np.minimum(starts, max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(starts), np.uint8)
        keep &= first != AT
        for i in np.flatnonzero(keep & (first <= 0x20)).tolist():
            keep[i] = bool(data[starts[i] : ends[i]].strip())
        self.starts, self.ends = starts[keep], ends[keep]
        piece = np.searchsorted(pieces, self.starts, "right") - 1
        self.line_no = bases[piece] + self.starts - pieces[piece]
        self.tabs = np.append(np.flatnonzero(raw == TAB), len(raw))
        self.first = np.searchsorted(self.tabs, self.starts)
        self.count = np.searchsorted(self.tabs[:-1], self.ends) - self.first

    def where(self, keep: np.ndarray) -> None:
        """Leave only some of the lines."""
        for name in ("starts", "ends", "line_no", "first", "count"):
            setattr(self, name, getattr(self, name)[keep])

    def _tab(self, at: np.ndarray) -> np.ndarray:
        return self.tabs[np.minimum(at, len(self.tabs) - 1)]

    def field(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of a field of each line."""
        start = self.starts if i == 0 else np.where(self.count >= i, self._tab(self.first + i - 1) + 1, self.ends)
        return start, np.where(self.count > i, self._tab(self.first + i), self.ends)

    def text(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        size = end - start
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = self.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        out = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # not UTF-8
            raw = data.tobytes()
            return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
        return out

    def number(self, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Decimal numbers of up to 18 digits, with a sign or without."""
        byte = lambda at: self.data[np.minimum(at, max(len(self.data) - 1, 0))]
        sign = byte(start)
        start = start + ((sign == ord("-")) | (sign == ord("+"))) * (end > start)
        size = end - start
        good, value = (size > 0) & (size <= 18), np.zeros(len(start), np.int64)
        for i in range(int(size[good].max(initial=0))):
            at = np.flatnonzero(good & (i < size))
            digit = byte(start[at] + i).astype(np.int64) - 48
            good[at[(digit < 0) | (digit > 9)]] = False
            value[at] = value[at] * 10 + digit
        value = np.where(good, np.where(sign == ord("-"), -value, value), 0)
        if kind == pa.int32():
            value = np.where(np.abs(value) < 1 << 31, value, 0)
        return pa.array(value, kind)

    def tags(self) -> pa.Array:
        count = np.maximum(self.count - MANDATORY + 1, 0)
        ends = np.concatenate(([0], np.cumsum(count)))
        owner = np.repeat(np.arange(len(count)), count)
        at = self.first[owner] + MANDATORY - 1 + np.arange(ends[-1]) - ends[:-1][owner]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.text(self._tab(at) + 1, np.minimum(self._tab(at + 1), self.ends[owner])))

    def column(self, name: str) -> pa.Array:
        if name == "line_no":
            return pa.array(self.line_no)
        if name == "line":
            return self.text(self.starts, self.ends)
        if name == "tags":
            return self.tags()
        bounds = self.field(FIELDS[name])
        return self.number(*bounds, NUMBERS[name]) if name in NUMBERS else self.text(*bounds)

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.column(n) for n in names], names)


#: Comparisons that a scan can make, by the name of the filter's class.
TESTS = {
    "EqualTo": pc.equal, "GreaterThan": pc.greater, "GreaterThanOrEqual": pc.greater_equal, "LessThan": pc.less, "LessThanOrEqual": pc.less_equal,
    "In": lambda column, values: pc.is_in(column, pa.array(list(values), column.type)), "StringStartsWith": pc.starts_with,
}


def handled(kind: str, column: tuple[str, ...], value) -> bool:
    """Whether a scan can apply a filter: any of TESTS on a number or text column; that a column isn't null always holds."""
    if len(column) != 1 or column[0] in ("tags",) or kind == "IsNotNull":
        return kind == "IsNotNull" and len(column) == 1
    values = list(value) if kind == "In" else [value]
    number = column[0] in NUMBERS or column[0] == "line_no"
    fits = (lambda v: type(v) is int and abs(v) < (1 << 31 if NUMBERS.get(column[0]) == pa.int32() else 1 << 63)) if number else (lambda v: isinstance(v, str))
    return kind in TESTS and all(map(fits, values)) and (number or kind in ("EqualTo", "In", "StringStartsWith")) and not (number and kind == "StringStartsWith")


def passed(chunk: Chunk, tests: list[tuple[str, str, object]]) -> None:
    """Leave the lines of a chunk that pass all tests (kind, column, value)."""
    for kind, column, value in tests:
        chunk.where(TESTS[kind](chunk.column(column), value).to_numpy(zero_copy_only=False).astype(bool))
