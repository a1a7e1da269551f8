"""Reading block-gzipped text in ranges: blocks are gzip members that state their own size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: How every block begins, with one extra field of six bytes, fixed by the format.
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
#: The empty block that ends a file, fixed by the format.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: A block, and so the distance from any place to the next block's start, is at most this long.
LONGEST = 1 << 16


def size_at(data: bytes, at: int = 0) -> int:
    """The size of the block whose first 18 bytes stand at a place; 0 if none does."""
    head = data[at : at + 18]
    if len(head) < 18 or head[:4] != MAGIC or head[10:12] != b"\x06\x00" or head[12:16] != FIELD:
        return 0
    return int.from_bytes(head[16:18], "little") + 1


def is_blocked(file) -> bool:
    file.seek(0)
    return size_at(file.read(18)) > 0


def first_block(file, start: int, end: int) -> int | None:
    """The first block that starts in [start, end): a place whose bytes inflate, with the right check sum, as the block they claim to be."""
    if start == 0:
        return 0
    file.seek(start)
    data = file.read(min(end - start, LONGEST) + LONGEST)
    at = data.find(MAGIC)
    while 0 <= at < end - start:
        if size := size_at(data, at):
            try:
                zlib.decompress(data[at : at + size], 31)
                return start + at
            except zlib.error:
                pass
        at = data.find(MAGIC, at + 1)
    return None


def inflated(file, at: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the blocks from a place on; raises where a block is cut off."""
    file.seek(at)
    held, off = b"", 0
    while True:
        size = size_at(held, off)
        if not size or off + size > len(held):
            data = file.read(step)
            held, off = held[off:] + data, 0
            if not data:
                if held:
                    raise EOFError(f"the block at {at} is cut off")
                return
            continue
        yield at, zlib.decompress(held[off : off + size], 31)
        at, off = at + size, off + size


def texts(file, start: int, end: int, step: int = 4 << 20, skip: int | None = None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Whole lines of a range of the compressed file, with the places (see columns.Chunk) of their numbers.

    A line's number is its block's place shifted by 16 bits, and the place in
    its text.  The line that the first newline of a range's blocks ends belongs
    to the range before; with ``skip`` a block starts at start, and its lines do
    after so many bytes of its text.
    """
    at = first_block(file, start, end) if skip is None else start
    if at is None:
        return
    skipping, held, pieces, bases, size = start > 0 and skip is None, [], [], [], 0

    def joined(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        return b"".join(parts), np.array(pieces), np.array(bases)

    for place, text in inflated(file, at):
        base, over = place << 16, place >= end
        if skip:
            text, base, skip = text[skip:], base + skip, 0
        if skipping:
            cut = text.find(b"\n") + 1
            if not cut:
                if over:
                    return
                continue
            if over:
                return
            skipping, text, base = False, text[cut:], base + cut
        if over:
            cut = text.find(b"\n") + 1
            text = text[: cut or len(text)]
        if text:
            held.append(text)
            pieces.append(size)
            bases.append(base)
            size += len(text)
        if over and cut:
            break
        if size >= step:
            cut = text.rfind(b"\n") + 1
            if cut:
                yield joined([*held[:-1], text[:cut]])
                held, pieces, bases, size = ([text[cut:]], [0], [base + cut], len(text) - cut) if cut < len(text) else ([], [], [], 0)
    if size:
        yield joined(held)


def lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(number, line) of the lines of a range."""
    for data, pieces, bases in texts(file, start, end):
        at = 0
        for line in data.split(b"\n"):
            if at < len(data):
                k = int(np.searchsorted(pieces, at, "right")) - 1
                yield int(bases[k]) + at - int(pieces[k]), line
            at += len(line) + 1


def ended(file) -> bool:
    """Whether a file's last block is the empty one that marks its end."""
    size = file.size()
    if size < len(END):
        return False
    file.seek(size - len(END))
    return file.read(len(END)) == END


def seek(file, place: int) -> Iterator[bytes]:
    """The text from a line's number (block's place shifted by 16 bits, and the place in its text) on, block by block."""
    skip = place & 0xFFFF
    for _, text in inflated(file, place >> 16):
        yield text[skip:]
        skip = 0
