"""Columns of parsed alignment records."""

from __future__ import annotations

RAW = (
    "line_no long, line string, qname string, flag int, rname string, pos long, mapq int, cigar string, "
    "rnext string, pnext long, tlen int, seq string, qual string, tags array<string>"
)
UNMAPPED, DISCORDANT = "unmapped", "discordant"
#: FLAG bits.
PAIRED, READ_UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40
SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x100, 0x400, 0x800
