"""Scalar functions of a record's columns. Nulls give null unless stated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIRST, MATE_REVERSE, MATE_UNMAPPED, PAIRED, READ_UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY

#: Bases below this quality don't count, and a score has this upper bound.
LEAST_QUALITY, MOST_SCORE = 15, 16383


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def with_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseOR(F.lit(bits)).cast("int")


def is_paired(flag: Column) -> Column:
    """Paired, with a mapped mate."""
    return flag.bitwiseAND(F.lit(PAIRED | MATE_UNMAPPED)) == PAIRED


def is_primary_mapped(flag: Column) -> Column:
    """Neither unmapped nor secondary nor supplementary: may be marked."""
    return flag.bitwiseAND(F.lit(READ_UNMAPPED | SECONDARY | SUPPLEMENTARY)) == 0


def end_number(flag: Column) -> Column:
    return F.when(has_bits(flag, FIRST), 1).otherwise(2).cast("int")


def strand(flag: Column) -> Column:
    """1 for the reverse strand."""
    return has_bits(flag, REVERSE).cast("int")


def mate_strand(flag: Column) -> Column:
    return has_bits(flag, MATE_REVERSE).cast("int")


def reference_length(cigar: Column) -> Column:
    """Reference bases that the operations M D N X = cover."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDNX=]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def alignment_end(pos: Column, cigar: Column) -> Column:
    return pos + reference_length(cigar) - 1


def _clip(cigar: Column, pattern: str) -> Column:
    found = F.regexp_extract(cigar, pattern, 1)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("long")).cast("long")


def unclipped_end(pos: Column, cigar: Column) -> Column:
    """The end with the last operation added, if that is a clip."""
    return alignment_end(pos, cigar) + _clip(cigar, r"(\d+)[SH]$")


def unclipped_start(pos: Column, cigar: Column) -> Column:
    """The position with the first operation taken off, if that is a clip."""
    return pos - _clip(cigar, r"^(\d+)[SH]")


def unclipped_five_prime(flag: Column, pos: Column, cigar: Column) -> Column:
    """The unclipped 5' position; 0 for a record without CIGAR."""
    return F.when(cigar == "*", F.lit(0).cast("long")).when(has_bits(flag, REVERSE), unclipped_end(pos, cigar)).otherwise(unclipped_start(pos, cigar))


#: What each byte of a quality string adds to a score.
_ADDS = np.where((np.arange(256) >= 33 + LEAST_QUALITY) & (np.arange(256) < 127), np.arange(256) - 33, 0).astype(np.int64)


def _scores(qual: pa.Array) -> pa.Array:
    """Scores of a column of quality strings: one look at each byte, no object for a string."""
    if not len(qual):
        return pa.array([], pa.int32())
    _, offsets, data = qual.fill_null("").cast(pa.large_string()).buffers()
    ends = np.frombuffer(offsets, np.int64, len(qual) + 1)
    total = np.concatenate(([0], np.cumsum(_ADDS[np.frombuffer(data or b"", np.uint8)[: ends[-1]]])))
    score = np.minimum(total[ends[1:]] - total[ends[:-1]], MOST_SCORE)
    return pa.array(score, pa.int32(), mask=qual.is_null().to_numpy(zero_copy_only=False))


def quality_score(qual: Column) -> Column:
    """Sum of qualities of 15 and more, 16383 at most, by an Arrow function over whole columns."""
    return F.arrow_udf(_scores, "int")(qual)


def pair_orientation(first: Column, second: Column) -> Column:
    """Strands of both ends: 2 FF, 3 FR, 4 RR, 5 RF."""
    return F.when(first == 0, F.when(second == 0, 2).otherwise(3)).otherwise(F.when(second == 1, 4).otherwise(5)).cast("int")


def orientation(flag: Column, paired: Column) -> Column:
    """0 or 1 of a single read, 2 to 5 of a paired one by its own flag."""
    return F.when(paired, pair_orientation(strand(flag), mate_strand(flag))).otherwise(strand(flag))


def location(qname: Column) -> Column:
    """The last two fields of a read name as struct (x, y); null where they are no numbers."""
    part = F.split(qname, ":")
    return F.struct(F.try_element_at(part, F.lit(-2)).try_cast("int").alias("x"), F.try_element_at(part, F.lit(-1)).try_cast("int").alias("y"))


def tag_value(tags: Column, name: str) -> Column:
    """The text after the first tag that starts with ``name``; null without one."""
    return F.substring(F.get(F.filter(tags, lambda x: x.startswith(name)), F.lit(0)), len(name) + 1, 1 << 30)


def name_key(qname: Column) -> Column:
    """Key of the sort by name: up to 16 digits after the last letter, read as hexadecimal; 0 without digits.

    A name without letters loses its first character.
    """
    tail = F.when(qname.rlike("[A-Za-z]"), F.regexp_extract(qname, r"([^A-Za-z]*)$", 1)).otherwise(F.substring(qname, 2, 1 << 30))
    digits = F.substring(F.regexp_replace(tail, "[^0-9]", ""), 1, 16)
    return F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 16, 10).cast("decimal(20,0)")).cast("long")


def duplicate_line(line: Column, flag: Column) -> Column:
    """The record's text with the duplicate bit set in its second field."""
    rest = F.substr(line, F.char_length(F.substring_index(line, "\t", 2)) + 1)
    return F.concat(F.substring_index(line, "\t", 1), F.lit("\t"), flag.bitwiseOR(F.lit(0x400)).cast("string"), rest)
