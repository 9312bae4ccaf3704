"""Deterministic records for load and replay checks.

A key is partition (4 bytes) and sequence (8), big-endian. A value is MAGIC, partition, sequence, the
seed of both (8) and then bytes that follow from the seed, so a consumer can tell each kind of damage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fnv import LIMB, big_endian_32, big_endian_64, hex64, limbs, mix64, xor

MAGIC = b"LOGWEIR1"
HEADER = 28


def seed(part: Column, seq: Column) -> Column:
    """struct(hi, lo) of the 64-bit seed."""
    seq = seq.cast("long")
    return mix64(limbs(part.cast("long").bitwiseXOR(F.call_function("shiftrightunsigned", seq, F.lit(32))), F.pmod(seq, F.lit(LIMB))))


def record_key(part: Column, seq: Column) -> Column:
    return F.concat(big_endian_32(part), big_endian_64(seq))


def record_value(part: Column, seq: Column, size: int, fast: bool = False) -> Column:
    """size bytes, HEADER at least. fast: the body repeats the seed's last byte."""
    if size < HEADER:
        raise ValueError(f"a record has {HEADER} bytes at least")

    def whole(s: Column) -> Column:
        head = F.concat(F.lit(MAGIC), big_endian_32(part), big_endian_64(seq), F.unhex(hex64(s)))
        if size == HEADER:
            return head
        places = F.sequence(F.lit(0), F.lit(size - HEADER - 1))
        byte = lambda h: F.lpad(F.hex(h["lo"] % 256), 2, "0")
        body = F.repeat(byte(s), size - HEADER) if fast else F.array_join(F.transform(places, lambda i: byte(mix64(xor(s, limbs(F.lit(0), i))))), "")
        return F.concat(head, F.unhex(body))

    return F.element_at(F.transform(F.array(seed(part, seq)), whole), 1)


def _unsigned(data: Column, start: int, size: int) -> Column:
    """Big-endian number from a 0-based place; one beyond 2^63 wraps around."""
    text = F.hex(F.substring(data, start + 1, size))
    if size == 4:
        return F.conv(text, 16, 10).cast("long")
    hi, lo = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def parse_key(key: Column) -> Column:
    """struct(part, seq), or null."""
    return F.when(F.octet_length(key) == 12, F.struct(_unsigned(key, 0, 4).alias("part"), _unsigned(key, 4, 8).alias("seq")))


def parse_value(value: Column) -> Column:
    """struct(part, seq, seed as 16 hex digits), or null."""
    fits = (F.octet_length(value) >= HEADER) & (F.hex(F.substring(value, 1, 8)) == MAGIC.hex().upper())
    return F.when(fits, F.struct(_unsigned(value, 8, 4).alias("part"), _unsigned(value, 12, 8).alias("seq"), F.lower(F.hex(F.substring(value, 21, 8))).alias("seed")))
