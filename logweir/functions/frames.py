"""Headers of version-2 record batches as column expressions, and base-offset stamping of payloads.

Layout used: base offset in bytes 0-7, length of what follows byte 12 in 8-11, magic 2 in 16,
record count in 57-60; a batch has 61 bytes at least.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 61


def _number(data: Column, start: int, size: int) -> Column:
    """Big-endian signed number of 4 or 8 bytes, from a 0-based position."""
    text = F.hex(F.substring(data, start + 1, size))
    if size == 4:
        raw = F.conv(text, 16, 10).cast("long")
        return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)
    hi = F.conv(F.substring(text, 1, 8), 16, 10).cast("long")
    lo = F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(F.when(hi >= 1 << 31, hi - (1 << 32)).otherwise(hi), 32).bitwiseOR(lo)


def is_batch(data: Column) -> Column:
    return F.coalesce((F.octet_length(data) >= HEADER) & (F.hex(F.substring(data, 17, 1)) == "02"), F.lit(False))


def record_count(data: Column) -> Column:
    """Records of the first batch; 1 for anything that is not a batch or counts none."""
    return F.when(is_batch(data), F.greatest(_number(data, 57, 4), F.lit(1))).otherwise(F.lit(1)).cast("int")


def base_offset(data: Column) -> Column:
    return F.when(is_batch(data), _number(data, 0, 8))


def stamp_first(data: Column, base: Column) -> Column:
    """The payload with its first eight bytes set to the base offset."""
    raw = F.unhex(F.lpad(F.hex(base.cast("long")), 16, "0"))
    return F.when(F.octet_length(data) >= 8, F.concat(raw, F.substring(data, F.lit(9), F.octet_length(data) - 8))).otherwise(data)


def stamp_all(payload: bytes, base: int) -> bytes:
    """Each concatenated batch gets the next offset; a malformed tail stays, and a payload without
    any batch is stamped once."""
    out, at, nxt = bytearray(payload), 0, base
    while at + HEADER <= len(out) and out[at + 16] == 2:
        length = struct.unpack_from(">i", out, at + 8)[0]
        if length < HEADER - 12 or at + 12 + length > len(out):
            break
        count = struct.unpack_from(">i", out, at + 57)[0]
        struct.pack_into(">q", out, at, nxt)
        nxt, at = nxt + max(1, count), at + 12 + length
    if at == 0 and len(out) >= 8:
        struct.pack_into(">q", out, 0, base)
    return bytes(out)
