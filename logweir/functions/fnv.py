"""64-bit FNV-1a and splitmix as column expressions.

Spark has no unsigned type, so a 64-bit value is two 32-bit limbs in BIGINT, struct(hi, lo). The FNV
prime is 2^40 + 435: multiplying shifts the low limb into the high one and multiplies both by 435.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a.
BASIS_HI, BASIS_LO, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
# Fixed values of splitmix64: increment, multipliers, shifts.
GOLDEN, FACTORS, SHIFTS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)
LIMB = 1 << 32
WORD = 1 << 16


def limbs(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def constant(value: int) -> Column:
    return limbs(F.lit(value >> 32), F.lit(value % LIMB))


def fnv1a(data: Column, start: Column | None = None) -> Column:
    """Binary column -> struct(hi, lo); start: the hash to go on from."""
    n = F.octet_length(data)
    codes = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        x = h["lo"].bitwiseXOR(byte)
        product = x * PRIME_LOW
        hi = h["hi"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 8)
        return limbs(hi % LIMB, product % LIMB)

    return F.aggregate(codes, constant(BASIS_HI << 32 | BASIS_LO) if start is None else start, step)


def xor(a: Column, b: Column) -> Column:
    return limbs(a["hi"].bitwiseXOR(b["hi"]), a["lo"].bitwiseXOR(b["lo"]))


def rotate_left(h: Column, n: Column) -> Column:
    """n from 0 to 63."""
    swap, r = n >= 32, (n % 32).cast("int")
    hi, lo = F.when(swap, h["lo"]).otherwise(h["hi"]), F.when(swap, h["hi"]).otherwise(h["lo"])
    up = lambda x, y: (F.call_function("shiftleft", x, r) % LIMB).bitwiseOR(F.call_function("shiftright", y, F.lit(32) - r))
    return limbs(up(hi, lo), up(lo, hi))


def _times(h: Column, factor: int) -> Column:
    """The product modulo 2^64, by 16-bit words."""
    b = [factor >> 16 * i & 0xFFFF for i in range(4)]

    def sums(a: Column) -> Column:
        return F.array(*[sum((a[i] * b[k - i] for i in range(1, k + 1)), a[0] * b[k]) for k in range(4)])

    def carried(s: Column) -> Column:
        w1 = s[1] + F.shiftright(s[0], 16)
        w2 = s[2] + F.shiftright(w1, 16)
        w3 = s[3] + F.shiftright(w2, 16)
        return limbs(w3 % WORD * WORD + w2 % WORD, w1 % WORD * WORD + s[0] % WORD)

    return _bind(_bind(F.array(h["lo"] % WORD, F.shiftright(h["lo"], 16), h["hi"] % WORD, F.shiftright(h["hi"], 16)), sums), carried)


def _bind(value: Column, then) -> Column:
    """``then`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def mix64(x: Column) -> Column:
    """splitmix64 of struct(hi, lo)."""

    def folded(h: Column, n: int) -> Column:
        return xor(h, limbs(F.shiftright(h["hi"], n), F.shiftleft(h["hi"] % (1 << n), 32 - n) + F.shiftright(h["lo"], n)))

    def added(h: Column) -> Column:
        lo = h["lo"] + GOLDEN % LIMB
        return limbs((h["hi"] + (GOLDEN >> 32) + F.shiftright(lo, 32)) % LIMB, lo % LIMB)

    times = lambda h, k: _bind(folded(h, SHIFTS[k]), lambda z: _times(z, FACTORS[k]))
    return _bind(added(x), lambda a: _bind(times(a, 0), lambda b: _bind(times(b, 1), lambda c: folded(c, SHIFTS[2]))))


def unsigned_mod(hash_: Column, n: Column | int) -> Column:
    """The unsigned 64-bit value modulo n, for n below 2^31."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    return ((hash_["hi"] % n) * (F.lit(LIMB) % n) + hash_["lo"] % n) % n


def hex64(hash_: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hash_["hi"]), 8, "0"), F.lpad(F.hex(hash_["lo"]), 8, "0")))


def big_endian_32(value: Column) -> Column:
    """INT -> 4 bytes."""
    return F.unhex(F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(LIMB))), 8, "0"))


def big_endian_64(value: Column) -> Column:
    """BIGINT -> 8 bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def fnv1a_int(data: bytes, h: int = BASIS_HI << 32 | BASIS_LO) -> int:
    """The same in Python, for tests and drivers."""
    for b in data:
        h = (h ^ b) * ((1 << 40) + PRIME_LOW) % (1 << 64)
    return h
