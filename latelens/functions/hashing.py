"""Seeded 64-bit hashes and ids as JVM expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published primes of XXH64.
PRIME_1, PRIME_2, PRIME_3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
PRIME_4, PRIME_5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
MASK = (1 << 64) - 1
#: Spark's xxhash64 starts from this seed; the hash of one argument seeds the next.
SPARK_SEED = 42


def _rotated(x: int, n: int) -> int:
    return ((x >> n) | (x << (64 - n))) & MASK


def _unshifted(x: int, n: int) -> int:
    """Undoes y ^= y >> n."""
    y, k = x, n
    while k < 64:
        y = x ^ (y >> n)
        k += n
    return y


@lru_cache
def seeding_long(seed: int) -> int:
    """The long whose Spark xxhash64 is seed; XXH64 of eight bytes can be run backwards."""
    inverse = lambda p: pow(p, -1, 1 << 64)
    h = _unshifted(seed & MASK, 32)
    h = _unshifted(h * inverse(PRIME_3) & MASK, 29)
    h = _unshifted(h * inverse(PRIME_2) & MASK, 33)
    h = _rotated((h - PRIME_4) * inverse(PRIME_1) & MASK, 27) ^ ((SPARK_SEED + PRIME_5 + 8) & MASK)
    x = _rotated(h * inverse(PRIME_1) & MASK, 31) * inverse(PRIME_2) & MASK
    return x - (1 << 64) if x >> 63 else x


def xxh64(c: Column, seed: int) -> Column:
    """XXH64 of a string column under any seed, as a signed long."""
    return F.xxhash64(F.lit(seeding_long(seed)), c)


def unsigned_mod(h: Column, n: int) -> Column:
    """The remainder of the unsigned value of a signed long."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, F.lit((1 << 64) % n)).otherwise(F.lit(0)), F.lit(n))


def categorical_bucket(field: str, value: Column, seed: int, buckets: int) -> Column:
    return unsigned_mod(xxh64(F.concat(F.lit(f"{field}:"), value), seed), buckets)


def md5_number(c: Column) -> Column:
    """The leading 32 bits of an md5 as a number, which other engines compute alike."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def is_member(click_id: Column, seed: int, parts: int = 10) -> Column:
    """Whether a click belongs to the monitoring sample of one in parts."""
    return unsigned_mod(xxh64(click_id, seed), parts) == 0


def click_identity(file_digest: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", file_digest, index.cast("string")), 256)


def priority(seed: int, record_id: Column) -> Column:
    """Hex digits that order records as a random permutation does."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), record_id.cast("string")), 256)


def record_key(ref: Column, kind: Column) -> Column:
    return F.shiftleft(ref.cast("long"), 8).bitwiseOR(kind.cast("long"))


def mix64(c: Column) -> Column:
    """A splitmix-style scramble of longs: Spark's own bijective-by-seed hash of one long."""
    return F.xxhash64(c.cast("long"))


def is_hex_id(c: Column, size: int = 32) -> Column:
    """Whether a string is size bytes in lowercase hex."""
    return F.coalesce(c.rlike(f"^[0-9a-f]{{{2 * size}}}$"), F.lit(False))


def id_bytes(c: Column, size: int = 32) -> Column:
    """The bytes of a hex id, null where it isn't one."""
    return F.when(is_hex_id(c, size), F.unhex(c))


def id_hex(c: Column) -> Column:
    return F.lower(F.hex(c))
