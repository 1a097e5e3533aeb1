"""Content ids and seeded order: one definition for every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def short_uid(parts: list[Column], sep: str, n: int = 16) -> Column:
    """First ``n`` hex characters of the sha256 of the joined parts; nulls count as empty."""
    return F.substring(digest(F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])), 1, n)


def seeded(seed: int, key: Column) -> Column:
    """Order key that depends on the seed and the row's own id, never on row order.

    A null id has a key of its own that no text has.
    """
    return digest(F.concat(F.lit(f"{seed}|"), F.coalesce(key, F.lit("\x00null"))))


def bucket(seed: int, key: Column) -> Column:
    """First 64 bits of the seeded digest, modulo 10 000.

    The two 32-bit halves are reduced separately so everything stays in long arithmetic.
    """
    h = seeded(seed, key)
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return (high * F.lit((1 << 32) % BUCKETS) + low) % F.lit(BUCKETS)


def unit_interval(value: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hex digest."""
    n = F.conv(F.substring(value, 1, 13), 16, 10).cast("double")
    return (n + F.lit(0.5)) / F.lit(float(1 << 52))
