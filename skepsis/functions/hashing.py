"""Order-free randomness: a draw is a pure function of its key, so it does not depend on
partitioning, task order or retries, and any engine with md5 can reproduce it."""
from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, functions as F

TWO32 = 4294967296.0


def _lit(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def _digest(parts) -> Column:
    return F.md5(F.concat_ws(":", *[_lit(p) for p in parts]))


def hash32(*parts) -> Column:
    """First 32 bits of md5 of the colon-joined parts, as a bigint."""
    return F.conv(F.substring(_digest(parts), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) keyed by the parts."""
    return hash32(*parts) / F.lit(TWO32)


def hash_normal(*parts) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = F.greatest(hash_uniform(*parts, "a"), F.lit(1.0 / TWO32))
    u2 = hash_uniform(*parts, "b")
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def hash_sign(*parts) -> Column:
    """-1 where `hash_uniform` is below 1/2, which the first hex digit of the digest tells."""
    return F.when(_digest(parts) < "8", -1.0).otherwise(1.0)


def stable_seed(name, offset=0, base: int = 0) -> Column:
    """base + 1000*offset + crc32(name) mod 2^31: reproducible across processes."""
    name = F.col(name) if isinstance(name, str) else name
    off = offset if isinstance(offset, Column) else F.lit(offset)
    return (F.lit(base) + 1000 * off.cast("bigint") + F.crc32(F.encode(name, "UTF-8"))) % F.lit(2147483648)


def stable_seed_scalar(name: str, offset: int = 0, base: int = 0) -> int:
    """Driver-side twin of `stable_seed`, for plan parameters."""
    return (base + 1000 * offset + zlib.crc32(name.encode())) % 2147483648
