"""Column expressions shared by the operators.  Everything here stays in Catalyst."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def ratio(num, den, default=None) -> Column:
    """num / den, `default` where den is 0 or NULL (ANSI mode raises on a zero divisor)."""
    out = col(num) / F.nullif(dbl(den), F.lit(0.0))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def trunc(c) -> Column:
    """Truncation toward zero, as a bigint."""
    c = col(c)
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))


def half_even(c) -> Column:
    """Round to the nearest integer, ties to even, as a double."""
    return F.rint(col(c))


def entropy_nats(n: Column) -> Column:
    """Aggregate: Shannon entropy in nats of the category counts in column `n`.

    ln(N) - sum(n ln n)/N needs one pass and no join against the total.
    """
    n = n.cast("double")
    return F.greatest(F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n), F.lit(0.0))


def entropy_bits(n: Column) -> Column:
    import math
    return entropy_nats(n) / math.log(2.0)


def bin_index(v, lo, hi, bins: int) -> Column:
    """Equal-width bin of v in [lo, hi]; the top edge falls in the last bin, a flat range in bin 0."""
    v, lo, hi = col(v), col(lo), col(hi)
    b = trunc((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * float(bins))
    return F.coalesce(clamp(b, 0, bins - 1), F.lit(0)).cast("bigint")


def let(value, body) -> Column:
    """Evaluate `value` once and hand it to `body` (an expression named twice, or used inside a
    lambda, would otherwise be evaluated at every use)."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))
