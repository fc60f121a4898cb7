"""Exact decimals: DECIMAL columns, NULL for what is not a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def set_scale(x, scale: int, mode: str = "HALF_EVEN", precision: int = 38) -> Column:
    """x with so many decimals. Modes: HALF_EVEN, HALF_UP, HALF_DOWN, UP, DOWN, CEILING, FLOOR (ties and signs as java.math has them)."""
    x, kind = _c(x), f"decimal({precision},{scale})"
    down = F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))
    away = F.when(x < 0, F.floor(x, F.lit(scale))).otherwise(F.ceil(x, F.lit(scale)))
    found = {
        "HALF_EVEN": lambda: F.bround(x, scale), "HALF_UP": lambda: F.round(x, scale), "CEILING": lambda: F.ceil(x, F.lit(scale)), "FLOOR": lambda: F.floor(x, F.lit(scale)),
        "DOWN": lambda: down, "UP": lambda: away, "HALF_DOWN": lambda: F.when(F.abs(x - down) > F.abs(away - x), away).otherwise(down),
    }
    return found[mode]().try_cast(kind)


def divide(a, b, kind: str = "decimal(38,18)") -> Column:
    """a / b; NULL where b is 0 or the result does not fit."""
    return F.try_divide(_c(a), _c(b)).try_cast(kind)


def power(x, n: int, kind: str = "decimal(38,18)") -> Column:
    """A whole power by repeated multiplication; NULL for negative n and overflow."""
    if n < 0:
        return F.lit(None).cast(kind)
    out = F.lit(1).cast(kind)
    for _ in range(n):
        out = F.try_multiply(out, _c(x)).try_cast(kind)
    return out


def sqrt(x, kind: str = "decimal(38,18)") -> Column:
    """NULL for negative numbers; 15 digits are exact."""
    return F.when(_c(x) >= 0, F.sqrt(_c(x).cast("double"))).try_cast(kind)


def signum(x) -> Column:
    return F.signum(_c(x)).cast("int")


def fits_int(x) -> Column:
    x = _c(x)
    return (x == F.floor(x)) & x.try_cast("int").isNotNull()
