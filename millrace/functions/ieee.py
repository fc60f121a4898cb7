"""Elementwise functions on DOUBLE columns with IEEE rules, where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _both(a, b):
    a, b = _c(a), _c(b)
    return a, b, ~F.isnan(a) & ~F.isnan(b)


def gt(a, b) -> Column:
    """a > b; any comparison with NaN is false."""
    a, b, ok = _both(a, b)
    return ok & (a > b)


def ge(a, b) -> Column:
    a, b, ok = _both(a, b)
    return ok & (a >= b)


def lt(a, b) -> Column:
    a, b, ok = _both(a, b)
    return ok & (a < b)


def le(a, b) -> Column:
    a, b, ok = _both(a, b)
    return ok & (a <= b)


def eq(a, b) -> Column:
    a, b, ok = _both(a, b)
    return ok & (a == b)


def ne(a, b) -> Column:
    return ~eq(a, b)


def between(x, low, high) -> Column:
    """low <= x <= high in the total order in which NaN is above all."""
    x = _c(x)
    return (x >= _c(low)) & (x <= _c(high))


def divide(a, b) -> Column:
    """IEEE division: x / 0 is an infinity, 0 / 0 NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    zero = F.when(a > 0, INF).when(a < 0, -INF).otherwise(NAN)
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(b == 0, zero).otherwise(F.try_divide(a, b))


def ln(x) -> Column:
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.ln(x))


def log10(x) -> Column:
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.log10(x))


def log2(x) -> Column:
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.log2(x))


def sqrt(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x < 0, NAN).otherwise(F.sqrt(x))


def sign(x) -> Column:
    """-1, 0 or 1; NaN gives 0."""
    return F.when(gt(x, 0.0), 1.0).when(lt(x, 0.0), -1.0).otherwise(0.0)


def round_half_up(x, decimals: int = 0) -> Column:
    """Half goes toward plus infinity; NaN gives 0."""
    x, scale = _c(x).cast("double"), float(10**decimals)
    return F.when(F.isnan(x), 0.0).when(F.abs(x) == INF, x).otherwise(F.floor(x * scale + 0.5).cast("double") / scale)


def round_away(x, decimals: int = 0) -> Column:
    """Half goes away from zero, as in DuckDB and C: the double x * 10^decimals is rounded and divided again; x where that overflows.

    Spark's round() goes by a double's shortest decimal digits, gives other doubles beyond 2^53 / 10^decimals, and has no -0.0.
    """
    x, scale = _c(x).cast("double"), float(10**decimals)
    y = F.abs(x * scale)
    whole = F.signum(x) * F.floor(y + 0.49999999999999994)  # the double before 0.5: what is just below a half stays below
    return F.when(y < 2.0**52, whole / scale).when(y < INF, x * scale / scale).otherwise(x)


def trunc(x) -> Column:
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double"))


def clip(x, low: float, high: float) -> Column:
    x = _c(x)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def is_inf(x) -> Column:
    return F.abs(_c(x)) == INF


def is_finite(x) -> Column:
    x = _c(x)
    return ~F.isnan(x) & ~is_inf(x)


def fill_nan(x, value: float) -> Column:
    return F.when(F.isnan(_c(x)), value).otherwise(_c(x))


def nan_to_num(x, nan: float = 0.0, plus: float = 0.0, minus: float = 0.0) -> Column:
    x = _c(x)
    return F.when(F.isnan(x), nan).when(x == INF, plus).when(x == -INF, minus).otherwise(x)


def maximum(a, b) -> Column:
    """NaN is above all."""
    return F.greatest(_c(a), _c(b))


def minimum(a, b) -> Column:
    return F.least(_c(a), _c(b))


def sigmoid(x) -> Column:
    """Logistic function in the branch that can't overflow."""
    x = _c(x).cast("double")
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def relu(x) -> Column:
    return F.when(gt(x, 0.0), _c(x)).otherwise(0.0)


def leaky_relu(x, alpha: float = 0.01) -> Column:
    return F.when(gt(x, 0.0), _c(x)).otherwise(_c(x) * alpha)


def elu(x, alpha: float = 1.0) -> Column:
    return F.when(gt(x, 0.0), _c(x)).otherwise(alpha * (F.exp(F.least(_c(x), F.lit(0.0))) - 1))


def gelu(x) -> Column:
    """The tanh approximation."""
    x = _c(x)
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def all_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = _c(a), _c(b)
    return le(F.abs(a - b), atol + rtol * F.abs(b)) | eq(a, b)
