"""Seeded draws that do not depend on how rows are partitioned: each row's own generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) for the values of the keys: 53 bits of their hash under the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / float(1 << 53)


def normal(seed: int, *keys: str | Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """A normal draw for the values of the keys: Box and Muller's transform of two uniform ones."""
    u, v = uniform(seed, F.lit("radius"), *keys), uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(v * 6.283185307179586) * std + mean


def integers(seed: int, low: int, high: int, *keys: str | Column) -> Column:
    """A whole number from low to before high for the values of the keys."""
    return (F.floor(uniform(seed, *keys) * (high - low)) + low).cast("long")


def dropout(df: DataFrame, columns: list[str], p: float, seed: int, key: str, training: bool = True) -> DataFrame:
    """Inverted dropout: each cell is 0 with probability p, else divided by 1 - p; without training nothing changes."""
    if not training:
        return df
    return df.withColumns({c: F.when(uniform(seed, F.col(key), F.lit(k)) < p, 0.0).otherwise(F.col(c) / (1 - p)) for k, c in enumerate(columns)})
