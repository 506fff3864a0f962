"""Decimal rounding that agrees with IEEE round-half-even of the binary value.

``round`` in Spark works on the shortest decimal and rounds half up, so it
disagrees on values that only look like ties. The product ``x * 10**d`` is
split into a rounded part and its exact error (Dekker 1971), which decides
ties without leaving column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1


def round_half_even(x: Column, digits: int = 3) -> Column:
    scale = float(10**digits)
    x = x.cast("double")
    high = x * _SPLITTER - (x * _SPLITTER - x)
    low = x - high
    product = x * scale
    error = (high * scale - product) + low * scale
    whole = F.floor(product)
    side = (product - whole - F.lit(0.5)) + error
    rounded = (
        F.when(side > 0, whole + 1)
        .when(side < 0, whole)
        .otherwise(whole + F.pmod(whole, F.lit(2)))
    )
    return rounded.cast("double") / scale
