"""Doubles rounded and written as in C, and so in DuckDB; Spark's own ``round`` and ``format_string`` go by the shortest decimal that reads as the double, half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """A double to ``digits``: its product with the power of ten to the next whole number, half away from zero, and back."""
    scale = 10.0**digits
    return F.round(x * scale) / scale


def fixed(x: Column, digits: int) -> Column:
    """A double's text with 1 to 6 ``digits`` after the point: its exact value rounded, a tie to the even digit."""
    scale, size = 10**digits, F.abs(x)
    high = size.cast("float").cast("double")  # its product and that of the rest are exact
    whole = F.floor(size * scale)
    over = high * scale - (whole + 0.5) + (size - high) * scale
    units = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(sign, F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))
    return F.when(size >= 1e9, F.format_string(f"%.{digits}f", x)).otherwise(text)
