"""Rounding as Python does it: the exact binary value to the nearest, ties to even.

``round`` works on the shortest decimal text instead, which differs for ratios such as 9 / 60000.
Formatting costs a text per value, so this is for aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(value: Column, digits: int) -> Column:
    text = F.call_function("format_number", value, F.lit("0." + "0" * digits))
    rounded = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), text.try_cast("double"))
    # Below one unit of the last place the formatter always takes half a unit as an exact tie;
    # whether its binary value lies above the tie is the same for every row.
    unit = float(f"1e-{digits}")
    half_goes_up = round(unit / 2, digits) > 0
    size = F.abs(value)
    up = size >= unit / 2 if half_goes_up else size > unit / 2
    return F.when(size < unit, F.when(up, F.signum(value) * unit).otherwise(0.0)).otherwise(rounded)
