"""Sizes for people, in exact integer arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of 1024 under these labels.
UNITS = ("B", "KB", "MB", "GB", "TB")


def _even(whole: Column, rest: Column, unit: int) -> Column:
    """whole + rest / unit, rounded half to even."""
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 != 0))
    return whole + up.cast("bigint")


def human_size(n: Column) -> Column:
    """`1.5 KB (1536 B)`: one decimal in the largest fitting unit, none in the next smaller one.

    Ties go to the even digit; Spark's format_string rounds halves up, so it isn't used. Remainders stay below
    2^40, so nothing overflows a long. Null stays null; sizes below 1024, negative ones too, are plain bytes.
    """
    n = n.cast("bigint")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k in range(1, len(UNITS)):
        unit, sub, bits = 1024**k, 1024 ** (k - 1), 10 * k
        rest = n % unit
        tenths = _even(F.shiftright(n, bits) * 10 + F.shiftright(rest * 10, bits), (rest * 10) % unit, unit)
        small = _even(F.shiftright(n, bits - 10), n % sub, sub) if sub > 1 else n
        digit = tenths % 10
        whole = F.floor((tenths - digit).cast("decimal(20,0)") / 10)
        text = F.format_string(f"%s.%s {UNITS[k]} (%s {UNITS[k - 1]})", whole.cast("string"), digit, small)
        out = F.when(n >= unit, text).otherwise(out)
    return out
