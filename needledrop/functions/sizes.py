"""Sizes, levels and cells as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transfer_size(bytes_: Column) -> Column:
    """b, Kb, Mb, Gb or Tb with at most one decimal (half up, in whole numbers); none from 100 on and where it would be 0. Other text than digits is 0."""
    n = F.coalesce(F.when(bytes_.cast("string").rlike("^[0-9]+$"), bytes_.try_cast("long")), F.lit(0).cast("long"))
    out = F.concat(n.cast("string"), F.lit("b"))
    for power, name in enumerate(("Kb", "Mb", "Gb", "Tb"), 1):
        unit = 1024**power
        tenths = F.floor(((n % unit) * 10 + unit // 2) / unit)
        whole, part = F.floor(n / unit) + F.when(tenths >= 10, 1).otherwise(0), F.when(tenths >= 10, 0).otherwise(tenths)
        text = F.when((whole >= 100) | (part == 0), whole.cast("string")).otherwise(F.concat(whole.cast("string"), F.lit("."), part.cast("string")))
        out = F.when(n >= unit, F.concat(text, F.lit(name))).otherwise(out)
    return out


def short_size(bytes_: Column) -> Column:
    """B, K, M, G or T with three digits: two decimals below 10, one below 100; less than nothing is 0B."""
    n = F.greatest(F.coalesce(bytes_, F.lit(0)), F.lit(0)).cast("double")
    out = F.concat(F.floor(n).cast("string"), F.lit("B"))
    for power, name in enumerate("KMGT", 1):
        x = n / 1024**power
        digits = lambda d, x=x: F.format_string(f"%.{d}f", F.bround(x, d))
        out = F.when(n >= 1024**power, F.concat(F.when(x >= 100, digits(0)).when(x >= 10, digits(1)).otherwise(digits(2)), F.lit(name))).otherwise(out)
    return out


def one_line(x: Column) -> Column:
    """A cell without tabs and line ends: each becomes a space."""
    return F.translate(F.coalesce(x, F.lit("")), "\t\r\n", "   ")


def linear_gain(db: Column) -> Column:
    """A level in dB as a factor, with six decimals."""
    return F.round(F.pow(F.lit(10.0), db / 20), 6)


def fixed_gain(gain: Column) -> Column:
    """A gain in dB as whole 1/256 dB, half away from zero."""
    return F.when(gain >= 0, F.floor(gain * 256 + 0.5)).otherwise(F.ceil(gain * 256 - 0.5)).cast("long")


def short_tag(x: Column, most: int = 20) -> Column:
    """A tag with single spaces, cut to `most` characters with three dots; a dash for none."""
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    return F.when(t == "", "-").when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 3))), F.lit("...")))


def short_number(x: Column) -> Column:
    """A number with at most two decimals, none that are 0; a dash for none."""
    two = F.regexp_replace(F.format_string("%.2f", F.bround(x, 2)), r"\.?0+$", "")
    return F.when(x.isNull(), "-").when(x == F.floor(x), F.floor(x).cast("string")).otherwise(two)
