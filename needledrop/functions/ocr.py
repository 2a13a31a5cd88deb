"""Numbers and claims in text that was read off an image."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of a peak, and of a dynamic range, in the order in which they are tried.
PEAK = ("Peak Amplitude", "Peak")
RANGE = ("Dynamic Range", "DR")


def labelled_number(text: Column, labels: Sequence[str]) -> Column:
    """The number after the first of the labels that has one: in any case, with or without a colon, an equals sign or dB."""
    number = lambda label: F.regexp_extract(text, rf"(?i){re.escape(label)}\s*[:=]?\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(*(number(label) for label in labels))


def dynamic_range(text: Column) -> Column:
    """The dynamic range that a text states. Where all signs and points are lost (DynamicRange: 53940351938), its first two or
    three digits and the two after them, whichever gives 1 to 60.
    """
    digits = F.regexp_extract(text, r"(?i)dynamic\s*range[^\d]*([0-9]{5,})", 1)
    cut = lambda n: F.concat(F.substring(digits, 1, n), F.lit("."), F.substring(digits, n + 1, 2)).try_cast("double")
    recovered = F.coalesce(*(F.when((F.length(digits) >= n + 2) & cut(n).between(1.0, 60.0), cut(n)) for n in (2, 3)))
    return F.coalesce(labelled_number(text, RANGE), recovered)


def has_mastering_stats(text: Column) -> Column:
    """Whether a text names a peak or a dynamic range."""
    return F.coalesce(text.rlike(r"(?i)peak|dynamic\s*range|\bdr\b"), F.lit(False))
