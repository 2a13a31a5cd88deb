"""Recode decisions from a measured cutoff, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sample rates of the two families, and the reasons of an unsure measurement.
LADDERS = {44100: (44100, 88200, 176400), 48000: (48000, 96000, 192000)}
UNSURE = ("fallback_due_to_disagreement", "fallback_due_to_family_inconsistency", "fallback_due_to_boundary_ambiguity")


def family(rate: Column) -> Column:
    return F.when(rate % 48000 == 0, 48000).when(rate % 44100 == 0, 44100)


def effective(cutoff: Column, headroom: int = 500) -> Column:
    return F.when(cutoff.isNotNull(), F.greatest(cutoff + headroom, F.lit(0)).cast("double"))


def standard_family(eff: Column, rate: Column) -> Column:
    near_48 = (family(rate) == 48000) & eff.between(21120, 24000)
    return F.when(eff.isNull(), F.lit(None)).when(near_48, 48000).when(eff <= 22050, 44100).when(eff <= 24000, 48000).otherwise(family(rate))


def rung(eff: Column, fam: Column) -> Column:
    """The smallest rate of the family that holds the cutoff."""
    steps = [F.when((fam == f) & (eff <= r / 2), r) for f, ladder in LADDERS.items() for r in ladder]
    return F.coalesce(*steps)


def decided(rows: DataFrame, cutoff: Column, rate: Column, confidence: Column, reason: Column, allow: Column, headroom: int = 500) -> DataFrame:
    """rows with standard_family, fake_upscale, target_sr, decision and guarded.

    A rate above what the cutoff needs is a fake upscale, unless the measurement is unsure, or the next rung of the same
    family would hold much more than the cutoff. Last, no target exceeds the family's highest rate.

    Every step is a projection of its own: what later ones use several times is worked out once.
    """
    c = F.col
    r = rows.withColumns({"_eff": effective(cutoff, headroom), "_rate": rate, "_own": family(rate), "_low": (F.coalesce(confidence, F.lit("")) == "low") & F.coalesce(reason, F.lit("")).isin(*UNSURE), "_allow": F.coalesce(allow, F.lit(True))})
    r = r.withColumn("_std", standard_family(c("_eff"), c("_rate")))
    r = r.withColumns({"_step": rung(c("_eff"), c("_std")), "_top": F.when(c("_own") == 48000, 192000).when(c("_own") == 44100, 176400)})
    r = r.withColumn("_fake", F.coalesce(c("_rate") > c("_step"), F.lit(False)))
    middle = (c("_own") == c("_std")) & (c("_step") < c("_rate")) & (c("_rate") <= c("_top")) & (c("_eff") / (c("_step") / 2) < 0.72)
    r = r.withColumn("_kept", c("_fake") & (c("_low") | F.coalesce(middle, F.lit(False))))
    r = r.withColumn("_lower", c("_fake") & ~c("_kept") & c("_allow"))
    r = r.withColumn("_target", F.when(c("_lower"), c("_step")).otherwise(c("_rate")))
    r = r.withColumn("_capped", F.coalesce(c("_target") > c("_top"), F.lit(False)))
    return r.select(
        *(c(f"`{name}`") for name in rows.columns),
        F.when(c("_kept"), c("_own")).otherwise(c("_std")).cast("int").alias("standard_family"),
        c("_lower").alias("fake_upscale"),
        F.when(c("_capped"), c("_top")).otherwise(c("_target")).cast("int").alias("target_sr"),
        F.when(c("_lower"), "downgrade_fake_upscale").when(c("_capped"), "cap_highres_ceiling").otherwise("keep_source").alias("decision"),
        (c("_fake") & ~c("_lower")).alias("guarded"),
    )


def recode_advice(source: Column, target: Column, forced: Column, prior: Column) -> Column:
    """A struct of text and flag: whether to recode a canonical source profile to a canonical target profile."""
    rate = lambda p: F.split_part(p, F.lit("/"), F.lit(1)).try_cast("int")
    bits = lambda p: F.split_part(p, F.lit("/"), F.lit(2))
    floating = lambda p: bits(p).isin("32f", "64f")
    number = lambda p: F.when(floating(p), 24).otherwise(bits(p).try_cast("int"))
    chained = F.coalesce((rate(prior) > rate(source)) & (rate(target) < rate(source)), F.lit(False))
    lower = (rate(target) < rate(source)) | ((rate(target) == rate(source)) & ~floating(source) & (number(target) < number(source)))
    yes = F.when(rate(target).isNull() | number(target).isNull(), False).when(forced, True).when(rate(source).isNull() | number(source).isNull(), False).when(chained, False).otherwise(lower)
    return F.struct(F.when(yes, F.concat(F.lit("Recode to "), target)).otherwise("Keep as-is").alias("text"), yes.cast("int").alias("flag"))


def confidence(n: Column, low: Column, high: Column, median: Column, requested: int, segment: bool) -> Column:
    """How far the cutoffs of n windows agree: by their spread over the median."""
    least = min(2 if segment else 3, max(1, requested))
    spread = (high - low) / F.greatest(median, F.lit(1.0))
    wanted = ((4, 0.12, "high"), (3, 0.25, "medium")) if segment else ((8, 0.12, "high"), (5, 0.25, "medium"))
    out = F.when((n < least) | (F.coalesce(median, F.lit(0.0)) <= 0) | (F.lit(not segment) & (n < 3)), "low")
    return reduce(lambda o, w: o.when((n >= w[0]) & (spread <= w[1]), w[2]), wanted, out).otherwise("low")
