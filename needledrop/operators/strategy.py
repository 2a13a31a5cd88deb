"""How a track is looked at, and what its looks amount to: segments, channels, votes, early stops, escalation, rows of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.operators import signal


def windows_for_mode(most: Column, mode: Column) -> Column:
    """Twice as many windows in exact mode, 24 at least."""
    return F.when(mode == "exact", F.greatest(most * 2, F.lit(24))).otherwise(most)


def segment_seconds(window: Column) -> Column:
    return F.greatest(F.lit(6.0), F.least(F.lit(12.0), window.cast("double")))


#: How many segments an exact look takes, and how many of these a fast one.
EXACT_SEGMENTS, FAST_SEGMENTS = 6, 4


def segment_starts(seconds: Column, segment: Column, mode: Column) -> Column:
    """Where the segments of a track begin: the middle of what is usable for one, else evenly from 8 to 92 % of it. A fast look
    takes the first ones of an exact look.
    """
    starts = exact_segment_starts(seconds, segment)
    return F.when(mode == "fast", F.slice(starts, 1, FAST_SEGMENTS)).otherwise(starts)


def exact_segment_starts(seconds: Column, segment: Column) -> Column:
    usable = seconds - segment
    n = F.least(F.lit(EXACT_SEGMENTS), F.greatest(F.lit(1), F.floor(seconds / F.greatest(segment, F.lit(1.0))).cast("int")))
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0.0), F.least(usable * (0.08 + 0.84 * (i / (n - 1))), usable)))
    return F.when(seconds.isNull() | (usable <= 0), F.array(F.lit(0.0))).when(n <= 1, F.array(usable * 0.5)).otherwise(many)


def frames_at(samples: Column, start: Column, rate: int, window: float) -> Column:
    """The frames of a window that begins at `start` seconds, moved back to end with the track; null if under a second is left."""
    size = max(1, round(window * rate))
    first = F.greatest(F.lit(0), F.least(F.bround(start * rate).cast("int"), F.greatest(F.lit(0), F.size(samples) - size)))
    n = F.least(F.lit(size), F.size(samples) - first)
    return F.when(n >= max(1, rate), F.slice(samples, first + 1, n))


def channel(frames: Column, mode: str) -> Column:
    """One signal of frames (arrays of a value for each channel): left, right, or the mean of the first two; a lone channel is itself."""
    left, right = (lambda f: f[0]), (lambda f: F.coalesce(F.get(f, F.lit(1)), f[0]))
    pick = {"left": left, "right": right}.get(mode, lambda f: F.when(F.size(f) > 1, (f[0] + f[1]) / 2).otherwise(f[0]))
    return F.transform(frames, pick)


def window_summary(windows: DataFrame) -> DataFrame:
    """track_id, exact medians of cutoffs, energy ratios and drops, and how many (any, most) windows hold high frequencies."""
    median = lambda c: F.median(c).alias(c)
    return windows.groupBy("track_id").agg(median("cutoff_hz"), median("energy_ratio"), median("drop_db"), F.count_if("hf_present").alias("hf_windows"), F.bool_or("hf_present").alias("hf_any"), F.max("hf_peak_db").alias("hf_peak_db"))


def _spread(cutoffs: Column) -> tuple[Column, Column, Column]:
    """Number, median and spread over median of an array of cutoffs."""
    s, n = F.array_sort(cutoffs), F.size(cutoffs)
    at = lambda k: F.element_at(s, (k + 1).cast("int"))
    middle = F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)
    return n, middle, (F.array_max(cutoffs) - F.array_min(cutoffs)) / F.greatest(middle, F.lit(1.0))


def segment_confidence(cutoffs: Column, requested: Column) -> Column:
    """high, medium or low: how far the cutoffs of a track's segments agree."""
    n, middle, spread = _spread(cutoffs)
    least = F.least(F.lit(2), F.greatest(F.lit(1), requested))
    return F.when((n == 0) | (n < least) | (middle <= 0), "low").when((n >= 4) & (spread <= 0.12), "high").when((n >= 3) & (spread <= 0.25), "medium").otherwise("low")


def outcome(segments: DataFrame) -> DataFrame:
    """track_id, confidence, reason, allow of the vote of a track's segments (see signal.vote for the columns).

    A lower rate is taken if its votes are enough, nobody speaks for another rate or for the full band, and the cutoffs
    agree; far lower ones need all segments. A track that keeps its rate does so surely, or for want of agreement.
    The reasons are fixed values.
    """
    segments = segments.repartition("track_id")
    fake = F.col("target_sr") < F.col("source_sr")
    limited = F.col("cutoff_hz").isNotNull() & fake & ~F.col("hf_present") & (F.col("distance_hz") > 1500) & (F.col("drop_db") >= 14)
    flags = segments.groupBy("track_id").agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("cutoff_hz").isNotNull() & fake & (F.col("distance_hz") <= 1500)), F.lit(False)).alias("ambiguous"), F.bool_or("hf_present").alias("hf"), F.max("source_sr").alias("source"),
        F.collect_list("cutoff_hz").alias("cutoffs"), F.collect_list(F.when(limited, F.col("target_sr"))).alias("targets"),
    )
    all_votes = signal.vote(segments).withColumnRenamed("track_id", "_t")
    r = flags.join(all_votes, F.col("track_id") == F.col("_t"))
    statistical = segment_confidence(F.col("cutoffs"), F.col("n"))
    others = F.size(F.filter("targets", lambda t: t != F.col("majority_target")))
    votes, required, share = F.coalesce("votes", F.lit(0)), F.col("required"), F.col("share_near")
    inconsistent = others > 0
    strong_minor = F.exists(F.array_distinct("targets"), lambda t: (t != F.col("majority_target")) & (F.size(F.filter("targets", lambda u: u == t)) >= 2))
    large = F.col("source") / F.col("majority_target") >= 2.5
    agreed = (votes >= required) & ~inconsistent & ~F.coalesce(strong_minor, F.lit(False)) & ~F.col("ambiguous") & ~F.col("hf") & (F.col("full_band") == 0) & (share >= 0.6)
    downgrade = agreed & (~F.coalesce(large, F.lit(False)) | ((votes == F.col("n")) & (share >= 0.75) & (statistical != "low")))
    keep = (F.col("full_band") >= required) | F.col("hf") | ((votes == 0) & (share >= 0.6)) | ((votes >= required) & (F.col("hf") | (F.col("full_band") > 0)))
    three = F.greatest(F.lit(3), required)
    row = lambda confidence, reason, allow=False: F.struct(confidence.alias("confidence"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), F.lit(allow).alias("allow"))
    low = F.lit("low")
    made = (
        F.when(F.size("cutoffs") == 0, row(low, "fallback_due_to_no_signal"))
        .when(downgrade, row(F.when((votes >= three) & (share >= 0.75) & (statistical != "low"), "high").otherwise("medium"), F.when(share >= 0.75, "accepted_by_consistency").otherwise("accepted_by_majority_vote"), True))
        .when(inconsistent, row(low, "fallback_due_to_family_inconsistency"))
        .when(F.col("ambiguous") & ~F.col("hf") & (F.col("full_band") == 0), row(low, "fallback_due_to_boundary_ambiguity"))
        .when(keep, row(F.when((F.col("full_band") >= three) & (share >= 0.6), "high").otherwise("medium"), F.when((share >= 0.6) | F.col("hf"), "accepted_by_consistency").otherwise("accepted_by_majority_vote")))
        .otherwise(row(low, "fallback_due_to_disagreement"))
    )
    return r.select("track_id", made.alias("m")).select("track_id", "m.*")


def earliest_sure(segments: DataFrame, least: int = 3) -> DataFrame:
    """track_id, used: after how many segments (by number) the cutoffs so far agree highly; tracks that never do use all."""
    so_far = Window.partitionBy("track_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)  # a dozen at most
    rows = segments.withColumn("cutoffs", F.collect_list("cutoff_hz").over(so_far)).withColumn("n", F.count("*").over(so_far))
    sure = (F.col("n") >= least) & (segment_confidence(F.col("cutoffs"), F.col("n")) == "high")
    return rows.groupBy("track_id").agg(F.coalesce(F.min(F.when(sure, F.col("n"))), F.max("n")).alias("used"))


def escalated(results: DataFrame) -> DataFrame:
    """track_id, mode, cutoff_hz, allow of tracks looked at fast, exactly and in full (columns of each: confidence, cutoff, allow).

    The first result that isn't of low confidence counts. A segmented track that is still unsure is judged in full, and a
    lower rate is allowed only if both looks allow it; others end with the exact look.
    """
    fast, exact = F.col("fast_confidence") != "low", F.col("exact_confidence") != "low"
    full = F.col("segmented") & F.col("full_cutoff").isNotNull()
    pick = lambda k: F.when(fast, F.col(f"fast_{k}")).when(exact | ~full, F.col(f"exact_{k}"))
    return results.select(
        "track_id",
        F.when(fast, "fast").when(exact | ~full, "exact").otherwise("full").alias("mode"),
        pick("cutoff").otherwise(F.col("full_cutoff")).alias("cutoff_hz"),
        pick("allow").otherwise(F.col("full_allow") & F.col("exact_allow")).alias("allow"),
    )


def row_energy(values: Column, by: str = "contrast") -> Column:
    """A number for a row of an image: the (population) standard deviation of its values, or by intensity their 75th percentile."""
    n = F.size(values)
    if by == "contrast":
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    s, at = F.array_sort(values), 0.75 * (n - 1)
    low = F.floor(at).cast("int")
    part = at - low
    return F.element_at(s, low + 1) * (1 - part) + F.element_at(s, F.least(low + 2, n)) * part  # as SQL's quantile_cont, to the last bit
