"""Spectra of short windows: cutoff, guard band and drop, from arrays of samples, without leaving the JVM.

The transform is a sum of products over each window with cosines worked out once, so a window is one row and the work is
spread like any other projection. For windows of thousands of samples use fft_cutoffs(), which gives whole Arrow batches
to numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centred(samples: Column, n: int) -> Column:
    """Samples less their mean, under a Hann window."""
    window = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i in range(n)])
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n
    return F.zip_with(samples, window, lambda x, w: (x - mean) * w)


def magnitudes(samples: Column, n: int) -> Column:
    """|DFT| for bins 0 to n/2."""
    half = n // 2 + 1
    # One period of cosines serves every bin; its index is bin * i modulo n.
    cosines = F.array(*[F.lit(math.cos(2 * math.pi * i / n)) for i in range(n)])
    sines = F.array(*[F.lit(math.sin(2 * math.pi * i / n)) for i in range(n)])

    def part(k: Column, table: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, i: a + F.element_at(samples, i + 1) * F.element_at(table, (k * i) % n + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.sqrt(F.pow(part(k, cosines), F.lit(2.0)) + F.pow(part(k, sines), F.lit(2.0))))


def guard_hz(source_sr: Column) -> Column:
    """Above which frequency a source of that rate has more than a CD or a studio recording holds; null for rates of neither family."""
    return F.when(source_sr % 48000 == 0, 24_000.0).when(source_sr % 44100 == 0, 22_050.0)


def spectra(windows: DataFrame, n: int = 64, threshold: float = -55.0, rate: int = 96_000, guard: Column | float = 24_000.0) -> DataFrame:
    """id, cutoff_bin, cutoff_hz, guard_ratio, hf_present and drop_db of each window (id, samples array<double> of length n).

    guard: from which frequency on a window counts as holding high ones (see guard_hz); without one, or from half the rate
    on, there is no ratio and nothing is held.
    """
    # Intermediate arrays are columns of their own: a projection each, not one expression repeated within another.
    start = guard if isinstance(guard, Column) else F.lit(guard)
    rows = windows.select("id", start.cast("double").alias("start"), centred(F.col("samples"), n).alias("w"))
    rows = rows.select("id", F.when(F.col("start") < rate / 2, F.col("start")).alias("start"), magnitudes(F.col("w"), n).alias("mag"))
    rows = rows.withColumn("peak", F.greatest(F.array_max("mag"), F.lit(1e-12)))
    rows = rows.withColumn("db", F.transform("mag", lambda m: 20 * F.log10(F.greatest(m / F.col("peak"), F.lit(1e-12)))))
    bins = F.sequence(F.lit(0), F.lit(n // 2))
    rows = rows.withColumn("cutoff_bin", F.coalesce(F.array_max(F.filter(bins, lambda k: F.element_at("db", k + 1) >= threshold)), F.lit(0)))
    step = rate / n
    energy = lambda x: F.aggregate(x, F.lit(0.0), lambda a, m: a + m * m)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, m: a + m) / F.size(x)
    first = F.ceil(F.col("start") / step).cast("int")
    part = lambda c: F.slice(c, first + 1, F.lit(n // 2 + 1) - first)
    rows = rows.withColumns({"guard": part("mag"), "guard_db": part("db"), "cutoff_hz": F.col("cutoff_bin") * step})
    rows = rows.withColumn("guard_ratio", F.when(F.col("guard").isNull(), F.lit(None)).when(energy(F.col("mag")) > 0, energy(F.col("guard")) / energy(F.col("mag"))).otherwise(0.0))
    share = F.size(F.filter("guard_db", lambda x: x >= -78.0)) / F.size("guard_db")
    present = (F.array_max("guard_db") >= -78.0) | (share >= 0.002) | (F.col("guard_ratio") >= 1e-4)
    near = lambda low, high: F.transform(F.filter(bins, lambda k: (k * step >= low) & (k * step < high)), lambda k: F.element_at("db", k + 1))
    f = F.col("cutoff_hz")
    rows = rows.withColumns({"below": near(F.greatest(f - 2000, F.lit(0.0)), F.greatest(f - 500, F.lit(0.0))), "above": near(F.least(f + 500, F.lit(rate / 2)), F.least(f + 2500, F.lit(rate / 2)))})
    drop = F.when((f > 3000) & (F.size("below") > 0) & (F.size("above") > 0), mean(F.col("below")) - mean(F.col("above")))
    return rows.select("id", "cutoff_bin", "cutoff_hz", "guard_ratio", F.coalesce(present, F.lit(False)).alias("hf_present"), drop.alias("drop_db"))


def fft_cutoffs(windows: DataFrame, threshold: float = -55.0) -> DataFrame:
    """id, cutoff_bin by numpy's FFT over Arrow batches: for long windows of any length."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in batches:
            bins, lengths = np.zeros(len(frame), dtype=np.int32), frame["samples"].map(len).to_numpy()
            for n in np.unique(lengths[lengths > 1]):  # windows of one length at a time
                at = np.flatnonzero(lengths == n)
                x = np.stack(frame["samples"].iloc[at].to_list()).astype(float)
                mag = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(n), axis=1))
                db = 20 * np.log10(np.maximum(mag / np.maximum(mag.max(axis=1, keepdims=True), 1e-12), 1e-12))
                loud = db >= threshold
                bins[at] = np.where(loud.any(axis=1), loud.shape[1] - 1 - loud[:, ::-1].argmax(axis=1), 0)
            yield pd.DataFrame({"id": frame["id"], "cutoff_bin": bins})

    return windows.select("id", "samples").mapInPandas(run, "id long, cutoff_bin int")


def window_starts(seconds: Column, window: float = 8.0, most: int = 12) -> Column:
    """Where the windows of a track begin: the middle for one, else evenly from 10 to 90 % of what is usable."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(seconds / window).cast("int")))
    usable = F.greatest(seconds - window, F.lit(0.0))
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.greatest((seconds - window) * (0.1 + 0.8 * (i / (n - 1))), F.lit(0.0)), usable))
    return F.when(n == 1, F.array(usable * 0.5)).otherwise(many)


def classified(segments: DataFrame) -> DataFrame:
    """segments with kind (full-band, cutoff-limited, uncertain) and reason.

    segments: track_id, segment, cutoff_hz, source_sr, target_sr, hf_present, drop_db, distance_hz. A segment without a cutoff
    tells nothing; one that would keep its rate, or holds high frequencies, is full-band; else it speaks for a lower rate if
    its cutoff looks like a wall and isn't close to what the lower rate holds.
    """
    told = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    t = (
        F.when(F.col("cutoff_hz").isNull() | F.col("source_sr").isNull(), told("uncertain", "no_cutoff"))
        .when(~(F.col("target_sr") < F.col("source_sr")), told("full-band", "full_band_signal"))
        .when(F.col("hf_present"), told("full-band", "hf_presence_guard"))
        .when(F.col("distance_hz") <= 1500, told("uncertain", "boundary_ambiguity"))
        .when(F.col("drop_db") >= 14, told("cutoff-limited", "brickwall_cutoff"))
        .otherwise(told("uncertain", "gradual_rolloff"))
    )
    return segments.withColumn("_t", t).select(*segments.columns, "_t.*")


def vote(segments: DataFrame) -> DataFrame:
    """track_id, majority_target, votes, full_band, cutoff_limited, required, share_near: the votes of a track's segments.

    segments: see classified. Ties of targets go to the one seen first.
    """
    fake = F.col("target_sr") < F.col("source_sr")
    # A track has a dozen segments at most: dealt by track once, all sums of it are in one place, and what segments are made of is worked out before.
    rows = classified(segments).select("track_id", "segment", "cutoff_hz", "source_sr", "target_sr", "kind").repartition("track_id")
    votes = rows.where((F.col("kind") == "cutoff-limited") & fake).groupBy("track_id", "target_sr").agg(F.count("*").alias("votes"), F.min("segment").alias("first"))
    best = votes.groupBy("track_id").agg(F.max(F.struct("votes", (-F.col("first")).alias("o"), "target_sr")).alias("b"))
    sums = rows.groupBy("track_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "full-band").alias("full_band"), F.count_if(F.col("kind") == "cutoff-limited").alias("cutoff_limited"), F.median("cutoff_hz").alias("middle"), F.collect_list("cutoff_hz").alias("cutoffs")
    )  # a track has a dozen segments at most
    near = F.when(F.size("cutoffs") > 0, F.size(F.filter("cutoffs", lambda c: F.abs(c - F.col("middle")) <= 2500)) / F.size("cutoffs")).otherwise(0.0)
    required = F.greatest(F.lit(2), F.ceil(F.greatest("n", F.col("cutoff_limited") + F.col("full_band")) * 0.6).cast("int"))
    sums = sums.select("track_id", "full_band", "cutoff_limited", required.alias("required"), near.alias("share_near"))
    return sums.join(best.select(F.col("track_id").alias("t"), F.col("b.target_sr").alias("majority_target"), F.col("b.votes").alias("votes")), F.col("track_id") == F.col("t"), "left").drop("t")


def strongest_channel(results: DataFrame) -> DataFrame:
    """One row of results for each track_id: that of the channel whose measurement is surest.

    results: track_id, channel (mono, left, right), decision_confidence, confidence, windows_used, cutoff_hz. Surest is the
    higher decision confidence (confidence where it is null), then confidence, windows, cutoff; ties go to mono, then
    left. Rows without a cutoff don't compete; a track with no other row has its mono row. The maximum is taken map-side.
    """
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    there = F.col("cutoff_hz").isNotNull()
    of_there = lambda c: F.when(there, c)
    place = F.when(F.col("channel") == "mono", 0).when(F.col("channel") == "left", 1).otherwise(2)
    key = F.struct(there, of_there(rank(F.coalesce("decision_confidence", "confidence"))), of_there(rank(F.col("confidence"))), of_there(F.coalesce("windows_used", F.lit(0))), of_there(F.col("cutoff_hz")), -place)
    names = [c for c in results.columns if c != "track_id"]
    best = results.groupBy("track_id").agg(F.max_by(F.struct(*names), key).alias("best"))
    return best.select("track_id", "best.*")
