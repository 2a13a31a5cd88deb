"""Planning joins and aggregates over albums and tracks: summaries, comparisons, gains, splits, matrices, score cards."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions import grading, parsing, sizes, text

#: Clean profiles and lossy variants that a data set has of each source.
CLEAN = ("44100/16", "48000/24")
VARIANTS = ("mp3_128_upscaled", "mp3_192_upscaled", "mp3_320_upscaled", "aac_128_upscaled", "aac_256_upscaled", "opus_96_upscaled", "opus_160_upscaled")


def album_summary(tracks: DataFrame) -> DataFrame:
    """album_id, profile and codec (mixed if not all equal), any_lossy, n_tracks, mean kbps of tracks that have a bitrate."""
    profile = F.concat(F.col("sr").cast("string"), F.lit("/"), F.col("bits").cast("string"))
    rows = tracks.select("album_id", profile.alias("profile"), text.norm(F.col("codec")).alias("codec"), F.floor((F.col("bitrate_bps") + 500) / 1000).cast("long").alias("kbps"))
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")
    rated = F.when(F.col("kbps") > 0, F.col("kbps"))
    out = rows.groupBy("album_id").agg(same("profile").alias("profile"), same("codec").alias("codec"), F.bool_or(text.is_lossy(F.col("codec"))).alias("any_lossy"), F.count("*").alias("n_tracks"), F.sum(rated).alias("s"), F.count(rated).alias("c"))
    return out.select("album_id", "profile", "codec", "any_lossy", "n_tracks", F.when(F.col("c") > 0, F.floor((F.col("s") + F.floor(F.col("c") / 2)) / F.col("c")).cast("long")).otherwise(0).alias("mean_kbps"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tracks of two albums side by side by position: position, left_dr, right_dr, left_grade, right_grade, worse side."""
    grade = lambda c: grading.grade(F.col(c), F.lit("standard"))
    a = left.select(F.col("pair").alias("pair"), F.col("position").alias("position"), F.col("dr").alias("left_dr"))
    b = right.select(F.col("pair").alias("p"), F.col("position").alias("q"), F.col("dr").alias("right_dr"))
    both = a.join(b, (F.col("pair") == F.col("p")) & (F.col("position") == F.col("q")), "full_outer")
    both = both.select(F.coalesce("pair", "p").alias("pair"), F.coalesce("position", "q").alias("position"), "left_dr", "right_dr", grade("left_dr").alias("left_grade"), grade("right_dr").alias("right_grade"))
    return both.withColumn("better", F.when(F.col("left_dr") > F.col("right_dr"), "left").when(F.col("left_dr") < F.col("right_dr"), "right").when(F.col("left_dr") == F.col("right_dr"), "equal"))


def worst_grade(tracks: DataFrame) -> DataFrame:
    """album_id, worst grade over tracks, and the mean dynamic range, half to even."""
    rows = tracks.withColumn("rank", grading.grade_rank(grading.grade(F.col("dr"), F.lit("standard"))))
    out = rows.groupBy("album_id").agg(F.min("rank").alias("rank"), F.bround(F.avg("dr")).cast("int").alias("mean_dr"))
    names = F.create_map(*[x for r, g in ((5, "S"), (4, "A"), (3, "B"), (2, "C"), (1, "F")) for x in (F.lit(r), F.lit(g))])
    return out.select("album_id", F.element_at(names, F.col("rank")).alias("worst"), "mean_dr")


def boost_plan(tracks: DataFrame) -> DataFrame:
    """album_id, gain in dB to a true peak of -1.5, and whether it is worth it (0.3 dB and more)."""
    peaks = tracks.groupBy("album_id").agg(F.max("peak_tenths").alias("peak"))
    gain = F.round(F.lit(-1.5) - F.col("peak") / 10, 3)
    return peaks.select("album_id", gain.alias("gain_db"), (F.abs(gain) >= 0.3).alias("apply"), F.format_string("%+.3f dB", gain).alias("label"))


def loudness(tracks: DataFrame) -> DataFrame:
    """album_id, loudness of the album as the mean of its tracks by duration, and the gain to -23 in 1/256 dB."""
    rows = tracks.where("seconds > 0").groupBy("album_id").agg(F.sum(F.col("peak_tenths") * F.col("seconds")).alias("weighted"), F.sum("seconds").alias("seconds"))
    mean = F.round(F.col("weighted") / F.col("seconds") / 10 - 14, 4)
    return rows.select("album_id", mean.alias("loudness"), sizes.fixed_gain(F.lit(-23) - mean).alias("fixed_gain"))


def track_gains(tracks: DataFrame, album_gain: DataFrame) -> DataFrame:
    """album_id, position, gain in dB to -23 and in 1/256 dB, peak as a factor, of tracks (loudness, peak_db; null: not measured).

    A track without a loudness has its album's gain (album_id, gain_db), one without a peak the factor 1.
    """
    a = album_gain.select(F.col("album_id").alias("_a"), "gain_db")
    gain = F.coalesce(F.round(F.lit(-23) - F.col("loudness"), 3), F.col("gain_db"))
    rows = tracks.join(a, F.col("album_id") == F.col("_a"), "left").withColumn("gain", gain)
    return rows.select("album_id", "position", "gain", sizes.fixed_gain(F.col("gain")).alias("fixed_gain"), F.coalesce(sizes.linear_gain(F.col("peak_db")), F.lit(1.0)).alias("peak"))


def dataset_matrix(sources: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """id, variant for each source (id, sr, bits) and each variant it needs, less those that exist: clean ones only below its
    own profile, by rate, at the same rate by depth.
    """
    part = lambda c, i: F.split_part(c, F.lit("/"), F.lit(i)).cast("int")
    clean = F.filter(F.array(*[F.lit(c) for c in CLEAN]), lambda c: (part(c, 1) < F.col("sr")) | ((part(c, 1) == F.col("sr")) & (part(c, 2) < F.col("bits"))))
    wanted = sources.select("id", F.explode(F.concat(clean, F.array(*[F.lit(v) for v in VARIANTS]))).alias("variant"))
    return wanted if force else wanted.join(existing, ["id", "variant"], "left_anti")


def preflight(tracks: DataFrame, target_sr: int, target_bits: int, lossy_allowed: bool = False) -> DataFrame:
    """album_id, position, path, error for each track (path, codec, sr, bits as text or number) that can't be converted to FLAC.

    Errors in their order, one for each track: its target's path is another's already, no codec, a lossy one (unless
    allowed), no rate, no depth, a target above the source. DSD has a depth of 24 at least. The texts are fixed values.
    """
    target = F.regexp_replace("path", r"\.[^.]*$", "")
    first = F.first("path").over(Window.partitionBy("album_id", target).orderBy("position"))
    number = lambda c: F.coalesce(F.when(F.col(c).cast("string").rlike("^[0-9]+$"), F.col(c).try_cast("int")), F.lit(0))
    codec = text.norm(F.coalesce("codec", F.lit("")))
    dsd = codec.startswith("dsd") | (codec == "dst")
    rows = tracks.withColumns({"_first": first, "_codec": codec, "_sr": number("sr"), "_bits": F.when(dsd, F.greatest(number("bits"), F.lit(24))).otherwise(number("bits"))})
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    path, profile = F.col("path"), F.concat(F.col("_sr").cast("string"), F.lit("/"), F.col("_bits").cast("string"))
    error = (
        F.when(F.col("_first") != path, said("target collision: '", F.col("_first"), "' and '", path, "' both map to '", target, ".flac'"))
        .when(F.col("_codec") == "", said(path, ": unable to detect codec"))
        .when(F.lit(not lossy_allowed) & text.is_lossy(F.col("_codec")), said(path, ": lossy source codec '", F.col("_codec"), "' is not allowed for FLAC replace workflow"))
        .when(F.col("_sr") <= 0, said(path, ": unable to detect sample rate"))
        .when(F.col("_bits") <= 0, said(path, ": unable to detect bit depth"))
        .when((F.lit(target_sr) > F.col("_sr")) | (F.lit(target_bits) > F.col("_bits")), said(path, f": target '{target_sr}/{target_bits}' is higher than source '", profile, "' (upscale blocked)"))
    )
    return rows.select("album_id", "position", "path", error.alias("error")).where("error is not null")


def split_plan(tracks: DataFrame) -> DataFrame:
    """album_id, position, start, duration (null for the last), in_order: marks of an album's tracks as spans."""
    order = Window.partitionBy("album_id").orderBy("position")
    start = F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = tracks.withColumn("start", F.round(F.coalesce(start, F.lit(0)) + (F.col("cutoff_hz") % 75) / 75, 6))
    rows = rows.withColumns({"next": F.lead("start").over(order), "last": F.lag("start").over(order)})
    return rows.select("album_id", "position", "start", F.round(F.col("next") - F.col("start"), 6).alias("duration"), F.coalesce(F.col("last") < F.col("start"), F.lit(True)).alias("in_order"))


def carried(lines: DataFrame) -> DataFrame:
    """conv, line, speaker, question: the last question of a user before or at each line, and how many lines ago."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return lines.select("conv_id", "turn", "role", F.last(asked, ignorenulls=True).over(order).alias("asked_at"))


def runs(values: DataFrame, low: float, high: float) -> DataFrame:
    """key, longest: the most neighbouring values whose step to the one before lies in [low, high] (gaps and islands)."""
    order = Window.partitionBy("key").orderBy("value")
    rows = values.distinct().withColumn("step", F.col("value") - F.lag("value").over(order))
    rows = rows.withColumn("broken", F.when(F.col("step").between(low, high), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "island").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("longest"))


def smoothed(rows: DataFrame, half: int = 2, sustain: int = 3, threshold: float = 8.0) -> DataFrame:
    """key, first_row: the first row from which `sustain` smoothed values have a mean of the threshold or more.

    Smoothed: the mean over 2 half + 1 rows, rows beyond the ends as zeros (so it is always divided by the full number).
    """
    order = Window.partitionBy("key").orderBy("row")
    mean = F.sum("value").over(order.rowsBetween(-half, half)) / (2 * half + 1)
    soft = rows.withColumn("soft", mean)
    ahead = F.avg("soft").over(order.rowsBetween(0, sustain - 1))
    left = F.count("*").over(order.rowsBetween(0, sustain - 1))
    found = soft.withColumns({"ahead": ahead, "left": left}).where((F.col("left") == sustain) & (F.col("ahead") >= threshold))
    return found.groupBy("key").agg(F.min("row").alias("first_row"))


def even_sample(rows: DataFrame, k: int = 3) -> DataFrame:
    """key, position of k rows spread evenly over the n of each key: places floor(i (n - 1) / (k - 1)); all if n <= k."""
    order = Window.partitionBy("key").orderBy("position")
    numbered = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("key"))})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (k - 1)))
    return numbered.where((F.col("n") <= k) | F.array_contains(places, F.col("i").cast("long"))).select("key", "position")


def cache_hits(tracks: DataFrame, cache: DataFrame) -> DataFrame:
    """album_id, hits, misses of tracks whose path, time and size are all as in the cache."""
    c = cache.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(1).alias("hit")).distinct()
    rows = tracks.join(c.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s")), "left")
    return rows.groupBy("album_id").agg(F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def corpus_check(found: DataFrame, expected: DataFrame) -> DataFrame:
    """status counts of expected entries (path, trust, target, decision) against what was found: pass, warn, fail, error."""
    rows = expected.join(found.select(F.col("path").alias("p"), F.col("target").alias("t"), F.col("decision").alias("d")), F.col("path") == F.col("p"), "left")
    wrong = F.filter(F.array(F.when(F.col("target") != F.col("t"), "target"), F.when(F.col("decision") != F.col("d"), "decision")), lambda x: x.isNotNull())
    status = F.when(F.col("p").isNull(), "error").when(F.size(wrong) == 0, "pass").when(F.col("trust") == "trusted", "fail").otherwise("warn")
    return rows.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def release_scores(candidates: DataFrame) -> DataFrame:
    """query_id, release_id, score of the best candidate of each query that has the very title and artist.

    candidates: query_id, place, release_id (text), title, artist, date, wanted_title, wanted_artist, wanted_year, source_score.
    Names compare as plain words (see parsing.plain_words); artists also by their words in any order, or one within the other.
    The best is chosen first (the earlier one of equals; one of less than 0 never), and refused afterwards if its title or
    artist is wrong, or its year is known to be another one.
    """
    sides = {f"_{c}": parsing.plain_words(F.col(c)) for c in ("title", "artist", "wanted_title", "wanted_artist")}
    rows = candidates.where("trim(coalesce(release_id, '')) <> ''").withColumns(sides)
    year = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c).cast("string"), F.lit("")), "^([12][0-9]{3})", 1), F.lit(""))
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    bag = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    title, artist, want, by = F.col("_title"), F.col("_artist"), F.col("_wanted_title"), F.col("_wanted_artist")
    rows = rows.withColumns({"_y": year("date"), "_w": year("wanted_year")})
    exact = (want != "") & (title == want)
    same = (by != "") & (within(artist, by) | (bag(artist) == bag(by)))
    other_year = F.coalesce(F.col("_y") != F.col("_w"), F.lit(False))
    given = F.coalesce(F.when(F.trim(F.col("source_score").cast("string")).rlike("^[+-]?[0-9]+$"), F.trim(F.col("source_score").cast("string")).try_cast("int")), F.lit(0))
    score = (
        F.when(exact, 120).when((want != "") & within(title, want), 40).otherwise(0) + F.when(same, 80).otherwise(0) + F.when(F.col("_y") == F.col("_w"), 20).when(other_year, -40).otherwise(0)
        + F.floor(F.least(F.greatest(given, F.lit(0)), F.lit(100)) / 5).cast("int") + F.when(exact & same, 30).otherwise(0)
    )
    rows = rows.withColumns({"score": score, "ok": exact & same & ~other_year}).where("score > -1")
    best = rows.groupBy("query_id").agg(F.max_by(F.struct("release_id", "score", "ok"), F.struct("score", -F.col("place"))).alias("b"))
    return best.where("b.ok").select("query_id", F.col("b.release_id").alias("release_id"), F.col("b.score").alias("score"))


def band_class(cutoff: Column, top: Column) -> Column:
    low, cd, mid, high = (F.lit(x) for x in ("low-bandwidth", "cd-or-48k", "hires-96-class", "hires-192-class"))
    return (
        F.when(top <= 24.5, F.when(cutoff / top < 0.55, low).otherwise(cd))
        .when(top <= 50, F.when(cutoff < 16, low).when(cutoff < 30, cd).otherwise(mid))
        .otherwise(F.when(cutoff < 18, low).when(cutoff < 26, cd).when(cutoff < 52, mid).otherwise(high))
    )


#: Cutoffs in kHz and the profiles that they speak for.
TIERS = ((22.05, "44100/16"), (24.0, "48000/24"), (44.1, "88200/24"), (48.0, "96000/24"), (88.2, "176400/24"), (96.0, "192000/24"))


def promoted() -> Column:
    """A texture above a CD's cutoff on a 48 kHz axis speaks for 96 kHz."""
    return ~F.col("brickwall") & F.col("transition") & F.col("top").between(44, 52) & F.col("cutoff").between(21, 26) & (F.col("span") >= 28) & (F.col("ratio") >= 0.55)


def likely_profile(x: DataFrame) -> DataFrame:
    """x with likely_profile (the nearest tier, unless texture or an axis filled to its top decide) and profile_confidence."""
    cutoff = F.greatest(F.lit(0.0), F.least(F.col("cutoff"), F.col("top")))
    nearest = F.array_min(F.array(*[F.struct(F.abs(cutoff - k).alias("far"), F.lit(i).alias("i"), F.lit(p).alias("profile")) for i, (k, p) in enumerate(TIERS)]))
    rows = x.withColumn("nearest", nearest)
    far, top = F.col("nearest.far"), F.col("top")
    points = F.when(~F.col("transition"), 0).when(far <= 1.5, 2).when(far <= 4, 1).otherwise(0)
    points = F.when(~F.col("stats") & (points > 0), points - 1).otherwise(points)
    aligned = F.col("transition") & (cutoff >= 0.88 * top)
    by_axis = F.when(top >= 90, "192000/24").when(top >= 44, "96000/24").when(top > 22.5, "48000/24").otherwise("44100/16")
    points = F.when(aligned | promoted(), F.greatest(points, F.lit(1))).otherwise(points)
    profile = F.when(aligned, by_axis).when(promoted(), "96000/24").otherwise(F.col("nearest.profile"))
    return rows.withColumns({"likely_profile": profile, "profile_confidence": F.when(points == 2, "HIGH").when(points == 1, "MEDIUM").otherwise("LOW")}).drop("nearest")


def verdict(x: DataFrame) -> DataFrame:
    """id, label, band, score, class and profile_confidence: the score card under what speaks for lossy sources."""
    wide = ~F.col("brickwall") & (F.col("top") >= 90)
    strong = wide & (F.col("cutoff") <= 50) & (F.col("ratio") <= 0.25)
    middle = wide & (F.col("cutoff") <= 45) & (F.col("ratio") <= 0.7) & (F.col("span") <= 20)
    rows = _scored(likely_profile(x)).withColumns({"strong": strong, "middle": middle, "wall": F.col("brickwall"), "axis": F.col("top")})
    down = F.col("middle") & F.col("class").isin("S", "A", "B")
    s = F.when(down, F.greatest(F.col("score") - 12, F.lit(0))).otherwise(F.col("score"))
    again = F.when((s >= 95) & F.col("band").isin("hires-96-class", "hires-192-class"), "S").when(s >= 86, "A").when(s >= 70, "B").when(s >= 54, "C").when(s >= 38, "D").otherwise("F")
    label = F.when(F.col("wall") & (F.col("axis") > 24.5), "lossy-upsampled").when(F.col("wall") | F.col("strong") | F.col("middle"), "lossy-compressed").otherwise(F.col("likely_profile"))
    return rows.select("id", label.alias("label"), "band", s.alias("score"), F.when(down, again).otherwise(F.col("class")).alias("class"), "profile_confidence")


#: What a score starts from, and its parts: factor, points, reason.
BASE_SCORE = 62
PARTS = {
    "low band": ("band_class", -20, "Bandwidth suggests low-rate/lossy ceiling."),
    "96 band": ("band_class", 8, "Bandwidth supports hi-res 96k class."),
    "192 band": ("band_class", 10, "Bandwidth supports top hi-res class."),
    "other band": ("band_class", 0, "Bandwidth is neutral for quality score."),
    "transition": ("transition_found", 6, "Stable transition detected in spectral energy profile."),
    "no transition": ("transition_found", -4, "No stable transition detected in spectral energy profile."),
    "stats": ("stats_window", 3, "Stats panel detected; OCR context is more reliable."),
    "no stats": ("stats_window", -2, "Stats panel missing; reduce confidence slightly."),
    "no peak": ("peak_amplitude_db", -2, "No OCR peak value detected."),
    "over": ("peak_amplitude_db", -25, "OCR suggests overs/clipping risk."),
    "hot": ("peak_amplitude_db", -10, "Peak near 0 dB implies hot limiting."),
    "headroom": ("peak_amplitude_db", 10, "Healthy headroom preserved."),
    "some headroom": ("peak_amplitude_db", 3, "Slight headroom benefit."),
    "no range": ("dynamic_range_db", -5, "No OCR dynamic-range value detected."),
    "wide": ("dynamic_range_db", 20, "Very wide dynamics."),
    "healthy": ("dynamic_range_db", 10, "Healthy dynamics."),
    "moderate": ("dynamic_range_db", -5, "Moderate compression."),
    "heavy": ("dynamic_range_db", -20, "Heavy compression."),
    "neither": ("ocr_mastering_stats", -2, "Both mastering metrics missing; apply conservative downgrade."),
    "true cd": ("cd_authenticity", 35, "Cutoff aligns with Redbook Nyquist ceiling and no fake-hires signature."),
    "wall": ("brickwall_signature", -35, "Hard cutoff near CD band with weak ultrasonic energy (upsample risk)."),
    "deep": ("ultrasonic_extent", 10, "High-frequency energy reaches deep into ultrasonic band."),
    "aligned": ("axis_aligned_hires", 8, "Cutoff remains close to the detected hi-res Nyquist ceiling."),
    "span": ("spectral_dynamic_span", 8, "Wide spectral contrast suggests non-trivial high-band structure."),
    "ratio": ("high_band_ratio", 4, "High-band energy ratio is plausible for native hi-res texture."),
    "cd in hires": ("cd_band_in_hires_frame", 14, "CD-band ceiling presented on hi-res axis without hard fake-hires signature."),
}
#: What classes are called.
CLASS_LABELS = {"S": "Reference", "A": "Excellent", "B": "Good", "C": "Fair", "D": "Limited", "F": "Poor"}


def score_card(x: DataFrame) -> DataFrame:
    """id, band, score (0 to 100), class and confidence of a spectrogram's figures.

    x: id, cutoff, top, transition, stats, peak, dr, span, ratio, brickwall. Signed parts are added to 62.
    """
    return _scored(x).select("id", "band", "score", "class", "confidence")


def score_breakdown(x: DataFrame) -> DataFrame:
    """id, raw_score, score, label and parts (factor, points, reason, in their order) of a spectrogram's figures (see score_card).

    The raw score is the sum of 62 and all parts, at most 69 or 85 where both levels are missing; the score keeps within 0 to 100.
    """
    label = F.create_map(*(F.lit(v) for pair in CLASS_LABELS.items() for v in pair))[F.col("class")]
    return _scored(x).select("id", F.col("capped").alias("raw_score"), "score", label.alias("label"), "parts")


def _parts() -> Column:
    """The parts of a score as an array of (factor, points, reason), from the figures and the band."""
    peak, dr, band, wall = F.col("peak"), F.col("dr"), F.col("band"), F.col("brickwall")
    hires = band.isin("hires-96-class", "hires-192-class") & ~wall
    cd, top, cutoff = band == "cd-or-48k", F.col("top"), F.col("cutoff")

    def first(*cases: tuple[Column | None, str]) -> Column:
        """The part of the first case that holds (None: any)."""
        made = [F.struct(*(F.lit(v).alias(n) for v, n in zip(PARTS[name], ("factor", "points", "reason"), strict=True))) for _, name in cases]
        return F.coalesce(*(one if test is None else F.when(test, one) for (test, _), one in zip(cases, made, strict=True)))

    return F.array_compact(
        F.array(
            first((band == "low-bandwidth", "low band"), (band == "hires-96-class", "96 band"), (band == "hires-192-class", "192 band"), (None, "other band")),
            first((F.col("transition"), "transition"), (None, "no transition")),
            first((F.col("stats"), "stats"), (None, "no stats")),
            first((peak.isNull(), "no peak"), (peak > 0.2, "over"), (peak >= -0.2, "hot"), (peak <= -2, "headroom"), (None, "some headroom")),
            first((dr.isNull(), "no range"), (dr >= 14, "wide"), (dr >= 10, "healthy"), (dr >= 7, "moderate"), (None, "heavy")),
            first((peak.isNull() & dr.isNull(), "neither")),
            first((~wall & cd & (cutoff >= 0.75 * top), "true cd")),
            first((wall, "wall"), (hires & (top >= 90) & (cutoff >= 50), "deep"), (hires & (top >= 44) & (cutoff >= 0.88 * top), "aligned"), (cd & (top >= 90) & (cutoff >= 18), "cd in hires")),
            first((hires & (F.col("span") >= 30), "span")),
            first((hires & F.col("ratio").between(0.25, 1.4), "ratio")),
        )
    )


def _scored(x: DataFrame) -> DataFrame:
    """x with band, parts, score, class and confidence (see score_card)."""
    rows = x.withColumn("band", F.when(promoted(), "hires-96-class").otherwise(band_class(F.col("cutoff"), F.col("top"))))
    peak, dr, band = F.col("peak"), F.col("dr"), F.col("band")
    hires = band.isin("hires-96-class", "hires-192-class")
    rows = rows.withColumn("parts", _parts()).withColumn("raw", F.aggregate("parts", F.lit(BASE_SCORE), lambda a, p: a + p["points"]))
    none = peak.isNull() & dr.isNull()
    rows = rows.withColumn("capped", F.when(none & (band == "cd-or-48k"), F.least("raw", F.lit(69))).when(none & hires, F.least("raw", F.lit(85))).otherwise(F.col("raw")))
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("capped"))))
    s = F.col("score")
    top_class = hires & ~F.col("brickwall") & ((s >= 95) | ((s >= 93) & (F.col("cutoff") >= 50) & (F.col("span") >= 30) & (F.col("ratio") <= 0.6)) | F.coalesce((s >= 90) & (dr >= 20), F.lit(False)))
    points = F.col("transition").cast("int") + F.col("stats").cast("int") + peak.isNotNull().cast("int") + 2 * dr.isNotNull().cast("int")
    grade = F.when(top_class, "S").when(s >= 86, "A").when(s >= 70, "B").when(s >= 54, "C").when(s >= 38, "D").otherwise("F")
    return rows.withColumns({"class": grade, "confidence": F.when(points >= 4, "HIGH").when(points >= 2, "MEDIUM").otherwise("LOW")})


#: The remarks on a spectrogram's figures. %s is the cutoff in kHz.
LOW_PASS, CEILING, WIDE_BAND = "Strong low-pass signature; likely lossy or low-rate source.", "Bandwidth is near CD/48k ceiling.", "Bandwidth supports a high-resolution source class."
WALL_HIGH = "Brickwall-like cutoff around %s kHz with weak ultrasonic content; likely upsampled/fake hi-res."
WALL_LOW = "Brickwall-like cutoff around %s kHz with weak upper-band content; likely strong lossy/band-limited source."
REDBOOK = "Cutoff is near Nyquist for this scale; consistent with authentic Redbook/CD bandwidth."
PEAK_OVER, PEAK_NEAR = "Peak above 0 dB detected by OCR; possible clipping or OCR misread.", "Peak is near 0 dB; mastering likely loud/hot."
PEAK_FREE, PEAK_NONE = "Peak headroom is preserved; less aggressive limiting.", "Peak metric unavailable from OCR; quality class is downgraded conservatively."
RANGE_WIDE, RANGE_GOOD = "Dynamic range appears wide.", "Dynamic range appears healthy."
RANGE_SOME, RANGE_LOW = "Dynamic range appears moderately compressed.", "Dynamic range appears heavily compressed."
RANGE_NONE = "Dynamic-range metric unavailable from OCR; quality class is downgraded conservatively."
TEXTURE = "Hi-res frame retains plausible ultrasonic texture beyond a simple CD-width ceiling."


def insights(x: DataFrame) -> DataFrame:
    """id, insights: the remarks that a spectrogram's figures call for, on bandwidth, wall or ceiling, peak and range.

    x as in score_card. A null peak or range has its own remark; a peak between -2 and -0.2 dB has none.
    """
    cutoff, top, peak, dr = F.col("cutoff"), F.col("top"), F.col("peak"), F.col("dr")
    khz = F.format_string("%.1f", cutoff)
    wall = F.when(top > 24.5, F.lit(WALL_HIGH)).otherwise(WALL_LOW)
    at_ceiling = (F.when(promoted(), "hires-96-class").otherwise(band_class(cutoff, top)) == "cd-or-48k") & (cutoff >= 0.75 * top)
    remarks = F.array(
        F.when(cutoff < 18, LOW_PASS).when(cutoff < 26, CEILING).when(cutoff >= 44, WIDE_BAND),
        F.when(F.col("brickwall"), F.replace(wall, F.lit("%s"), khz)).when(at_ceiling, REDBOOK),
        F.when(peak.isNull(), PEAK_NONE).when(peak > 0.2, PEAK_OVER).when(peak >= -0.2, PEAK_NEAR).when(peak <= -2, PEAK_FREE),
        F.when(dr.isNull(), RANGE_NONE).when(dr >= 14, RANGE_WIDE).when(dr >= 10, RANGE_GOOD).when(dr >= 7, RANGE_SOME).otherwise(RANGE_LOW),
        F.when(promoted(), TEXTURE),
    )
    return x.select("id", F.array_compact(remarks).alias("insights"))
