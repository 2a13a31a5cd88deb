"""Reports on albums: tracks with their grades, the album's class beside its standard one, and two albums against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.functions import grading, sizes
from needledrop.functions.paths import clipped


def track_report(tracks: DataFrame) -> DataFrame:
    """Tracks of albums as they are shown: name, genre_tag (the track's own, else its album's), size, codec, bitrate, dr, grade.

    tracks: album_id, position, name, profile, track_genre, album_genre, size, codec, bitrate_bps, dr (null: not measured).
    """
    own, of_album = sizes.short_tag(F.col("track_genre")), sizes.short_tag(F.col("album_genre"))
    kbps = F.when(F.col("bitrate_bps") > 0, F.concat(F.floor((F.col("bitrate_bps") + 500) / 1000).cast("string"), F.lit("k"))).otherwise("-")
    return tracks.select(
        "album_id", "position", clipped(sizes.one_line(F.col("name")), 52).alias("name"), F.col("profile").alias("preset"), F.when(own != "-", own).otherwise(of_album).alias("genre_tag"), sizes.short_size(F.col("size")).alias("size"),
        F.coalesce(F.nullif(F.lower("codec"), F.lit("")), F.lit("-")).alias("codec"), kbps.alias("bitrate"), sizes.short_number(F.col("dr")).alias("dr"), F.coalesce(grading.grade(F.col("dr"), F.col("profile")), F.lit("-")).alias("grade"),
    )


def album_report(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """album_id, tracks, measured, mean_dr (half to even), class, standard_class, note, save of albums.

    tracks: album_id, dr; albums: album_id, profile, db_dr, db_class (as the catalog has them). A class is that of the exact
    mean, cut to a whole number; the note tells when the album's preset changes it; save: mean or class differ from the
    catalog's. The first and second grading are of one pass over the tracks.
    """
    sums = tracks.groupBy("album_id").agg(F.count("*").alias("tracks"), F.count("dr").alias("measured"), F.avg("dr").alias("_mean"))
    a = albums.select(F.col("album_id").alias("_a"), "profile", "db_dr", "db_class")
    r = sums.join(a, F.col("album_id") == F.col("_a"))
    there = F.col("_mean").isNotNull()
    r = r.withColumns({"mean_dr": F.bround("_mean").cast("int"), "class": F.coalesce(grading.grade(F.col("_mean"), F.col("profile")), F.lit("-")), "standard_class": F.coalesce(grading.grade(F.col("_mean"), F.lit("standard")), F.lit("-"))})
    note = F.concat(F.lit("album-level scoring preset "), "profile", F.lit(" changed class "), "standard_class", F.lit(" -> "), "class", F.lit(" at DR "), F.col("mean_dr").cast("string"))
    changed = there & (F.col("profile") != "standard") & (F.col("standard_class") != F.col("class"))
    save = there & (~F.bround("db_dr").cast("int").eqNullSafe(F.col("mean_dr")) | ~F.col("db_class").eqNullSafe(F.col("class")))
    return r.select("album_id", "tracks", "measured", "mean_dr", "class", "standard_class", F.when(changed, note).otherwise("").alias("note"), save.alias("save"))


def overall(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """album_id, grade, dr of albums as a comparison sums them up: their own total and grade (total, grade; null or N/A for none), else the mean over
    tracks with a number (half to even) and the worst grade of a track.
    """
    rank = F.when(F.col("dr").isNotNull(), grading.grade_rank(grading.grade(F.col("dr"), F.lit("standard"))))
    t = tracks.groupBy(F.col("album_id").alias("_t")).agg(F.bround(F.avg("dr")).cast("long").alias("_mean"), F.min(rank).alias("_worst"))
    names = F.create_map(*(F.lit(x) for pair in ((5, "S"), (4, "A"), (3, "B"), (2, "C"), (1, "F")) for x in pair))
    given = lambda c: F.when(~F.upper(F.trim(F.col(c))).isin("", "N/A"), F.trim(F.col(c)))
    total = F.when(given("total").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), given("total"))
    r = albums.join(t, F.col("album_id") == F.col("_t"), "left")
    return r.select("album_id", F.coalesce(given("grade"), names[F.col("_worst")], F.lit("N/A")).alias("grade"), F.concat(F.lit("DR"), F.coalesce(total, F.col("_mean").cast("string"), F.lit("N/A"))).alias("dr"))


#: Fields of an analysis in JSON, and what stands for one that is missing.
FIELDS = {
    "recodeTo": "", "fakeUpscale": "0", "hasFakeUpscaleTracks": "0", "familySampleRateHz": "", "analyzeDecision": "", "drTotal": "", "grade": "", "genreProfile": "standard",
    "samplingRateHz": "", "averageBitrateKbs": "", "bitsPerSample": "",
}


def flattened(analyses: DataFrame) -> DataFrame:
    """id, one text column for each of FIELDS, and ok: whether the analysis (id, json) has what a scan needs (recodeTo, drTotal, grade).

    Flags are 1 or 0. Text that is no JSON object gives the defaults and isn't ok.
    """
    schema = ", ".join(f"{name} string" for name in FIELDS)
    parsed = analyses.select("id", F.from_json("json", schema).alias("j"))
    flag = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "false", "0", "null", "[]", "{}"), "0").otherwise("1")
    one = lambda name, default: flag(F.col(f"j.{name}")) if default == "0" else F.coalesce(F.col(f"j.{name}"), F.lit(default))
    rows = parsed.select("id", *(one(name, default).alias(name) for name, default in FIELDS.items()))
    return rows.withColumn("ok", (F.col("recodeTo") != "") & (F.col("drTotal") != "") & (F.col("grade") != ""))
