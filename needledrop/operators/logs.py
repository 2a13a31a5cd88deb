"""What the logs of other programs tell, as tables of lines (log, line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Without the terminal's colours."""
    return F.regexp_replace(text, "\\x1B\\[[0-9;]*[A-Za-z]", "")


def true_peaks(lines: DataFrame) -> DataFrame:
    """log, peak: the input's true peak in dB in the first line of a log that states one; null if it states no number."""
    rows = lines.where(F.contains("text", F.lit("Input True Peak:")))
    first = rows.groupBy("log").agg(F.min_by("text", "line_no").alias("text"))
    token = F.regexp_extract("text", r"Input True Peak:\s*(\S*)", 1)
    number = F.regexp_replace(token, r"^\+", "")
    return first.select("log", F.when(number.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), number.try_cast("double")).alias("peak"))


def art_lines(lines: DataFrame) -> DataFrame:
    """log, art: what the last line of a log that speaks of artwork says, without colours."""
    rows = lines.withColumn("text", plain(F.col("text"))).where(F.contains("text", F.lit("Art:")))
    return rows.groupBy("log").agg(F.max_by("text", "line_no").alias("text")).select("log", F.regexp_extract("text", r"(?s)(Art:.*)$", 1).alias("art"))


def art_summary(a: DataFrame) -> DataFrame:
    """a with art: the artwork of an album in one line.

    a: status, error, sidecar, width, height, tracks_ok, tracks, sidecars_cleared, embeds_cleared, source, warning, cached, changed.
    """
    or_zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    label = F.upper(F.coalesce("status", F.lit("unknown")))
    given = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" | {name}="), F.col(c))).otherwise("")
    whole = F.concat(
        F.lit("Art: "), label, F.lit(" | "), F.coalesce("sidecar", F.lit("cover.jpg")), F.lit(" | JPEG "), or_zero("width"), F.lit("x"), or_zero("height"), F.lit(" | embedded "), or_zero("tracks_ok"), F.lit("/"), or_zero("tracks"),
        F.lit(" | sidecars cleared="), or_zero("sidecars_cleared"), F.lit(" | extra embeds cleared="), or_zero("embeds_cleared"), given("source", "source"), given("warning", "warning"),
        F.when(F.coalesce("cached", F.lit(False)), " | cached").when(F.coalesce("changed", F.lit(False)), " | updated").otherwise(""),
    )
    return a.withColumn("art", F.when(F.col("status") == "error", F.concat(F.lit("Art: "), label, F.lit(" | "), F.coalesce("error", F.lit("unknown failure")))).otherwise(whole))


def walk(albums: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a walk over albums (dir, code of the exit) with their logs came to: one row of albums, ok, failed; and dir, line of those that failed."""
    counts = albums.agg(F.count("*").alias("albums"), F.count_if(F.col("code") == 0).alias("ok"), F.count_if(F.col("code") != 0).alias("failed"))
    said = art_lines(logs).withColumnRenamed("log", "_log")
    failed = albums.where("code <> 0").join(said, F.col("dir") == F.col("_log"), "left")
    return counts, failed.select("dir", F.concat("dir", F.lit(" | "), F.coalesce("art", F.lit("Art: ERROR | album processing failed"))).alias("line"))


def smaller_side(width: Column, height: Column) -> Column:
    """The smaller of two sides; 0 if one is unknown."""
    n = lambda c: F.coalesce(F.when(c.cast("string").rlike("^[0-9]+$"), c.try_cast("int")), F.lit(0))
    return F.when((n(width) == 0) | (n(height) == 0), 0).otherwise(F.least(n(width), n(height)))


def chosen_art(albums: DataFrame) -> DataFrame:
    """dir, source, fetched of each album: where its cover comes from, and whether that was asked of a remote place.

    albums: dir, sidecar, embedded (names, null for none), local_width, local_height, fetch (boolean), least (the side that is
    wished for), remote (a name, null if there is none), remote_width, remote_height. A sidecar goes before a picture in a
    track. A remote one is asked for where there is no local one or its smaller side is known and too small, and taken if larger.
    """
    local = F.coalesce(F.concat(F.lit("sidecar:"), "sidecar"), F.concat(F.lit("embedded:"), "embedded"))
    mine, other = smaller_side(F.col("local_width"), F.col("local_height")), smaller_side(F.col("remote_width"), F.col("remote_height"))
    small = (F.col("least") > 0) & (mine > 0) & (mine < F.col("least"))
    ask = F.coalesce(F.col("fetch") & (local.isNull() | small), F.lit(False))
    better = ask & F.col("remote").isNotNull() & (local.isNull() | (other > mine))
    return albums.select("dir", F.when(better, F.col("remote")).otherwise(local).alias("source"), ask.alias("fetched"))
