"""The manifest of a transfer: which folder each wanted album is taken from, its year, and where it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.functions import paths, years


def source_of(wanted: DataFrame, albums: DataFrame, folders: DataFrame) -> DataFrame:
    """wanted (id, artist, album, year_int, source_path) with source_id and source: the folder that is there to take it from.

    Its own path if that is a folder (folders: path). Else a catalog row (id, artist, album, year_int, source_path) of the same
    album and year whose path is: the row of the same id, else the lowest id of the same artist, else the lowest id at all.
    Each step is a table with one row for a key, so albums of a common name don't meet each other. Null if there is none.
    """
    there = folders.select(F.col("path").alias("_path")).distinct()
    c = albums.join(there, F.col("source_path") == F.col("_path")).where("source_path <> ''")
    c = c.select(F.col("id").alias("_id"), F.lower("artist").alias("_artist"), F.lower("album").alias("_album"), F.coalesce("year_int", F.lit(0)).alias("_year"), "source_path")
    row = F.struct(F.col("_id").alias("id"), F.col("source_path").alias("path"))
    first = lambda *key, name: c.groupBy(*key).agg(F.min(row).alias(name))
    w = wanted.withColumns({"_a": F.lower("artist"), "_b": F.lower("album"), "_y": F.coalesce("year_int", F.lit(0))})
    same = (F.col("_b") == F.col("_album")) & (F.col("_y") == F.col("_year"))
    w = w.join(there.withColumnRenamed("_path", "_own"), F.col("source_path") == F.col("_own"), "left")
    for key, name, on in (
        (("_id", "_album", "_year"), "_same_id", same & (F.col("id") == F.col("_id"))),
        (("_artist", "_album", "_year"), "_same_artist", same & (F.col("_a") == F.col("_artist"))),
        (("_album", "_year"), "_any", same),
    ):
        w = w.join(first(*key, name=name), on, "left").drop(*key)
    own = F.when(F.col("_own").isNotNull(), F.struct("id", F.col("_own").alias("path")))
    found = F.coalesce(own, F.col("_same_id"), F.col("_same_artist"), F.col("_any"))
    return w.withColumns({"source_id": found["id"], "source": found["path"]}).drop("_a", "_b", "_y", "_own", "_same_id", "_same_artist", "_any")


def manifest(wanted: DataFrame, albums: DataFrame, folders: DataFrame, tags: DataFrame, root: str) -> DataFrame:
    """id, artist, album, year, source, target for each wanted album that has a source (see source_of).

    tags: path, lines of the first audio file of a folder, at most one row for a folder. The year is that of its tags and folder
    (see years.release_year), else as it was. target: below the player's folder as the source is below root, else by
    artist, year and album.
    """
    t = tags.select(F.col("path").alias("_path"), "lines")
    rows = source_of(wanted, albums, folders).where("source is not null").join(t, F.col("source") == F.col("_path"), "left")
    told = years.release_year(F.col("lines"), F.col("source"), F.col("year_int"))
    year = F.when(told.between(1000, 2999), told).otherwise(F.col("year_int"))
    rows = rows.withColumn("year", year)
    return rows.select("id", "artist", "album", "year", "source", paths.library_path_for(F.col("source"), root, F.col("artist"), F.col("year"), F.col("album")).alias("target"))
