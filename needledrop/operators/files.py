"""Listings of files, cache lines and manifests as tables: scans, walks, sums for each folder, choices among candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needledrop.functions import media, text

#: Folders that a walk leaves out, and file names that no transfer takes.
PRUNED = ("before-recode",)
PICTURES = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff")
COVERS = ("cover", "folder", "front")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def listing(spark: SparkSession, root: str, newer_than: str | None = None) -> DataFrame:
    """path, size, mtime of the files under root, read from their metadata; newer_than (ISO time): only those changed later."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("modifiedAfter", newer_than) if newer_than else reader
    return reader.load(root).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def walked(files: DataFrame) -> DataFrame:
    """Files outside the folders that a walk leaves out."""
    pattern = "/(" + "|".join(PRUNED) + ")/"
    return files.where(~F.lower("path").rlike(pattern))


def audio_files(files: DataFrame, probed: DataFrame) -> DataFrame:
    """Audio by its ending, and those of other endings for which the probe (path, codec) found a codec; each path once."""
    known = files.where(media.is_audio(F.col("path")))
    heard = probed.where(F.coalesce("codec", F.lit("")) != "").select(F.col("path").alias("_path")).distinct()
    other = files.where(~media.is_audio(F.col("path"))).join(heard, F.col("path") == F.col("_path"), "left_semi")
    return known.unionByName(other).dropDuplicates(["path"])


def folders_with_audio(files: DataFrame) -> DataFrame:
    """Distinct folders (dir) that hold audio outside pruned folders."""
    return walked(files).where(media.is_audio(F.col("path"))).select(folder(F.col("path")).alias("dir")).distinct()


def changed_folders(files: DataFrame, since: int, folders: DataFrame | None = None) -> DataFrame:
    """Folders (dir) with audio changed after a time, and those of folders (dir, mtime) that were themselves changed, outside pruned ones."""
    by_file = folders_with_audio(files.where(F.col("mtime") > since))
    if folders is None:
        return by_file
    pruned = F.lower("dir").rlike("/(" + "|".join(PRUNED) + ")(/|$)")
    return by_file.union(folders.where((F.col("mtime") > since) & ~pruned).select("dir")).distinct()


def folder_sums(files: DataFrame) -> DataFrame:
    """dir, n_files, content_mtime (newest audio), payload_bytes (what a transfer takes) of each folder."""
    audio, end = media.is_audio(F.col("path")), media.ending(F.col("path"))
    stem = F.regexp_replace(F.lower(name(F.col("path"))), r"\.[^.]*$", "")
    cache = F.startswith(name(F.col("path")), F.lit("."))
    payload = ~cache & (~end.isin(*PICTURES) | (stem == "cover"))
    rows = files.select(folder(F.col("path")).alias("dir"), audio.alias("audio"), payload.alias("payload"), "size", "mtime")
    return rows.groupBy("dir").agg(F.count_if("audio").alias("n_files"), F.max(F.when(F.col("audio"), F.col("mtime"))).alias("content_mtime"), F.coalesce(F.sum(F.when(F.col("payload"), F.col("size"))), F.lit(0)).alias("payload_bytes"))


def pcm_bytes(tracks: DataFrame) -> DataFrame:
    """album_id, bytes of its sound as PCM (half to even) and its seconds: all seconds, at rate, channels and depth of the first track.

    Unknown channels are 2, an unknown depth 24; without a rate there are no bytes.
    """
    number = lambda c, other: F.coalesce(F.when(F.col(c).cast("string").rlike("^[0-9]+$"), F.col(c).try_cast("int")), F.lit(other)).alias(c)
    first = F.min_by(F.struct(number("sr", 0), number("channels", 2), number("bits", 24)), F.col("position"))
    sums = tracks.groupBy("album_id").agg(F.coalesce(F.sum("seconds"), F.lit(0)).cast("double").alias("seconds"), first.alias("f"))
    bytes_ = F.col("seconds") * F.col("f.sr") * F.col("f.channels") * (F.col("f.bits") / 8)
    return sums.select("album_id", F.bround(bytes_).cast("long").alias("bytes"), "seconds")


def decoding_hints(tracks: DataFrame, sheets: DataFrame) -> DataFrame:
    """path, has_sheet, by_ffmpeg of tracks (path, seconds as far as they are known): whether a cue sheet (sheets: path) lies in the same folder, and whether to decode by
    ffmpeg at once, for a dear format or an unknown length.
    """
    dirs = sheets.where(media.ending(F.col("path")) == "cue").select(folder(F.col("path")).alias("_dir")).distinct()
    rows = tracks.join(dirs, folder(F.col("path")) == F.col("_dir"), "left")
    dear = media.ending(F.col("path")).isin(*media.DEAR_ENDINGS)
    return rows.select("path", F.col("_dir").isNotNull().alias("has_sheet"), (dear | F.coalesce(F.col("seconds") <= 0, F.lit(True))).alias("by_ffmpeg"))


def source_caps(tracks: DataFrame) -> DataFrame:
    """album_id, lowest rate and depth above zero (depth 24 without one), highest cutoff, whether codecs differ."""
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    return tracks.groupBy("album_id").agg(
        F.min(above("sr")).alias("rate"), F.coalesce(F.min(above("bits")), F.lit(24)).alias("depth"), F.max("cutoff_hz").alias("cutoff"), (F.count_distinct(F.coalesce("codec", F.lit(""))) > 1).alias("codecs_differ")
    )


def best_cover(files: DataFrame) -> DataFrame:
    """The cover file of each folder: cover before folder before front, then by the order of endings, then by name."""
    stem = F.regexp_extract(F.lower(name(F.col("path"))), r"^(.*)\.[^.]*$", 1)
    end = media.ending(F.col("path"))
    rank = lambda x, values: F.array_position(F.array(*map(F.lit, values)), x)
    rows = files.where(stem.isin(*COVERS) & end.isin(*PICTURES)).select(folder(F.col("path")).alias("dir"), "path", F.struct(rank(stem, COVERS).alias("a"), rank(end, PICTURES).alias("b"), F.col("path").alias("c")).alias("key"))
    return rows.groupBy("dir").agg(F.min_by("path", "key").alias("path"))


def resolved_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """sheet, number, path: the file that each reference (sheet, number, dir, file) of a sheet means, null if none.

    The name as it is before the same in another case before the same stem with another ending.
    """
    stem = lambda c: F.regexp_replace(F.lower(c), r"\.[^.]*$", "")
    have = files.where(media.is_audio(F.col("path"))).select(folder(F.col("path")).alias("_dir"), F.col("path"), name(F.col("path")).alias("_name"))
    met = references.join(have, (F.col("dir") == F.col("_dir")) & (stem(F.col("file")) == stem(F.col("_name"))), "left")
    rank = F.when(F.col("file") == F.col("_name"), 0).when(F.lower("file") == F.lower("_name"), 1).otherwise(2)
    return met.groupBy("sheet", "dir", "number").agg(F.min_by("path", F.struct(rank.alias("r"), "path")).alias("path"))


def chosen_sheet(references: DataFrame, files: DataFrame) -> DataFrame:
    """dir, sheet of folders in which one sheet alone has all its references resolved."""
    whole = resolved_references(references, files).groupBy("dir", "sheet").agg(F.count("*").alias("n"), F.count("path").alias("found")).where("n = found")
    return whole.groupBy("dir").agg(F.count("*").alias("sheets"), F.min("sheet").alias("sheet")).where("sheets = 1").select("dir", "sheet")


def source_rows(wanted: DataFrame, albums: DataFrame) -> DataFrame:
    """id, source_id, source_path for wanted rows (id, artist, album, year_int): a catalog row of its album and year with a path.

    The row itself before one of the same artist before the lowest id. Of each rank's rows only the one that would be taken
    meets a wanted row, so an album and year that thousands of rows share costs as many rows, not as many pairs.
    """
    have = albums.where(F.coalesce("source_path", F.lit("")) != "").select(F.col("id").alias("source_id"), F.lower("artist").alias("_artist"), F.lower("album").alias("_album"), F.col("year_int").alias("_year"), "source_path")
    source = F.struct("source_id", "source_path")
    first = lambda name, *keys: have.groupBy(*keys).agg(F.min(source).alias(name)).select(*(F.col(k).alias(f"{name}{k}") for k in keys), name)
    place = {"_album": F.lower("album"), "_year": F.col("year_int")}
    rows = wanted
    for name, more in (("_own", {"source_id": F.col("id")}), ("_same", {"_artist": F.lower("artist")}), ("_any", {})):
        keys = place | more
        on = [value == F.col(f"{name}{k}") for k, value in keys.items()]
        rows = rows.join(first(name, *keys), reduce(Column.__and__, on), "left")
    rank = F.when(F.col("_own").isNotNull(), 0).when(F.col("_same").isNotNull(), 1).otherwise(2)
    best = rows.where("_any is not null").groupBy("id").agg(F.min(F.struct(rank.alias("r"), F.coalesce("_own", "_same", "_any").alias("b"))).alias("m"))
    return best.select("id", "m.b.*")


def backup_plan(albums: DataFrame, backed_up: DataFrame, root: str) -> DataFrame:
    """id, decision: outside (its path isn't under root), there (the backup has audio at the relative path), copy."""
    inside = F.startswith("source_path", F.lit(root.rstrip("/") + "/"))
    have = folders_with_audio(backed_up).select(F.col("dir").alias("_dir"))
    relative = F.when(inside, F.substr("source_path", F.lit(len(root.rstrip("/")) + 2)))
    met = albums.withColumn("_relative", relative).join(have, F.col("_relative") == F.col("_dir"), "left")
    return met.select("id", F.when(F.col("_relative").isNull(), "outside").when(F.col("_dir").isNotNull(), "there").otherwise("copy").alias("decision"))


def key_values(lines: DataFrame) -> DataFrame:
    """file, key, value of lines (file, line_no, line) KEY=value; the first of a key counts, the value keeps later signs."""
    rows = lines.where(F.col("line").rlike("^[^=]+=")).select("file", "line_no", F.regexp_extract("line", "^([^=]+)=", 1).alias("key"), F.regexp_extract("line", "^[^=]+=(.*)$", 1).alias("value"))
    return rows.groupBy("file", "key").agg(F.min_by("value", "line_no").alias("value"))


def peak_cache(lines: DataFrame) -> DataFrame:
    """path, mtime, size, peak of well-formed tab-separated lines; of equal path, mtime and size the last line counts."""
    part = lambda k: F.split_part("line", F.lit("\t"), F.lit(k))
    good = (F.size(F.split("line", "\t")) == 4) & (part(1) != "") & part(2).rlike("^[0-9]+$") & part(3).rlike("^[0-9]+$") & part(4).rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    rows = lines.where(good).select(part(1).alias("path"), part(2).cast("long").alias("mtime"), part(3).cast("long").alias("size"), part(4).cast("double").alias("peak"), "line_no")
    return rows.groupBy("path", "mtime", "size").agg(F.max_by("peak", "line_no").alias("peak"))


def manifest_entries(payloads: DataFrame) -> DataFrame:
    """name, path, kind of the entries of JSON manifests (column json): a list, or an object with a list entries."""
    entry = "struct<path:string,kind:string>"
    plain = F.from_json("json", f"array<{entry}>")
    inside = F.from_json("json", f"struct<entries:array<{entry}>>")["entries"]
    is_list = F.startswith(F.ltrim("json"), F.lit("["))
    return payloads.select("name", F.explode(F.when(is_list, plain).otherwise(inside)).alias("e")).where("e.path is not null").select("name", "e.*")


def song_files(songs: DataFrame, files: DataFrame) -> DataFrame:
    """song_id, path for songs (song_id, dir, title): the file of that name in any case, else of the name after its index."""
    stem = F.lower(F.regexp_replace(name(F.col("path")), r"\.[^.]*$", ""))
    have = files.select(folder(F.col("path")).alias("_dir"), "path", stem.alias("_stem"), F.regexp_replace(stem, r"^[0-9]+[ ._-]+", "").alias("_bare"))
    title = F.lower(text.trimmed(F.col("title")))
    either = have.select("_dir", "path", F.lit(0).alias("_rank"), F.col("_stem").alias("_name")).union(have.where("_bare <> _stem").select("_dir", "path", F.lit(1), "_bare"))
    met = songs.join(either, (F.col("dir") == F.col("_dir")) & (title == F.col("_name")))
    return met.groupBy("song_id").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))


def row_json(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON, without its null fields."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def cells(df: DataFrame, width: int) -> DataFrame:
    """line (tab-separated) as `width` cells: short lines are padded, what is over joins the last cell."""
    parts = F.split("line", "\t")
    last = F.array_join(F.slice(parts, width, F.greatest(F.size(parts) - width + 1, F.lit(1))), " ")
    return df.select("*", *(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")).alias(f"c{k}") for k in range(1, width)), F.when(F.size(parts) >= width, last).otherwise("").alias(f"c{width}"))
