"""Keys, years, marks and schedules out of text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from needledrop.functions.text import trimmed


def album_key(tags: Column, path: Column) -> Column:
    """A struct of artist, year (four digits, 0000 if unknown), album and genre of a file; null without an artist or an album.

    tags: a map of lower-case names (album_artist, artist, album, date, genre), null for none. The album's artist goes before
    the track's; then Various Artists in a folder _VA, then the folder above the album's. The year is the first four digits
    in the date, else in the album's folder; the album's folder without a leading year stands for a missing album.
    """
    tag = lambda k: F.nullif(F.try_element_at(tags, F.lit(k)), F.lit(""))
    parts = F.split(path, "/")
    folder, above = (F.nullif(F.try_element_at(parts, F.lit(i)), F.lit("")) for i in (-2, -3))
    four = lambda x: F.nullif(F.regexp_extract(x, "([0-9]{4})", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(folder, r"^\s*[0-9]{4}\s*-\s*(.+)$", 1), F.lit(""))
    artist = F.coalesce(tag("album_artist"), tag("artist"), F.when(above == "_VA", "Various Artists"), above)
    album = F.coalesce(tag("album"), bare, folder)
    key = F.struct(artist.alias("artist"), F.coalesce(four(tag("date")), four(folder), F.lit("0000")).alias("year"), album.alias("album"), tag("genre").alias("genre"))
    return F.when(artist.isNotNull() & album.isNotNull(), key)


def safe_component(name: Column) -> Column:
    """A name as one part of a path: on one line, _ for slashes, no white space at the ends; unknown for nothing."""
    x = trimmed(F.translate(F.coalesce(name, F.lit("")), "\n\r/", "  _"))
    return F.when(x == "", "unknown").otherwise(x)


def library_path(artist: Column, year: Column, album: Column) -> Column:
    """index/artist/year - album; the index is the artist's first sign in upper case, _ unless a letter A to Z or a digit."""
    a = safe_component(artist)
    first = F.translate(F.left(a, F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    dated = F.when(year.cast("string").rlike("^[0-9]{4}$") & (year.try_cast("int") > 0), F.concat(year.cast("string"), F.lit(" - "))).otherwise("")
    return F.concat_ws("/", F.when(first.rlike("^[A-Z0-9]$"), first).otherwise("_"), a, F.concat(dated, safe_component(album)))


def library_path_for(source: Column, root: str, artist: Column, year: Column, album: Column) -> Column:
    """Where an album goes: the same place below the target as its source has below root, else library_path."""
    inside = F.when(source.startswith(root.rstrip("/") + "/"), F.nullif(F.substr(source, F.lit(len(root.rstrip("/")) + 2)), F.lit("")))
    return F.coalesce(inside, library_path(artist, year, album))


def index_seconds(mark: Column) -> Column:
    """Seconds of MM:SS:FF with 75 frames a second; null if it isn't such a mark."""
    part = lambda i: F.regexp_extract(mark, r"^([0-9]+):([0-5][0-9]):([0-7][0-9])$", i).try_cast("int")
    return F.round(part(1) * 60 + part(2) + part(3) / 75, 6)


def clipped(text: Column, most: int) -> Column:
    """At most `most` characters; what is cut ends in three dots."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("..."))).otherwise(text)


def unsorted_name(name: Column) -> Column:
    """Last, First as First Last; without white space at the ends."""
    x = trimmed(name)
    part = lambda i: trimmed(F.regexp_extract(x, r"^([^,]+)\s*,\s*([^,].+)$", i))
    return F.when(x.rlike(r"^[^,]+\s*,\s*[^,].+$"), F.concat(part(2), F.lit(" "), part(1))).otherwise(x)


def plain_lyrics(text: Column) -> Column:
    """Without marks in brackets and empty lines."""
    return F.array_join(F.filter(F.split(F.regexp_replace(text, r"\[[^\]]*\]", ""), "\n"), lambda line: F.trim(line) != ""), "\n")


def selected(grammar: str, n: int) -> list[int]:
    """Rows of a page named by 2,4,7-9 (either way round), a or all; each once, within 1 to n, in the order named."""
    out: dict[int, None] = {}
    for part in grammar.replace(" ", "").lower().split(","):
        if part in ("a", "all"):
            out.update(dict.fromkeys(range(1, n + 1)))
            continue
        first, dash, last = part.partition("-")
        if not first.isdigit() or (dash and not last.isdigit()):
            continue
        a, b = int(first), int(last or first)
        step = 1 if a <= b else -1
        out.update(dict.fromkeys(i for i in range(a, b + step, step) if 1 <= i <= n))
    return [*out]


def cron(minutes: Column) -> Column:
    """A cron schedule for an interval in minutes: within the hour, hourly, every so many hours, daily; null for any other."""
    text = minutes.cast("string")
    return (
        F.when((minutes >= 1) & (minutes < 60), F.concat(F.lit("*/"), text, F.lit(" * * * *")))
        .when(minutes == 60, "0 * * * *")
        .when(minutes == 1440, "0 0 * * *")
        .when((minutes > 60) & (minutes < 1440) & (minutes % 60 == 0), F.concat(F.lit("0 */"), F.floor(minutes / 60).cast("string"), F.lit(" * * *")))
    )


def longest_run(minutes: Column, given: Column) -> Column:
    """Seconds that a run may take: as given, else two minutes less than the interval (all of it up to two minutes), 0 without one."""
    seconds = minutes.cast("long") * 60
    return F.when(given >= 1, given.cast("long")).when(F.coalesce(minutes, F.lit(0)) < 1, F.lit(0).cast("long")).when(seconds > 120, seconds - 120).otherwise(seconds)


def next_run(schedule: Column, now: Column) -> Column:
    """HH:MM of a schedule's next run after `now` (minutes of the day); null for schedules that cron() doesn't give."""
    part = lambda pattern: F.regexp_extract(schedule, pattern, 1).try_cast("int")
    hour, minute = F.floor(now / 60).cast("int"), (now % 60).cast("int")
    by_minute, by_hour = part(r"^\*/([0-9]+) \* \* \* \*$"), part(r"^0 \*/([0-9]+) \* \* \*$")
    later = (F.floor(minute / by_minute) + 1) * by_minute
    clock = lambda h, m: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
    then = (F.floor(hour / by_hour) + 1) * by_hour
    return (
        F.when(by_minute.between(1, 59), F.when(later >= 60, clock((hour + 1) % 24, F.lit(0))).otherwise(clock(hour, later)))
        .when(schedule == "0 * * * *", clock((hour + 1) % 24, F.lit(0)))
        .when(by_hour.between(1, 23), clock(F.when(then < 24, then).otherwise(0), F.lit(0)))
        .when(schedule == "0 0 * * *", "00:00")
    )


def next_even_run(now: Column, minutes: Column) -> Column:
    """HH:MM of the next multiple of an interval from `now` on (seconds since 1970, in UTC); other than 1 to 720 minutes count as 20."""
    step = F.coalesce(F.when(minutes.between(1, 720), minutes), F.lit(20)).cast("long") * 60
    return F.date_format(F.timestamp_seconds(F.ceil(now / step).cast("long") * step), "HH:mm")


def path_candidates(raw: Column) -> Column:
    """The paths that a path out of a shell may mean, in the order in which they are tried: as it is, with quotes unescaped, with a quote for a last backslash."""
    quoted = F.when(raw.endswith("\\"), F.concat(F.left(raw, F.length(raw) - 1), F.lit("'")))
    return F.array_distinct(F.array_compact(F.array(raw, F.replace(raw, F.lit("\\'"), F.lit("'")), quoted)))


def album_identity(tags: Column, folder: Column) -> Column:
    """A struct of artist, album and year that artwork of an album folder is looked for by.

    tags: a map of the first track's names (album_artist, artist, album), null for none. The folder's name gives the year (YYYY - name) and what
    tags leave out; the folder above it an artist, turned round if it is sorted by surname.
    """
    tag = lambda k: F.nullif(trimmed(F.try_element_at(tags, F.lit(k))), F.lit(""))
    parts = F.split(F.rtrim(folder, F.lit("/")), "/")
    name, above = F.element_at(parts, -1), F.nullif(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    dated = r"^([12][0-9]{3})\s*-\s*(.+)$"
    year, rest = F.regexp_extract(name, dated, 1), F.nullif(trimmed(F.regexp_extract(name, dated, 2)), F.lit(""))
    artist = F.coalesce(tag("album_artist"), tag("artist"), unsorted_name(F.nullif(trimmed(F.when(above != ".", above)), F.lit(""))), F.lit(""))
    return F.struct(artist.alias("artist"), F.coalesce(tag("album"), F.when(year != "", F.coalesce(rest, F.lit(""))), trimmed(name)).alias("album"), year.alias("year"))
