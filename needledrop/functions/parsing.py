"""Tables out of lines of text: sheets of marks, range reports; and names that nearly match."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.functions import grading
from needledrop.functions.paths import index_seconds
from needledrop.functions.text import once, trimmed
from needledrop.operators.partitions import parts


def sheet_tracks(lines: DataFrame) -> DataFrame:
    """sheet, file, track, title, performer, start of the marks in lines (sheet, line_no, text).

    A line belongs to the last FILE and TRACK line before it: two running values over the lines of a sheet.
    """
    pattern = r'^\s*(FILE|TRACK|TITLE|PERFORMER|INDEX 01)\s+"?([^"]*?)"?(?:\s+(?:AUDIO|WAVE|MP3|FLAC))?\s*$'
    word, value = F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2)
    rows = lines.select("sheet", "line_no", word.alias("word"), value.alias("value")).where("word <> ''")
    so_far = Window.partitionBy("sheet").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda w: F.last(F.when(F.col("word") == w, F.col("value")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"file": last("FILE"), "track": last("TRACK").try_cast("int")})
    one = lambda w: F.max(F.when(F.col("word") == w, F.col("value")))
    out = rows.where("track is not null and word <> 'FILE'").groupBy("sheet", "file", "track").agg(one("TITLE").alias("title"), one("PERFORMER").alias("performer"), one("INDEX 01").alias("mark"))
    return out.select("sheet", "file", "track", "title", "performer", index_seconds(F.col("mark")).alias("start"))


def _first_match(text: Column, patterns: Sequence[tuple[str, int, int]]) -> Column:
    """number and name that the first matching pattern has in its groups (pattern, group of the number, group of the name; 0: none)."""
    of = lambda p, n, k: F.struct(F.regexp_extract(text, p, n).try_cast("double").alias("number"), (F.regexp_extract(text, p, k) if k else F.lit("")).alias("name"))
    return F.coalesce(*(F.when(text.rlike(p), of(p, n, k)) for p, n, k in patterns))


#: The lines of range reports. A track: number and name of it; a total; a property.
NUMBER = r"(\d+(?:\.\d+)?)"
TRACK_LINES = (
    (rf"^\s*(\d+\.\s*.+?):\s*DR\s*{NUMBER}\s*$", 2, 1),
    (rf"^\s*DR{NUMBER}\s+[-+]?\d+(?:\.\d+)?\s+dB\s+[-+]?\d+(?:\.\d+)?\s+dB\s+(.+?)\s*$", 1, 2),
    (rf"^\s*DR{NUMBER}\s+\S+\s+\S+\s+(.+?)\s*$", 1, 2),
)
TOTAL_LINES = ((rf"(?i)^\s*DR\s*=\s*{NUMBER}\s*$", 1, 0), (rf"(?i)Official DR value:\s*DR{NUMBER}", 1, 0), (rf"(?i)Total DR:\s*DR?{NUMBER}", 1, 0), (rf"(?i)Album DR:\s*DR?{NUMBER}", 1, 0))
PROPERTIES = {"rate": r"(?i)Sampling rate:\s*(\d+)\s*Hz", "kbps": r"(?i)Average bitrate:\s*(\d+)\s*kbs", "bits": r"(?i)Bits per sample:\s*(\d+)\s*bit"}


def song_name(raw: Column) -> Column:
    """A track's name in a report without folders, time before and format after it, with single spaces."""
    x = F.element_at(F.split(trimmed(raw), "/"), -1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d+:\d{2}(?::\d{2})?\s+", ""), r"\s+\[[^\]]+\]$", ""), r"\s+", " ")


def report_tracks(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """report, name, dr for each track of a range report (report, line_no, text); of several lines of a name the last counts.

    files: report, file of the album's files. A name that is a file's in any case, as it is or without a number before it,
    becomes the file's.
    """
    # Each line's match is worked out once, as a row of its own: a filter on it would be put before it and repeat it.
    match = F.explode_outer(F.transform(F.array("text"), lambda t: _first_match(t, TRACK_LINES))).alias("match")
    rows = lines.select("report", "line_no", match).where("match.number is not null")
    rows = rows.select("report", "line_no", F.col("match.number").alias("dr"), song_name(F.col("match.name")).alias("name"))
    if files is not None:
        f = files.groupBy(F.col("report").alias("_r"), F.lower("file").alias("_key")).agg(F.max("file").alias("_file"))
        for key in (F.lower("name"), F.lower(trimmed(F.regexp_replace("name", r"^\d+\.\s*", "")))):
            rows = rows.withColumn("_wanted", key).join(f, (F.col("report") == F.col("_r")) & (F.col("_wanted") == F.col("_key")), "left")
            rows = rows.select("report", "line_no", "dr", F.coalesce("_file", "name").alias("name"))
    return rows.groupBy("report", "name").agg(F.max_by("dr", "line_no").alias("dr"))


def report_totals(lines: DataFrame) -> DataFrame:
    """report, total, rate, kbps, bits of each report: the last line of each kind; reports without a total can't be read."""
    total = once(F.col("text"), lambda t: _first_match(t, TOTAL_LINES))
    values = {"total": total["number"]} | {name: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).try_cast("int") for name, p in PROPERTIES.items()}
    rows = lines.select("report", "line_no", *(v.alias(k) for k, v in values.items()))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return rows.groupBy("report").agg(*map(last, values)).where("total is not null")


def newest_reports(files: DataFrame) -> DataFrame:
    """dir, path of the range report that was written last in each folder (files: dir, path, mtime; names like dr14*.txt), the first by name of equals."""
    name = F.element_at(F.split("path", "/"), -1)
    reports = files.where(name.rlike(r"^dr14.*\.txt$"))
    return reports.groupBy("dir").agg(F.min_by("path", F.struct(-F.col("mtime"), F.col("path"))).alias("path"))


_EXTENSION, _TIME, _NUMBER = re.compile(r"\s+\[\w+\]$"), re.compile(r"^\d+:\d+\s+"), re.compile(r"^\d+\s*[._-]\s*")


def plain_aliases(raw: str | None) -> list[str]:
    """The forms of a track's name, each once: as it is, without extension, without a number or time before it and [ext] after
    it, without both; each as it is and then without marks. Compatible letters and cases are one.
    """
    raw = (raw or "").rsplit("/", 1)[-1]
    ascii_only = raw.isascii()  # such names have neither marks nor compatible letters
    name = " ".join((raw if ascii_only else unicodedata.normalize("NFKC", raw)).casefold().split())
    bare = _NUMBER.sub("", _EXTENSION.sub("", _TIME.sub("", name))).strip()
    forms = (name, name.rsplit(".", 1)[0].strip(), bare, bare.rsplit(".", 1)[0].strip())
    if not ascii_only:
        forms = tuple(x for f in forms for x in (f, "".join(c for c in unicodedata.normalize("NFKD", f) if unicodedata.category(c) != "Mn")))
    return [x for x in dict.fromkeys(forms) if x]


@F.arrow_udf(T.ArrayType(T.StringType()))
def aliases(names: pa.Array) -> pa.Array:
    """plain_aliases() of each name: Unicode forms have no function in SQL."""
    return pa.array(map(plain_aliases, names.to_pylist()), pa.list_(pa.string()))


def plain(raw: str | None) -> str:
    letters = unicodedata.normalize("NFKD", (raw or "").casefold())
    return " ".join(re.sub("[^a-z0-9]+", " ", "".join(c for c in letters if not unicodedata.combining(c))).split())


@F.pandas_udf(T.StringType())
def plain_words(names: pd.Series) -> pd.Series:
    """Names as words of a to z and 0 to 9 with single spaces: cases, marks and compatible letters are one, other signs part words."""
    return names.map(plain)


def with_aliases(rows: DataFrame) -> DataFrame:
    """rows with forms, the plain_aliases() of name: as SQL for names of ASCII alone, else those in odd_forms (see odd_aliases)."""
    name = F.regexp_replace(F.lower(F.substring_index(F.coalesce("name", F.lit("")), "/", -1)), r"[\t-\r\x1c-\x1f ]+", " ")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("_name", _TIME.pattern, ""), _EXTENSION.pattern, ""), _NUMBER.pattern, "")
    stem = lambda c: F.trim(F.regexp_replace(c, r"\.[^.]*$", ""))
    rows = rows.withColumn("_name", F.trim(name)).withColumn("_bare", F.trim(bare))
    forms = F.array_remove(F.array_distinct(F.array("_name", stem("_name"), "_bare", stem("_bare"))), "")
    return rows.withColumn("forms", F.coalesce("odd_forms", forms)).drop("_name", "_bare", "odd_forms")


def odd_aliases(name: Column) -> Column:
    """The plain_aliases() of a name with other letters than ASCII; null for all others, whose forms SQL makes."""
    odd = F.octet_length(name) != F.char_length(name)
    return F.when(odd, aliases(F.when(odd, name)))


def _matched(wanted: DataFrame, known: DataFrame, keep: Sequence[str], carry: Sequence[str], how: str) -> DataFrame:
    """wanted_id, the columns keep of wanted, known_id, by and the columns carry of known for each wanted name (see match_names);
    with how "left" null where no name is found. An id names one row.

    Names are dealt by group once, before their forms are made, and meet there: no form is shuffled, and each is made once.
    Within a group each form of a wanted name is held against each known form.
    """
    w = wanted.select("wanted_id", F.col("group").alias("g"), *keep, "name", odd_aliases(F.col("name")).alias("odd_forms"))
    k = known.select("known_id", F.col("group").alias("h"), *carry, "name", odd_aliases(F.col("name")).alias("odd_forms"))
    n = max(parts(w), parts(k))
    # Outer, as Spark would otherwise look for empty arrays first, and for that make all forms once more before the shuffle.
    w = with_aliases(w.repartition(n, "g")).select("wanted_id", "g", *keep, F.posexplode_outer("forms").alias("turn", "alias"))
    k = with_aliases(k.repartition(n, "h")).select("known_id", "h", *carry, F.posexplode_outer("forms").alias("at", "form"))
    # Plain columns, not structures, wherever they do: such aggregates go by hash, without a sort of all forms.
    k = k.groupBy("h", "form").agg(F.max("known_id").alias("known_id"), F.min("known_id").alias("first"), F.min_by("at", "known_id").alias("at"), *(F.max_by(c, "known_id").alias(c) for c in carry))
    pairs = w.join(k, (F.col("g") == F.col("h")) & (F.contains("alias", "form") | F.contains("form", "alias")), how)
    place = F.when(F.col("form").isNotNull(), F.struct(F.col("alias") != F.col("form"), "turn", "first", "at"))  # null: not matched
    best = pairs.groupBy("g", "wanted_id", *keep).agg(F.min_by(F.struct("known_id", (F.col("alias") == F.col("form")).alias("same"), *carry), place).alias("best"))
    by = F.when(F.col("best.same"), "alias").when(~F.col("best.same"), "part")
    return best.select("wanted_id", *keep, "best.known_id", by.alias("by"), *(F.col(f"best.{c}") for c in carry))


def match_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted_id, known_id, by: for each wanted name of a group the known name with the same form (by alias), else one of which
    a form holds one of its forms or lies in it (by part).

    wanted: wanted_id, group, name; known: known_id, group, name. A wanted name's forms are tried in their order, and against
    each the known forms in theirs (by known_id, then form); of several known names with the same form the last one counts.
    Names are only held against those of their group.
    """
    return _matched(wanted, known, [], [], "inner")


def graded_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted_id, dr, grade as shown (N/A without a match): the dynamic range of the matched name (see match_names) and its
    grade under the genre profile of the wanted one. wanted has profile, known has dr as text; text that is no number is no name.
    """
    numbers = known.withColumn("_dr", F.col("dr").try_cast("double")).where("_dr is not null")
    dr = F.col("_dr")
    shown = F.when(dr == F.floor(dr), dr.cast("long").cast("string")).otherwise(dr.cast("string"))
    rows = _matched(wanted, numbers, ["profile"], ["_dr"], "left")
    return rows.select("wanted_id", F.coalesce(shown, F.lit("N/A")).alias("dr"), F.coalesce(grading.grade(dr, F.col("profile")), F.lit("N/A")).alias("grade"))
