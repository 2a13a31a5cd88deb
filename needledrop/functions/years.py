"""The year of a release, out of the tags of a file and the name of its folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of the first release, in the order in which they are believed.
ORIGINAL = (
    "original_year_release", "original_release_year", "originalyear_release", "originalyear", "original_year", "originalreleaseyear",
    "original_release_date", "originaldate", "original_date", "tdor", "tory", "original_release",
)
#: Tags of any release.
GENERIC = ("release_year", "releaseyear", "release_date", "releasedate", "date", "year")
YEAR = "([12][0-9]{3})"


def tag_years(lines: Column) -> Column:
    """key, year, at of each of a file's tag lines (TAG:key=value) whose value holds a year: keys in lower case, other signs as single low lines."""
    key = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(x, r"^(?:TAG:)?(?:tag:)?([^=]*)=", 1)), "[^a-z0-9]+", "_"), "^_|_$", "")
    year = lambda x: F.regexp_extract(x, "=.*?" + YEAR, 1)
    rows = F.transform(lines, lambda x, i: F.struct(key(x).alias("key"), year(x).alias("year"), i.alias("at")))
    return F.filter(rows, lambda r: (r["key"] != "") & (r["year"] != ""))


def original_year(lines: Column) -> Column:
    """The year in the most believed tag of the first release, else in another tag named original and year or date (the first
    of them by name); of several lines of a key the last counts. Null if there is none.
    """
    place = lambda k: F.array_position(F.array(*map(F.lit, ORIGINAL)), k)
    other = lambda k: k.contains("original") & (k.contains("year") | k.contains("date"))
    rank = lambda k: F.when(place(k) > 0, place(k)).when(other(k), len(ORIGINAL) + 1)
    ranked = F.transform(tag_years(lines), lambda r: F.struct(rank(r["key"]).alias("rank"), r["key"].alias("key"), (-r["at"]).alias("last"), r["year"].alias("year")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["year"]


def folder_year(path: Column) -> Column:
    """The year that a folder's name begins with (before a space, a point, a dash or a low line, in brackets, or alone)."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.coalesce(*(F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (rf"^{YEAR}[\s_.-]", rf"^\[{YEAR}\]", f"^{YEAR}$")))


def generic_year(lines: Column) -> Column:
    """The year in the first line of a tag of any release; null if there is none."""
    return F.get(F.filter(tag_years(lines), lambda r: r["key"].isin(*GENERIC)), F.lit(0))["year"]


def release_year(lines: Column, path: Column, known: Column) -> Column:
    """The year of a release: of the first one by its tags, of its folder, of any release by its tags, else the known one
    (0 unless it is of four digits from 1000 to 2999). lines: tag lines, null for none.
    """
    fallback = F.when(known.between(1000, 2999), known.cast("int")).otherwise(0)
    return F.coalesce(F.coalesce(original_year(lines), folder_year(path), generic_year(lines)).cast("int"), fallback)
