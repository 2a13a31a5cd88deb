"""Grades of dynamic range, and genre profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least dynamic range of the grades S, A, B, C for each genre profile; below is F.
BOUNDS = {"audiophile": (14, 12, 9, 6), "high_energy": (11, 9, 7, 4), "standard": (12, 9, 7, 5)}
GRADES = ("S", "A", "B", "C")
#: Parts of genre names that count for a profile when tags vote.
AUDIOPHILE = (
    "classical", "classic", "orchestra", "symphony", "chamber", "opera", "baroque", "romantic", "choral", "choir", "jazz", "bebop", "swing", "bossa nova",
    "cool jazz", "modal jazz", "blues", "delta blues", "country blues", "folk", "acoustic", "singer-songwriter", "ambient", "new age", "meditation",
)
HIGH_ENERGY = (
    "rock", "hard rock", "classic rock", "alternative rock", "indie rock", "metal", "heavy metal", "death metal", "black metal", "thrash", "doom", "punk",
    "hardcore", "post-punk", "electronic", "electro", "synth", "synthpop", "edm", "house", "techno", "trance", "drum and bass", "dnb", "dubstep",
    "breakbeat", "industrial", "hip hop", "hip-hop", "rap", "trap", "grime", "grunge", "noise", "experimental",
)
#: Parts of names in an embedded tag, where high energy wins over audiophile within a segment.
TAG_HIGH = (
    "metal", "punk", "hardcore", "grunge", "noise", "rock", "alternative", "indie", "electronic", "electro", "synth", "edm", "house", "techno", "trance",
    "dubstep", "industrial", "drum and bass", "dnb", "hip hop", "hip-hop", "rap", "trap", "grime",
)
TAG_AUDIOPHILE = (
    "classical", "classic", "orchestra", "symphony", "chamber", "opera", "baroque", "romantic", "choral", "choir", "jazz", "bebop", "swing", "bossa", "blues",
    "folk", "acoustic", "new age", "meditation",
)


def grade(dr: Column, profile: Column) -> Column:
    """The grade of a dynamic range, cut to a whole number toward zero; an unknown profile is standard; null stays null."""
    whole = dr.cast("int")

    def within(bounds: tuple[int, ...]) -> Column:
        out = F.lit("F")
        for least, name in reversed([*zip(bounds, GRADES, strict=True)]):
            out = F.when(whole >= least, name).otherwise(out)
        return out

    chosen = within(BOUNDS["standard"])
    for name in ("audiophile", "high_energy"):
        chosen = F.when(profile == name, within(BOUNDS[name])).otherwise(chosen)
    return F.when(dr.isNotNull(), chosen)


def grade_rank(name: Column) -> Column:
    """S 5 down to F 1; anything else 6."""
    x = F.upper(F.coalesce(name, F.lit("")))
    return F.when(x == "S", 5).when(x == "A", 4).when(x == "B", 3).when(x == "C", 2).when(x == "F", 1).otherwise(6)


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))


def tag_profile(tag: Column) -> Column:
    """The profile of an embedded tag: of its segments between semicolons the most energetic one decides."""
    ranks = F.transform(F.split(F.lower(tag), ";"), lambda s: F.when(_any(s, TAG_HIGH), 2).when(_any(s, TAG_AUDIOPHILE), 1).otherwise(0))
    names = F.array(F.lit("standard"), F.lit("audiophile"), F.lit("high_energy"))
    return F.element_at(names, F.coalesce(F.array_max(ranks), F.lit(0)) + 1)


def voted_profile(tags: Column) -> Column:
    """The profile that most tags of an array speak for; audiophile wins ties; none: standard."""
    count = lambda words: F.size(F.filter(tags, lambda t: _any(F.lower(t), words)))
    calm, loud = count(AUDIOPHILE), count(HIGH_ENERGY)
    return F.when((calm == 0) & (loud == 0), "standard").when(calm >= loud, "audiophile").otherwise("high_energy")
