"""Normalisers of names, profiles and codecs, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codec names that lose information; names that begin with adpcm_ do as well.
LOSSY = (
    "mp2", "mp3", "aac", "vorbis", "opus", "ac3", "eac3", "dca", "dts", "wma", "wmav1", "wmav2", "wmavoice", "amr_nb", "amr_wb", "gsm", "g722",
    "g723_1", "g726", "g729", "qcelp", "cook", "ra_144", "ra_288", "atrac1", "atrac3", "atrac3al", "atrac3p", "speex", "nellymoser", "qdm2", "alaw", "mulaw",
)
DASHES = "-‐‑‒–—―"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once for a row: written plainly, x would be worked out at every place where f has it."""
    return F.transform(F.array(x), f)[0]


def trimmed(x: Column) -> Column:
    """Without white space of any kind at the ends (trim() alone takes spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def norm(x: Column) -> Column:
    return F.lower(trimmed(x))


def compact(x: Column) -> Column:
    """Lower case without spaces and dashes."""
    return F.translate(F.lower(x), " " + DASHES, "")


@cache
def _marked_letters() -> tuple[str, str]:
    """Lower-case letters of the Latin, Greek and Cyrillic blocks that are a letter with marks, and these letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x530), *range(0x1E00, 0x2000))) if c == c.lower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def unmarked_text(x: str) -> str:
    return x.lower().translate(str.maketrans(*_marked_letters()))


def unmarked(x: Column) -> Column:
    """Lower case, letters without their marks."""
    return F.translate(F.regexp_replace(F.lower(x), r"\p{Mn}+", ""), *_marked_letters())


def is_lossy(codec: Column) -> Column:
    return codec.isin(*LOSSY) | codec.startswith("adpcm_")


def squeezed(raw: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(raw), r"\s+", "")


def rate_hz(raw: Column) -> Column:
    """Hz from 44.1, 44100, 44k, 44.1khz or 44100hz (half to even); null if it is none of these or not above zero."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)(khz|hz|k)?$"
    parts = lambda x: F.struct(F.regexp_extract(x, pattern, 1).try_cast("double").alias("number"), F.regexp_extract(x, pattern, 2).alias("unit"))

    def hz(p: Column) -> Column:
        number, unit = p["number"], p["unit"]
        return F.bround(F.when(unit.isin("k", "khz"), number * 1000).when(unit == "hz", number).when(number < 1000, number * 1000).otherwise(number)).cast("int")

    return once(once(once(squeezed(raw), parts), hz), lambda whole: F.when(whole > 0, whole))


def depth(raw: Column) -> Column:
    """16, 24, 32f ... from 24bit, 24b, f32, dblp; null if it is none of these, of more than three digits or zero."""

    def name(x: Column) -> Column:
        names = F.when(x.isin("32f", "f32", "flt", "fltp", "float32"), "32f").when(x.isin("64f", "f64", "dbl", "dblp", "double", "float64"), "64f")
        number = F.regexp_extract(x, r"^([0-9]{1,3})(?:bits?|b)?$", 1).try_cast("int")
        return names.otherwise(once(number, lambda n: F.when(n > 0, n.cast("string"))))

    return once(squeezed(raw), name)


def canonical_profile(raw: Column) -> Column:
    """RATE/DEPTH of a profile in any spelling, its parts split by / : - _ or packed (4410016); null if it is no profile."""
    split, packed = r"^([^/:-]+)[/:-]([^/:-]+)$", r"^([0-9]+(?:\.[0-9]+)?(?:khz|k)?)([0-9]{2,3}f?)$"

    def canonical(x: Column) -> Column:
        part = lambda n: F.when(x.rlike(split), F.regexp_extract(x, split, n)).otherwise(F.regexp_extract(x, packed, n))
        return F.concat(rate_hz(part(1)).cast("string"), F.lit("/"), depth(part(2)))  # null if one of them is

    return once(F.translate(squeezed(raw), "_", "/"), canonical)


def profile_in(text: Column) -> Column:
    """The first profile that a text names (Recode to 44.1k/16), canonical; null if none."""
    return canonical_profile(F.regexp_extract(text, r"(?i)([0-9]+(?:[.][0-9]+)?(?:k(?:hz)?)?[/:-][0-9]{1,3}f?)", 1))


def replacement_profile(p: Column) -> Column:
    """What a canonical profile is replaced by: its rate with 16 bits, 24 for 24 and more and for floats; null stays null."""
    bits = F.split_part(p, F.lit("/"), F.lit(2))
    deep = bits.isin("32f", "64f") | F.coalesce(bits.try_cast("int") >= 24, F.lit(False))
    return F.concat(F.split_part(p, F.lit("/"), F.lit(1)), F.when(deep, "/24").otherwise("/16"))


def recode_target(recode: Column, codec: Column, current: Column, source: Column, replace: Column) -> Column:
    """The profile that an album is to be made: the one that its recode text names; for a surround codec that is to be replaced
    that of its first source, else its present one, as a replacement (current, source: canonical profiles). Null if there is none.
    """
    surround = (F.coalesce(replace, F.lit(0)) == 1) & norm(F.coalesce(codec, F.lit(""))).isin("dts", "dca")
    return F.coalesce(profile_in(recode), F.when(surround, F.coalesce(replacement_profile(source), replacement_profile(current))))


def is_number(x: Column) -> Column:
    """Whether a text is a plain number: digits with an optional minus and decimals."""
    return F.coalesce(x.rlike(r"^-?[0-9]+([.][0-9]+)?$"), F.lit(False))


def profile_key(raw: Column) -> Column:
    """A number to sort profiles by: depth first (float as ten times its bits), then rate."""
    rate, bits = F.split_part(raw, F.lit("/"), F.lit(1)), F.lower(F.split_part(raw, F.lit("/"), F.lit(2)))
    there = F.instr(raw, "/") > 0
    rate = F.when(there, F.regexp_extract(rate, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))
    number = F.when(bits == "64f", 640).when(bits == "32f", 320).otherwise(F.regexp_extract(bits, r"^([0-9]{2,})", 1).try_cast("int") * 10)
    return F.coalesce(F.when(there, number), F.lit(0)) * 1000.0 + F.coalesce(rate, F.lit(0.0))


#: Names of one codec, and names that say nothing.
SAME_CODEC = {"mpegaudio": "mp3", "mpeg_audio": "mp3", "mpeg_layer_3": "mp3", "mpeg1layer3": "mp3", "libvorbis": "vorbis", "wmav1": "wma", "wmav2": "wma", "wmavoice": "wma"}
NO_CODEC = ("", "n/a", "none", "unknown")


def codec_name(codec: Column) -> Column:
    """Other names of a codec as one, empty for names that say nothing; the rest in lower case."""
    x = norm(F.coalesce(codec, F.lit("")))
    known = F.create_map(*(F.lit(v) for pair in SAME_CODEC.items() for v in pair))
    return F.when(x.isin(*NO_CODEC), "").otherwise(F.coalesce(known[x], x))


def plain_word(x: Column) -> Column:
    """Lower case, white space and other signs as single low lines."""
    return F.regexp_replace(F.regexp_replace(norm(F.coalesce(x, F.lit(""))), "[^a-z0-9._+-]", "_"), "_+", "_")
