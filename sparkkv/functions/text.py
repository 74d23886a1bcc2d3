"""String, URL, hash and character functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that URL encoding leaves alone, besides letters, digits and ``-_.`` (fixed values).
URL_SAFE = "$+!'(),:@&=/~*"


def trim(s: Column, chars: str | None = None) -> Column:
    """Cut spaces, and ``chars`` if given, from both ends."""
    return F.btrim(s, F.lit(" " + chars)) if chars else F.trim(s)


def ltrim(s: Column, chars: str | None = None) -> Column:
    return F.ltrim(s, F.lit(" " + chars)) if chars else F.ltrim(s)


def rtrim(s: Column, chars: str | None = None) -> Column:
    return F.rtrim(s, F.lit(" " + chars)) if chars else F.rtrim(s)


def pairs(s: Column, separator: str, equals: str = "=") -> Column:
    """array<struct<key, value>> of ``key=value`` parts in order; parts without ``equals`` are dropped, repeated keys and empty ones stay."""
    at = lambda p: F.instr(p, equals)
    parts = F.filter(F.split(s, "\\Q" + separator + "\\E"), lambda p: at(p) > 0)
    return F.transform(parts, lambda p: F.struct(F.substr(p, F.lit(1), at(p) - 1).alias("key"), F.substr(p, at(p) + len(equals)).alias("value")))


def replace_all(s: Column, old: str, new: str, most: int | None = None) -> Column:
    """Replace every occurrence; cut to ``most`` characters if given."""
    out = F.replace(s, F.lit(old), F.lit(new))
    return F.substring(out, 1, most) if most is not None else out


def unhex(s: Column) -> Column:
    """Bytes of a hexadecimal string; null for an odd length or other characters."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def url_encode(s: Column) -> Column:
    """Percent-encode all but letters, digits, ``-_.`` and URL_SAFE; a space becomes ``%20``."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for c in URL_SAFE:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def url_decode(s: Column) -> Column:
    """Percent-decode; a plus stays a plus, and a damaged escape gives null."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def query_arguments(url: Column) -> Column:
    """array<struct<key, value, lower_key>> of a URL's query: decoded, keys trimmed and once more in lower case."""
    query = F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"\?([^#]*)", 1))
    return F.transform(pairs(query, "&"), lambda p: F.struct(F.trim(url_decode(p["key"])).alias("key"), url_decode(p["value"]).alias("value"), F.lower(F.trim(url_decode(p["key"]))).alias("lower_key")))


#: Java's POSIX classes (ASCII), by name.
CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "xdigit": r"\p{XDigit}",
}


def of_class(s: Column, name: str) -> Column:
    """Whether ``s`` isn't empty and all its characters are of the class."""
    return s.rlike(rf"\A{CLASSES[name]}+\z")  # a line break at the end counts


def base_name(path: Column) -> Column:
    """What follows the last slash, a trailing one not counted."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
