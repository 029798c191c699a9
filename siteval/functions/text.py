"""Functions of names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteval.constants import DENY_SUBSTRINGS


def stem(path: Column) -> Column:
    """Base name without its last extension (a leading dot is not an extension)."""
    base = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def digits(name: Column) -> Column:
    """All digits of a name, in order."""
    return F.regexp_replace(name, r"[^0-9]", "")


def encounter_id(name: Column) -> Column:
    """Legal id of a file name: sanitised stem, cut at 40, plus 8 hex digits of its SHA-1."""
    clean = F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")
    clean = F.regexp_replace(clean, r"^[-._]+|[-._]+$", "")
    clean = F.when(clean == "", F.lit("img")).otherwise(clean)
    return F.concat(F.substring(clean, 1, 40), F.lit("-"), F.substring(F.sha1(name), 1, 8))


# One well-formed UTF-8 character, or a single stray byte, over bytes read as Latin-1.
_UTF8_TOKEN = ("([\\x00-\\x7f]|[\\xc2-\\xdf][\\x80-\\xbf]|\\xe0[\\xa0-\\xbf][\\x80-\\xbf]"
               "|[\\xe1-\\xec\\xee\\xef][\\x80-\\xbf]{2}|\\xed[\\x80-\\x9f][\\x80-\\xbf]"
               "|\\xf0[\\x90-\\xbf][\\x80-\\xbf]{2}|[\\xf1-\\xf3][\\x80-\\xbf]{3}|\\xf4[\\x80-\\x8f][\\x80-\\xbf]{2}"
               "|[\\x80-\\xff])")


def output_id(raw: Column) -> Column:
    """Text of a name given as bytes; each byte that is not part of valid UTF-8 becomes a backslash escape."""
    tokens = F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(_UTF8_TOKEN))

    def written(t):
        stray = (F.length(t) == 1) & (t >= "\x80")
        return F.when(stray, F.concat(F.lit("\\x"), F.lower(F.hex(F.encode(t, "ISO-8859-1"))))).otherwise(
            F.decode(F.encode(t, "ISO-8859-1"), "UTF-8"))

    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.array_join(F.transform(tokens, written), ""))


def name_group(name: Column) -> Column:
    """Group of a file name: its stem up to the last underscore."""
    return F.regexp_replace(stem(name), r"_[^_]*$", "")


def policy_denied(components: Column) -> Column:
    """True when any component name contains a denied substring."""
    names = F.lower(F.array_join(components, " "))
    denied = F.lit(False)
    for d in DENY_SUBSTRINGS:
        denied = denied | names.contains(d)
    return denied
