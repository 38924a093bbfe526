"""Text cleaning. Whitespace is the Unicode set, not Java's ASCII-only ``\\s``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns shared with the SQL checks.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TRIM = rf"\A{SPACE}+|{SPACE}+\z"
START_MARKER = r"(?iu)@startuml[^\n]*\n?"
END_MARKER = r"(?iu)@enduml[^\n]*"
THINK_BLOCK = r"(?s)<think>.*?</think>"


def trim_space(text: Column) -> Column:
    """Trim all Unicode whitespace at both ends; ``trim`` removes blanks only."""
    return F.regexp_replace(text, TRIM, "")


def squeeze_space(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def words(text: Column) -> Column:
    """Tokens of a text whose only whitespace is blanks; the empty text has none."""
    return F.array_remove(F.split(text, " "), "")


def normalise_code(code: Column) -> Column:
    """Drop the start and end markers with the rest of their lines, lower-case, squeeze."""
    code = F.coalesce(code, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(code, START_MARKER, ""), END_MARKER, "")
    # Most texts have no marker, which a search for its first character tells sooner.
    return squeeze_space(F.lower(F.when(F.contains(code, F.lit("@")), bare).otherwise(code)))


# The body between the markers is compared in the same normal form.
extract_uml_body = normalise_code


def strip_think(text: Column) -> Column:
    """Remove closed reasoning blocks, then trim."""
    return trim_space(F.regexp_replace(text, THINK_BLOCK, ""))
