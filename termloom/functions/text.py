"""Unicode-aware text expressions. All of them are Column built-ins, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes spelled out, because \w, \d, \s and \b are ASCII-only in java.util.regex.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE_SET = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE = f"[{SPACE_SET}]"
DIGIT = r"\p{Nd}"
EDGE_SPACE = f"^{SPACE}+|{SPACE}+$"
SPECIAL = rf"[^\p{{L}}\p{{N}}_{SPACE_SET}]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, EDGE_SPACE, "")


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, f"{SPACE}+", " ")


def canonical(
    col: Column,
    case_sensitive: bool = False,
    normalize_whitespace: bool = True,
    strip_special: bool = False,
) -> Column:
    """Comparison key of a keyword."""
    key = strip(col)
    if not case_sensitive:
        key = F.lower(key)
    if normalize_whitespace:
        key = collapse_spaces(key)
    if strip_special:
        key = F.regexp_replace(key, SPECIAL, "")
    return key


def words(col: Column) -> Column:
    """Whitespace-separated words without empty pieces."""
    return F.filter(F.split(col, f"{SPACE}+"), lambda w: w != "")


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def capitalize_words(word_array: Column, limit: int) -> Column:
    return F.array_join(F.transform(F.slice(word_array, 1, limit), capitalize), " ")


def boundary_pattern(pattern: str) -> str:
    r"""Rewrite the \b, \s and \d shorthands of an existence pattern into the explicit classes above.

    A leading or trailing \b becomes a consumed non-word character, which is the same test when only
    the existence of a match matters, and needs no look-around.
    """
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{NOT_WORD})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:{NOT_WORD}|$)"
    return pattern.replace(r"\s", SPACE).replace(r"\d", DIGIT)


def folded(col: Column) -> Column:
    """Lower case, with the letters that match s and i regardless of case folded onto them."""
    return F.lower(F.translate(col, "\u017f\u0131\u0130", "sii"))


def required_text(pattern: str) -> str:
    """Longest literal every match of a shorthand pattern contains; empty if there is none."""
    literals = re.sub(r"\\\?", "\0", pattern.lower())
    literals = re.sub(r"\\[a-z.]|\[[^\]]*\]|\{\d+\}|[\^$+*?]", " ", literals)
    return max(literals.replace("\0", "?").split(), key=len, default="")


def matches(text: Column, pattern: str) -> Column:
    """Existence of a shorthand pattern in `folded` text. A literal search spares most rows the regex."""
    found = text.rlike(boundary_pattern(pattern.lower()))
    needed = required_text(pattern)
    return text.contains(needed) & found if needed else found


def strict_json(col: Column) -> Column:
    """Text as a VARIANT, NULL unless it is exactly one JSON value (the parser alone ignores trailing text)."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), col, F.lit("]")))
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return F.when(second.isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))
