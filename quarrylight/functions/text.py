"""Text expressions that agree with Unicode rules in every engine."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Unicode white space as a Java character class; the ASCII \s of Java misses most of it.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
#: Classes that mean Unicode in Python patterns and ASCII in Java ones.
CLASSES = {r"\s": WHITE, r"\S": "[^" + WHITE[1:], r"\w": r"[\p{L}\p{N}_]", r"\W": r"[^\p{L}\p{N}_]", r"\d": r"\p{Nd}", r"\D": r"\P{Nd}"}


def java_pattern(pattern: str) -> str:
    """A Python pattern with its Unicode classes written for Java; classes within brackets included."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        pair = pattern[i : i + 2]
        if c == "\\" and len(pair) == 2:
            known = CLASSES.get(pair)
            if known and inside:
                known = known[1:-1] if known.startswith("[") and not known.startswith("[^") else known
            out.append(known or pair)
            i += 2
            continue
        inside = (c == "[" and not inside) or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def java_replacement(text: str) -> str:
    r"""A Python replacement for Java: ``\1`` and ``\g<1>`` are groups, a dollar sign is itself."""
    quoted = text.replace("$", r"\$")
    return re.sub(r"\\(?:g<(\d+)>|(\d+))", lambda m: "$" + (m[1] or m[2]), quoted)


def strip(text: Column) -> Column:
    """A text without Unicode white space at its ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def word_count(text: Column) -> Column:
    """The number of runs of letters, digits and underscores."""
    return F.regexp_count(text, F.lit(WORD))


def transform_text(text: Column, prefix: str = "", suffix: str = "", strip_ends: bool = True, lowercase: bool = False, replace: dict[str, str] | None = None) -> Column:
    """Replacements in order, then stripping, then lower-casing, then prefix and suffix as they are."""
    for pattern, to in (replace or {}).items():
        text = F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java_replacement(to)))
    if strip_ends:
        text = strip(text)
    if lowercase:
        text = F.lower(text)
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def words(text: Column) -> Column:
    """The lower-cased words of a text as an array; null gives the empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))
