"""Canonical forms of texts: what is left when case, spacing, punctuation and field order are ignored."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"


def letters_and_digits(text: Column) -> Column:
    """Lower-cased letters, digits and combining marks of a text, all else left out.

    Final sigma is folded to sigma, since lower-casing picks one or the other by what follows.
    """
    return F.translate(F.regexp_replace(F.lower(text), NOT_WORD, ""), "ς", "σ")


def field_list(content: Column) -> Column:
    """The fields of a content in any notation as a sorted array of distinct ``name=value``.

    Notations: a JSON object, or ``name: value`` and ``name = value`` parts between line
    breaks, semicolons or bars. Names and values are reduced by :func:`letters_and_digits`.
    A part without separator is a name without value; parts without a letter or digit are
    left out.
    """
    parsed = F.from_json(content, "map<string,string>")
    pairs = F.transform(F.map_entries(parsed), lambda e: F.concat(letters_and_digits(e["key"]), F.lit("="), letters_and_digits(F.coalesce(e["value"], F.lit("")))))
    part = lambda p: F.concat(
        letters_and_digits(F.regexp_extract(p, r"^([^:=]*)", 1)), F.lit("="), letters_and_digits(F.regexp_extract(p, r"^[^:=]*[:=]([\s\S]*)$", 1))
    )
    split = F.transform(F.split(content, r"[\n\r;|]+"), part)
    json = F.ltrim(F.regexp_replace(content, r"^\s+", "")).startswith("{") & parsed.isNotNull()
    return F.array_sort(F.array_distinct(F.filter(F.when(json, pairs).otherwise(split), lambda x: x != "=")))


def canonical_text(content: Column, form: Column) -> Column:
    """The canonical form of a content: its fields if ``form`` is ``fields``, else its letters and digits.

    Null where the content is null or has no letter or digit.
    """
    text = F.when(form == "fields", F.array_join(field_list(content), ";")).otherwise(letters_and_digits(content))
    return F.when(content.rlike(r"[\p{L}\p{N}]"), text)


def canonical_key(content: Column, form: Column, *scope: Column) -> Column:
    """SHA-256 of the canonical form within a scope (such as a table's name), as 32 bytes; null as above."""
    return F.unhex(F.sha2(F.concat_ws("\x00", *scope, form, canonical_text(content, form)), 256))
