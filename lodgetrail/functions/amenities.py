"""Amenity categories named in free text, and the chips shown on cards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, let


def _java_pattern(pattern: str) -> str:
    """Unicode word edges and blanks for a pattern whose \\b sits at an end.

    The text is lower-cased, so the pattern's letters are too, but not those
    that stand for a class (``\\S`` is not ``\\s``): matching Unicode text
    without case costs several times as much. The left edge of a plain word is
    tested after the word, so most places fail on their first letter.
    """
    pattern = re.sub(r"\\.|[A-Z]+", lambda m: m[0] if m[0].startswith("\\") else m[0].lower(), pattern)
    left, right = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    body = pattern[2 if left else 0:-2 if right else None]
    end = NOT_BEFORE_WORD if right else ""
    blanks = body.replace(r"[\s-]", r"[\s\p{Z}-]").replace(r"\s*", r"[\s\p{Z}]*")
    if left and re.fullmatch("[a-z]+", body):
        return f"{body}{end}(?<![\\p{{L}}\\p{{N}}_]{body})"
    return f"{NOT_AFTER_WORD if left else ''}(?:{blanks}){end}"


def _any_of(text: Column, patterns) -> Column:
    """One search per pattern: alternatives in one pattern are tried at every place."""
    return reduce(lambda a, b: a | b, [text.rlike(_java_pattern(p)) for p in patterns])


def derive_amenities(text: Column, patterns=None) -> Column:
    """Categories with a positive and no negative mention, in table order."""
    table = dims.AMENITY_PATTERNS if patterns is None else patterns

    def found(low: Column) -> Column:
        names = []
        for name, (positives, negatives) in table.items():
            hit = _any_of(low, positives)
            if negatives:
                hit = hit & ~_any_of(low, negatives)
            names.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*names))

    nothing = F.array().cast("array<string>")
    return F.coalesce(let(F.lower(text), found), nothing)


def chips(amenities: Column, order=dims.AMENITY_ORDER, without=("Air Conditioner",)) -> Column:
    """Known categories the listing has, in icon order."""
    known = dims.literal_array([n for n in order if n not in without])
    return F.array_intersect(known, F.coalesce(amenities, F.array().cast("array<string>")))


def shown(items: Column, limit: int) -> Column:
    return F.slice(items, 1, limit)


def hidden_count(items: Column, limit: int) -> Column:
    return F.greatest(F.size(items) - limit, F.lit(0)).cast("bigint")
