"""Presentation text. Comparisons and joins use the numeric columns, never these."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A word is letters, digits and underscores, and an apostrophe or
# point stays inside it only between two letters or two digits.
_WORD = r"(?:[\p{L}\p{N}_]|(?<=\p{L})['’.](?=\p{L})|(?<=\p{N})['’.](?=\p{N}))+"
_WORD_OR_GAP = rf"({_WORD}|(?:(?!{_WORD}).)+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(col: Column | str) -> Column:
    """First character of every word upper, the rest lower; also after a hyphen.

    ``initcap`` only looks at spaces.
    """
    pieces = F.regexp_extract_all(_col(col), F.lit(f"(?s){_WORD_OR_GAP}"), F.lit(1))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    return F.array_join(F.transform(pieces, capital), "")


def fixed_point(col: Column | str) -> Column:
    """Text with one decimal, rounded the way C's ``printf("%.1f")`` does.

    C rounds the exact binary value, with ties to even; Java rounds the shortest
    decimal text half up. Only values whose text ends in 5 at the second place
    differ. ``20 * x`` is an odd whole number exactly there, and the low part of
    ``16x + 4x`` tells on which side of the tie the binary value lies.
    """
    x = F.abs(_col(col).cast("double"))
    high, low = x * 16, x * 4
    twentieths = high + low
    error = low - (twentieths - high)
    steps = F.floor(twentieths / 2)
    at_tie = (twentieths == F.floor(twentieths)) & (twentieths % 2 == 1)
    up = (error > 0) | ((error == 0) & (steps % 2 == 1))
    rounded = F.when(at_tie, (steps + up.cast("long")) / F.lit(10.0)).otherwise(F.round(x, 1))
    sign = F.when(_col(col) < 0, F.lit("-")).otherwise(F.lit(""))
    # format_string would print a missing number as text
    return F.when(_col(col).isNotNull(), F.concat(sign, F.format_string("%.1f", rounded)))


def median_iqr_text(q25: Column | str, median: Column | str, q75: Column | str) -> Column:
    """``median (q25–q75)`` with one decimal; NULL when there was no value."""
    low, mid, high = fixed_point(q25), fixed_point(median), fixed_point(q75)
    return F.concat(mid, F.lit(" ("), low, F.lit("–"), high, F.lit(")"))


def count_percent(n: Column | str, pct: Column | str) -> Column:
    """``n (p%)``."""
    return F.concat(_col(n).cast("string"), F.lit(" ("), fixed_point(pct), F.lit("%)"))
