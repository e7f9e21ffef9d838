"""Small string expressions shared by the scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space in texts, not only the ASCII ones.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = f"[{WHITESPACE}]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a costly value that it reads several times, computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def packed(c: Column) -> Column:
    """A text as bytes to be sent: lower-case hex digits by half their length, others as UTF-8.

    The first byte says which of the two, so equal bytes are equal texts; their order is another.
    """
    raw = F.unhex(c)
    utf8 = F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8"))
    return F.when(F.lower(F.hex(raw)) == c, F.concat(F.unhex(F.lit("01")), raw)).otherwise(utf8)


def unpacked(c: Column) -> Column:
    """The text that ``packed`` made bytes of."""
    digits = F.lower(F.hex(c))
    body = F.substring(digits, 3, 2**31 - 1)
    return F.when(digits.startswith("01"), body).otherwise(F.decode(F.unhex(body), "UTF-8"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def null_to_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_line(c: Column) -> Column:
    return strip(F.substring_index(null_to_blank(c), "\n", 1))


def filled(c: Column) -> Column:
    """True when the text is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def clean_description(summary: Column, details: Column, limit: int = 300) -> Column:
    """One-line description: the summary, or else the first sentence of the details."""
    text = F.coalesce(
        F.nullif(summary, F.lit("")),
        F.substring_index(null_to_blank(details), ".", 1),
    )
    one_line = strip(F.regexp_replace(text, BLANKS, " "))
    return F.substring(one_line, 1, limit)


def shorten(c: Column, limit: int = 240) -> Column:
    """One line of at most ``limit`` characters, ended by an ellipsis if cut."""
    one_line = strip(F.regexp_replace(null_to_blank(c), BLANKS, " "))
    cut = F.concat(F.rtrim(F.substring(one_line, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(one_line) > limit, cut).otherwise(one_line)
