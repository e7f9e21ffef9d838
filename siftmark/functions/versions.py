"""PEP 440 versions as one sortable text column.

``version_key`` maps a version to a string whose plain byte order is the version
order, and which is equal exactly for equal versions (``1.0`` and ``1.0.0``).
A string key can be compared, hashed, joined, range-partitioned and pruned by
Parquet statistics like any other column, and never leaves the JVM.

Layout: ``epoch ! release ! pre ! post ! dev ! local``. Numbers are padded to five
digits; a longer one is written as ``:``, its length and its digits, which sorts
after all padded ones, so byte order is numeric order for numbers of any size.
``!`` sorts before ``.``, and ``.`` before digits and letters, so a shorter release
or local label comes first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the version grammar of PEP 440, appendix B, on lower-cased text.
VERSION_PATTERN = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_FIELDS = "\x01" + "\x01".join(f"${i}" for i in range(1, 11)) + "\x01"


# The key is built from SQL text: one parsed expression instead of hundreds of calls.


def num_sql(digits: str) -> str:
    """A number so that text order is number order; an empty text counts as zero."""
    d = f"ltrim('0', {digits})"
    return (
        f"case when length({d}) <= 5 then lpad({d}, 5, '0') "
        f"else concat(':', lpad(cast(length({d}) as string), 3, '0'), {d}) end"
    )


def _num(digits: Column) -> Column:
    return F.get(F.call_function("transform", F.array(digits), F.expr(f"d -> {num_sql('d')}")), F.lit(0))


# Fields of VERSION_PATTERN by array position: 1 epoch, 2 release, 3 pre, 4 its number,
# 5 dash post number, 6 post, 7 its number, 8 dev, 9 its number, 10 local.
_HAS_POST = "(f[5] <> '' or f[6] <> '')"
_KEY_SECTIONS = [
    num_sql("f[1]"),
    "array_join(transform(split(regexp_replace(f[2], '([.]0+)+$', ''), '[.]'), "
    f"n -> {num_sql('n')}), '.')",
    "case when f[3] <> '' then concat(case when f[3] in ('a', 'alpha') then '1' "
    f"when f[3] in ('b', 'beta') then '2' else '3' end, {num_sql('f[4]')}) "
    f"when f[8] <> '' and not {_HAS_POST} then '0' else '9' end",
    f"case when {_HAS_POST} then concat('1', {num_sql('concat(f[5], f[7])')}) else '0' end",
    f"case when f[8] <> '' then concat('1', {num_sql('f[9]')}) else '9' end",
    "case when f[10] = '' then '' else array_join(transform(split(f[10], '[-_.]'), "
    f"p -> case when p rlike '^[0-9]+$' then concat('2', {num_sql('p')}) "
    "else concat('1', p) end), '.') end",
]
_ASSEMBLE = f"f -> case when size(f) = 12 then concat_ws('!', {', '.join(_KEY_SECTIONS)}) end"


def version_key(version: Column) -> Column:
    """Sortable key of a PEP 440 version; null when the text is not a version.

    One regular expression runs per value; wrapping its fields in a one-element array
    binds them once for the expressions that read them.
    """
    fields = F.split(F.regexp_replace(F.lower(version), VERSION_PATTERN, _FIELDS), "\x01")
    return F.get(F.call_function("transform", F.array(fields), F.expr(_ASSEMBLE)), F.lit(0))


def is_stable(version: Column) -> Column:
    """A parseable version that is neither a pre-release nor a development release."""
    return F.coalesce(version_key(version).rlike(r"^[^!]*![^!]*!9![^!]*!9!"), F.lit(False))


# Positions put versions and range ends on one axis: a version lies inside a
# range exactly when lower end < version < upper end, as plain text.

LOWEST = ""
HIGHEST = "~"


def point(key: Column) -> Column:
    return F.concat(key, F.lit("!1"))


def end_before(key: Column) -> Column:
    """The place just before a version: closed lower end, open upper end."""
    return F.concat(key, F.lit("!0"))


def end_after(key: Column) -> Column:
    """The place just after a version: open lower end, closed upper end."""
    return F.concat(key, F.lit("!2"))
