"""Range texts compiled once into disjoint intervals on a version axis.

Some rules treat kinds of versions unlike: an upper bound leaves out its own pre-releases, a
lower one its own post-releases, an npm range takes pre-releases only of the versions it names.
So the axis has *lanes*, and inside a lane every range is a short list of (lower, upper) ends as
in ``versions``: a version is in the range exactly if its place lies between the ends of one of
them. Joins can then sort or tile intervals instead of evaluating a range per version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.functions import ranges as R
from siftmark.functions import versions as V
from siftmark.functions.text import strip

INTERVALS = "array<struct<lane:string,lower:string,upper:string>>"


def disjoint(intervals: Column) -> Column:
    """The same set of places as sorted intervals, of which none meets another in its lane."""
    return F.call_function("aggregate", F.array_sort(intervals), F.array().cast(INTERVALS), F.expr(
        """(kept, i) -> case
          when i.lower >= i.upper then kept
          when size(kept) > 0 and element_at(kept, -1).lane = i.lane and i.lower <= element_at(kept, -1).upper
          then concat(slice(kept, 1, size(kept) - 1), array(named_struct('lane', i.lane,
            'lower', element_at(kept, -1).lower, 'upper', greatest(element_at(kept, -1).upper, i.upper))))
          else concat(kept, array(i)) end"""))


# --- specifier sets ---------------------------------------------------------------

#: Whether a version is a pre-release, a post-release and a local one.
LANES = [f"{pre}{post}{local}" for pre in "01" for post in "01" for local in "01"]


def specifier_lane(key: Column) -> Column:
    """The lane of a version, by its ``version_key``."""
    part = lambda i: F.split_part(key, F.lit("!"), F.lit(i))
    flag = lambda c: F.when(c, "1").otherwise("0")
    return F.concat(flag((part(3) != "9") | (part(5) != "9")), flag(part(4) != "0"), flag(part(6) != ""))


_BASE = "concat(substring_index(b.key, '!', 2), '!')"
# Ends of one specifier in a lane. A public version is followed by its local ones, up to "~".
_PLACES = f"""case
  when b.op = '===' then array(named_struct('lower', '{V.LOWEST}', 'upper', '{V.HIGHEST}'))
  when b.op = '==' then array(named_struct('lower', b.first, 'upper', b.past))
  when b.op = '!=' then array(named_struct('lower', '{V.LOWEST}', 'upper', b.first),
    named_struct('lower', b.past, 'upper', '{V.HIGHEST}'))
  when b.op = '~=' then array(named_struct('lower', concat(b.key, '!0'), 'upper', b.past))
  when b.op = '>=' then array(named_struct('lower', concat(b.key, '!0'), 'upper', '{V.HIGHEST}'))
  when b.op = '<=' then array(named_struct('lower', '{V.LOWEST}', 'upper', concat(b.key, '~')))
  when b.op = '<' then array(named_struct('lower', '{V.LOWEST}', 'upper',
    case when lane like '1__' and b.lane like '0__' then {_BASE} else concat(b.key, '!0') end))
  else array(named_struct('lower', case when lane like '__1' or (lane like '_1_' and b.lane like '_0_')
    then concat({_BASE}, '~') else concat(b.key, '!2') end, 'upper', '{V.HIGHEST}')) end"""
_BOTH = f"""filter(flatten(transform(held, x -> transform({_PLACES}, y -> named_struct(
  'lower', greatest(x.lower, y.lower), 'upper', least(x.upper, y.upper))))), z -> z.lower < z.upper)"""
_ALL_LANES = f"""bs -> flatten(transform(array({", ".join(repr(x) for x in LANES)}), lane -> transform(
  aggregate(bs, array(named_struct('lower', '{V.LOWEST}', 'upper', '{V.HIGHEST}')), (held, b) -> {_BOTH}),
  x -> named_struct('lane', lane, 'lower', x.lower, 'upper', x.upper))))"""
# Whether the bound may stand behind its operator, as in ``ranges.in_specifier_set``.
_ALLOWED = """b -> coalesce(case when b.op = '===' then true
  when b.op in ('==', '!=') and b.bound like '%.*' then b.stem_key is not null
  when b.op in ('==', '!=') then b.key is not null
  when b.bound like '%+%' or b.key is null then false
  when b.op = '~=' then b.stem_key is not null
  else b.op <> '' end, false)"""
_ENDS = """b -> named_struct('op', b.op, 'bound', b.bound, 'key', b.key, 'lane', b.lane,
  'first', case when b.bound like '%.*' then concat(substring_index(b.stem_key, '!', 2), '!') else concat(b.key, '!0') end,
  'past', case when b.op = '~=' or b.bound like '%.*' then concat(substring_index(b.stem_key, '!', 1), '!', b.stem_release, '/')
    when b.bound like '%+%' then concat(b.key, '!2') else concat(b.key, '~') end)"""
# The release numbers of a stem, zeros at the end included; "/" behind them is past all longer ones.
_RELEASE = f"s -> array_join(transform(split(regexp_replace(s, '^v?([^!]*!)?', ''), '[.]'), n -> {V.num_sql('n')}), '.')"


def specifier_set(spec: Column) -> Column:
    """``(intervals, texts)`` of a PEP 440 specifier set; null if it is malformed.

    ``texts`` are the bounds of arbitrary equality (``===``), which compare texts: a version must
    equal all of them besides. Every version that can be read is in exactly one lane.
    """

    def read(p: Column) -> Column:
        bound = F.lower(F.regexp_extract(p, R.SPECIFIER, 2))
        stem = F.when(
            bound.rlike(R.WILDCARD) | ~bound.endswith(".*"),
            F.nullif(F.regexp_extract(bound, R._RELEASE_HEAD, 1), F.lit("")),
        )
        return F.struct(F.regexp_extract(p, R.SPECIFIER, 1).alias("op"), bound.alias("bound"), stem.alias("stem"))

    def keyed(b: Column) -> Column:
        key = V.version_key(b["bound"])
        return F.struct(
            b["op"].alias("op"), b["bound"].alias("bound"), key.alias("key"), specifier_lane(key).alias("lane"),
            V.version_key(b["stem"]).alias("stem_key"), R._bind_sql(b["stem"], _RELEASE).alias("stem_release"),
        )

    parts = F.filter(F.split(spec, ","), lambda p: strip(p) != "")
    bounds = F.transform(F.transform(parts, read), keyed)

    def compiled(bs: Column) -> Column:
        ends = F.call_function("transform", bs, F.expr(_ENDS))
        return F.when(
            F.call_function("forall", bs, F.expr(_ALLOWED)),
            F.struct(
                R._bind_sql(ends, _ALL_LANES).alias("intervals"),
                F.transform(F.filter(bs, lambda b: b["op"] == "==="), lambda b: b["bound"]).alias("texts"),
            ),
        )

    return F.get(F.transform(F.array(bounds), compiled), F.lit(0))


def in_specifier_intervals(version: Column, compiled: Column) -> Column:
    """Whether a version lies in a ``specifier_set``; null if either is malformed."""

    def verdict(key: Column) -> Column:
        lane, place = specifier_lane(key), V.point(key)
        inside = F.exists(
            compiled["intervals"], lambda i: (i["lane"] == lane) & (i["lower"] < place) & (place < i["upper"])
        )
        return F.when(
            key.isNotNull() & compiled.isNotNull(),
            inside & F.forall(compiled["texts"], lambda t: t == F.lower(F.trim(version))),
        )

    return F.get(F.transform(F.array(V.version_key(version)), verdict), F.lit(0))


# --- semantic versions ------------------------------------------------------------

#: Lanes of all versions, and of those that are no pre-releases; others are named by their core.
EVERY, RELEASES = "*", "~"


def semver_lanes(key: Column) -> Column:
    """The lanes of a version, by its ``semver_key``: that of all and its own."""
    return F.array(F.lit(EVERY), F.when(key.endswith("!~"), RELEASES).otherwise(F.substring_index(key, "!", 3)))


def npm_set(groups: Column) -> Column:
    """Disjoint intervals of an npm range, by ``ranges.npm_range``.

    A pre-release only lies in alternatives that name a pre-release of the same three numbers.
    """

    def alternative(g: Column) -> Column:
        lower = F.array_max(F.transform(g, lambda c: c["lower"]))
        upper = F.array_min(F.transform(g, lambda c: c["upper"]))
        cores = F.array_compact(F.transform(g, lambda c: c["core"]))
        lanes = F.array_distinct(F.concat(F.array(F.lit(RELEASES)), cores))
        known = F.forall(g, lambda c: c["lower"].isNotNull() & c["upper"].isNotNull())
        made = F.transform(lanes, lambda lane: F.struct(lane.alias("lane"), lower.alias("lower"), upper.alias("upper")))
        return F.when(known, made).otherwise(F.array().cast(INTERVALS))

    return disjoint(F.flatten(F.transform(groups, alternative)))
