"""Version ranges in their several dialects, as column expressions.

A conjunction of plain bounds is one interval, so it is kept as a pair of
positions on the axis of ``versions.point``; a containment test is then two text
comparisons, and containment joins can sort instead of pairing everything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.functions import versions as V
from siftmark.functions.text import BLANKS, null_to_blank, strip


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inside(position: Column, lower: Column, upper: Column) -> Column:
    return F.coalesce((lower < position) & (position < upper), F.lit(False))


# --- bare bounds: the dialect of the matching join --------------------------------

BOUND = r"^(<=|<|>=|>|==)(?s:(.*))$"


def bare_range(expr: Column) -> Column:
    """``(lower, upper)`` of a comma list of ``< <= > >= ==`` bounds.

    Every bound must hold. A part without a known operator is ignored, so a range
    made only of such parts holds every version. A bound that is no version makes
    the range hold nothing (null).
    """
    bounds = F.filter(
        F.transform(
            F.split(expr, ","),
            lambda p: F.struct(
                F.regexp_extract(strip(p), BOUND, 1).alias("op"),
                V.version_key(F.regexp_extract(strip(p), BOUND, 2)).alias("key"),
            ),
        ),
        lambda b: b["op"] != "",
    )
    return F.get(F.call_function("transform", F.array(bounds), F.expr(_INTERVAL)), F.lit(0))


# Greatest lower and least upper end of a list of (op, key), with ends placed as by
# ``versions.end_before`` and ``end_after``.
_INTERVAL = f"""bs -> case when not exists(bs, b -> b.key is null) then named_struct(
  'lower', coalesce(array_max(transform(bs, b -> case when b.op in ('>=', '==')
      then concat(b.key, '!0') when b.op = '>' then concat(b.key, '!2') end)), '{V.LOWEST}'),
  'upper', coalesce(array_min(transform(bs, b -> case when b.op in ('<=', '==')
      then concat(b.key, '!2') when b.op = '<' then concat(b.key, '!0') end)), '{V.HIGHEST}')) end"""


def in_bare_range(version: Column, expr: Column) -> Column:
    """True when the version lies in the bare-bound range; false if either cannot be read."""
    position = V.point(V.version_key(version))
    return _bind(bare_range(expr), lambda r: _inside(position, r["lower"], r["upper"]))


# --- specifier sets ---------------------------------------------------------------

SPECIFIER = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(\S+)\s*$"
WILDCARD = r"^v?(?:\d+!)?\d+(?:\.\d+)*\.\*$"


def _bind_sql(value: Column, body: str) -> Column:
    """``_bind`` with the body as SQL text: one parsed expression, read once per row."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))


_PUBLIC = "concat(substring_index(b.vkey, '!', 5), '!')"
_SAME_BASE = "substring_index(b.vkey, '!', 2) = substring_index(b.key, '!', 2)"
_PRE = "(split_part({k}, '!', 3) <> '9' or split_part({k}, '!', 5) <> '9')"
_POST = "split_part({k}, '!', 4) <> '0'"
# Whether the version starts with the release numbers of the stem.
_PREFIX = """(split_part(b.vkey, '!', 1) = split_part(b.stem_key, '!', 1)
  and regexp_replace(array_join(slice(split(split_part(b.vkey, '!', 2), '[.]'), 1,
      size(split(regexp_replace(b.stem, '^[^!]*!', ''), '[.]'))), '.'), '([.]00000)+$', '')
    = split_part(b.stem_key, '!', 2))"""
# One specifier of PEP 440; null when the bound is not allowed for the operator.
_TEST = f"""b -> case
  when b.op = '===' then lower(trim(b.text)) = b.bound
  when b.op in ('==', '!=') then (b.op = '==') = (case when b.bound like '%.*' then {_PREFIX}
    when b.bound like '%+%' then b.vkey = b.key else {_PUBLIC} = b.key end)
  when b.bound like '%+%' or b.key is null then null
  when b.op = '~=' then case when b.stem <> '' then {_PUBLIC} >= b.key and {_PREFIX} end
  when b.op = '>=' then {_PUBLIC} >= b.key
  when b.op = '<=' then {_PUBLIC} <= b.key
  when b.op = '<' then b.vkey < b.key and not (
    {_PRE.format(k='b.vkey')} and not {_PRE.format(k='b.key')} and {_SAME_BASE})
  when b.op = '>' then b.vkey > b.key
    and not ({_POST.format(k='b.vkey')} and not {_POST.format(k='b.key')} and {_SAME_BASE})
    and not (split_part(b.vkey, '!', 6) <> '' and {_SAME_BASE}) end"""
_VERDICT = """t -> case when not exists(t.tests, x -> x is null) and t.key is not null
  then forall(t.tests, x -> x) end"""
_RELEASE_HEAD = r"^(v?(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*)\.(?:[0-9]+|\*$)"


def in_specifier_set(version: Column, spec: Column) -> Column:
    """True/false for a version and a PEP 440 specifier set; null if either is malformed.

    Pre-releases are allowed in, as in current releases of the packaging library.
    """

    def read(p: Column) -> Column:
        bound = F.lower(F.regexp_extract(p, SPECIFIER, 2))
        return F.struct(
            F.regexp_extract(p, SPECIFIER, 1).alias("op"),
            bound.alias("bound"),
            F.when(
                bound.rlike(WILDCARD) | ~bound.endswith(".*"), F.regexp_extract(bound, _RELEASE_HEAD, 1)
            ).alias("stem"),
        )

    def verdict(key: Column) -> Column:
        parts = F.filter(F.split(spec, ","), lambda p: strip(p) != "")
        bounds = F.transform(
            F.transform(parts, read),
            lambda b: F.struct(
                b["op"].alias("op"),
                b["bound"].alias("bound"),
                b["stem"].alias("stem"),
                V.version_key(b["bound"]).alias("key"),
                V.version_key(b["stem"]).alias("stem_key"),
                key.alias("vkey"),
                version.alias("text"),
            ),
        )
        tests = F.call_function("transform", bounds, F.expr(_TEST))
        return _bind_sql(F.struct(key.alias("key"), tests.alias("tests")), _VERDICT)

    return _bind(V.version_key(version), verdict)


# --- normalised specifiers --------------------------------------------------------

# Operators that the rewritten notation keeps; two-character ones are looked for first.
NORMAL_OPERATORS = ["<=", ">=", "==", "!=", "~=", "<", ">"]
NORMAL_PART = f"^({'|'.join(NORMAL_OPERATORS)})(.*)$"


def bare_token(c: Column) -> Column:
    """A version without blanks, leading ``v`` or ``+build``."""
    t = F.regexp_replace(null_to_blank(c), r"\s+", "")
    return F.substring_index(F.regexp_replace(t, "^[vV]", ""), "+", 1)


def _interval(s: Column) -> tuple[Column, Column, Column]:
    """Whether a text is an interval like ``[1,2)``, and the texts of its ends.

    Its first and last characters are brackets, and the first comma in between parts the ends;
    there is no closing bracket after it. An end without a version is open.
    """
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    left = F.substring_index(inner, ",", 1)
    right = F.substring(inner, F.length(left) + 2, F.length(inner))
    found = (
        F.left(s, F.lit(1)).isin("[", "(") & F.right(s, F.lit(1)).isin("]", ")")
        & inner.contains(",") & ~right.contains(")") & ~right.contains("]")
    )
    return found, left, right


def _bracketed(s: Column) -> tuple[Column, Column]:
    """Whether a text is an interval, and the specifier set it stands for."""
    found, left, right = _interval(s)
    low, high = bare_token(left), bare_token(right)
    ends = F.concat_ws(
        ",",
        F.when(low != "", F.concat(F.when(s.startswith("["), ">=").otherwise(">"), low)),
        F.when(high != "", F.concat(F.when(s.endswith("]"), "<=").otherwise("<"), high)),
    )
    return found, F.nullif(ends, F.lit(""))


def _hyphenated(s: Column) -> tuple[Column, Column]:
    """Whether a text is two versions around a hyphen, and the specifier set it stands for.

    The hyphen with blanks beside it parts them; in a text without blanks the last one does.
    """
    spaced = F.split(s, f"(?:{BLANKS}-{BLANKS[:-1]}*)|(?:-{BLANKS})")
    last = F.substring_index(s, "-", -1)
    parts = F.when(s.rlike(BLANKS), spaced).when(
        s.contains("-"), F.array(F.substring(s, F.lit(1), F.length(s) - F.length(last) - 1), last)
    )
    low, high = F.get(parts, 0), F.get(parts, 1)
    found = F.coalesce(
        (F.size(parts) == 2) & (low != "") & (high != "") & ~low.rlike(BLANKS) & ~high.rlike(BLANKS), F.lit(False)
    )
    low, high = bare_token(low), bare_token(high)
    return found, F.when((low != "") & (high != ""), F.concat(F.lit(">="), low, F.lit(",<="), high))


def _listed(s: Column) -> Column:
    """The set of comma-separated comparisons; null if one has no known operator or no version."""
    parts = F.filter(F.transform(F.split(s, ","), strip), lambda p: p != "")
    bare = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, NORMAL_PART, 1).alias("operator"),
            bare_token(F.regexp_extract(p, NORMAL_PART, 2)).alias("version"),
        ),
    )
    usable = (F.size(bare) > 0) & F.forall(bare, lambda x: x["version"] != "")
    return F.when(usable, F.array_join(F.transform(bare, lambda x: F.concat(x["operator"], x["version"])), ","))


def normalized_specifier(spec: Column) -> Column:
    """Rewrite bracket, hyphen and operator ranges to one specifier set; else null."""
    s = strip(null_to_blank(spec))
    is_interval, interval = _bracketed(s)
    is_pair, pair = _hyphenated(s)
    return F.when(is_interval, interval).when(is_pair, pair).when(s.rlike("[<>=~^]"), _listed(s))


def in_normalized_range(version: Column, spec: Column) -> Column:
    """True when the version satisfies the range in any of the rewritten notations."""
    return _bind(
        normalized_specifier(spec),
        lambda n: F.coalesce(in_specifier_set(bare_token(version), n), F.lit(False)),
    )


# --- three-valued semantic-version ranges -----------------------------------------

IN_RANGE, OUT_OF_RANGE, UNDECIDABLE = "IN_RANGE", "OUT_OF_RANGE", "UNDECIDABLE"

SEMVER_HEAD = r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?(?s:(.*))$"
NPM_BLOCK = (
    r"^v?(<=|<|>=|>|=|\^|~|)(x|X|\*|0|[1-9][0-9]*)(?:\.(x|X|\*|0|[1-9][0-9]*)"
    r"(?:\.(x|X|\*|0|[1-9][0-9]*))?)?(?:-([a-zA-Z0-9.-]*))?(?:\+([a-zA-Z0-9.-]*))?$"
)


def _pre_sql(pre: str) -> str:
    """Sortable pre-release; none at all sorts last."""
    return (
        f"case when {pre} = '' then '~' else array_join(transform(split({pre}, '[.]'), "
        f"i -> case when i rlike '^[0-9]+$' then concat('1', {V.num_sql('i')}) "
        "else concat('2', i) end), '!') end"
    )


def _semver_sql(major: str, minor: str, patch: str, pre: str = "") -> str:
    numbers = ", ".join(V.num_sql(n) for n in (major, minor, patch))
    return f"concat_ws('!', {numbers}, {_pre_sql(pre) if pre else chr(39) + '~' + chr(39)})"


def _captured(text: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern in one array, at positions 1 and up; null without a match."""
    marks = "\x01" + "\x01".join(f"${i}" for i in range(1, groups + 1)) + "\x01"
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, marks), "\x01"))


# What follows the third number is a pre-release unless it starts with + or a dot.
_TAIL = "regexp_replace(f[4], '[^a-zA-Z0-9+.-]', '-')"
_SEMVER = "f -> " + _semver_sql(
    "f[1]", "f[2]", "f[3]",
    f"(case when {_TAIL} rlike '^[+.]' then '' "
    f"else substring_index(regexp_replace({_TAIL}, '^-', ''), '+', 1) end)",
)


def semver_key(version: Column) -> Column:
    """Key of a version coerced to three numbers and a pre-release; null without a number.

    Missing numbers are zero and leading zeros fall away; other signs in a pre-release
    become ``-``.
    """
    fields = _captured(version, SEMVER_HEAD, 4)
    return F.when(fields.isNotNull(), _bind_sql(fields, _SEMVER))


def _core(key: Column) -> Column:
    return F.substring_index(key, "!", 3)


_WILD = "('', 'x', 'X', '*')"
# Numbers of a comparator with wild ones as zero, and which of them are wild.
_NUMBERS = f"""f -> named_struct('op', f[1], 'pre', f[5],
  'ma', if(f[2] in {_WILD}, '0', f[2]), 'mi', if(f[2] in {_WILD} or f[3] in {_WILD}, '0', f[3]),
  'pa', if(f[2] in {_WILD} or f[3] in {_WILD} or f[4] in {_WILD}, '0', f[4]),
  'no_ma', f[2] in {_WILD}, 'no_mi', f[2] in {_WILD} or f[3] in {_WILD},
  'no_pa', f[2] in {_WILD} or f[3] in {_WILD} or f[4] in {_WILD})"""


def _next(n: str) -> str:
    return f"cast(try_cast({n} as decimal(38, 0)) + 1 as string)"


# key: the version itself; past: the first version beyond all that a partial one stands
# for; caret: the first version beyond a caret range.
_KEYS = f"""c -> named_struct('c', c,
  'key', {_semver_sql('c.ma', 'c.mi', 'c.pa', "if(c.no_pa, '', c.pre)")},
  'past', if(c.no_mi, {_semver_sql(_next('c.ma'), "'0'", "'0'")},
    {_semver_sql('c.ma', _next('c.mi'), "'0'")}),
  'caret', case when c.ma <> '0' or c.no_mi then {_semver_sql(_next('c.ma'), "'0'", "'0'")}
    when c.mi <> '0' or c.no_pa then {_semver_sql("'0'", _next('c.mi'), "'0'")}
    else {_semver_sql("'0'", "'0'", _next('c.pa'))} end)"""
_ENDS = f"""k -> named_struct(
  'lower', case when k.c.op in ('<', '<=') then '{V.LOWEST}'
    when k.c.op = '>' and k.c.no_ma then '{V.HIGHEST}'
    when k.c.op = '>' and k.c.no_pa then concat(k.past, '!0')
    when k.c.op = '>' then concat(k.key, '!2') else concat(k.key, '!0') end,
  'upper', case when k.c.op = '<' and k.c.no_ma then '{V.LOWEST}'
    when k.c.op = '<' then concat(k.key, '!0')
    when k.c.op in ('>', '>=') or k.c.no_ma then '{V.HIGHEST}'
    when k.c.op = '^' then concat(k.caret, '!0')
    when k.c.op = '~' or k.c.no_pa then concat(k.past, '!0') else concat(k.key, '!2') end,
  'core', case when k.c.pre <> '' and not k.c.no_pa then substring_index(k.key, '!', 3) end)"""


def _comparator(block: Column) -> Column:
    """(lower, upper, core) of one npm comparator; ``core`` is set if it names a pre-release."""
    fields = _captured(block, NPM_BLOCK, 6)
    return F.when(
        fields.isNotNull(), _bind_sql(_bind_sql(_bind_sql(fields, _NUMBERS), _KEYS), _ENDS)
    )


def npm_range(expr: Column) -> Column:
    """Alternatives of comparators of an npm range; null when any block is malformed."""
    def group(text: Column) -> Column:
        t = strip(text)
        ends = F.split(t, " - ")
        hyphen = F.array(
            F.concat(F.lit(">="), F.get(ends, F.lit(0))),
            F.concat(F.lit("<="), F.get(ends, F.lit(1))),
        )
        blocks = (
            F.when(t == "", F.array(F.lit(">=0.0.0")))
            .when(F.size(ends) == 2, hyphen)
            .otherwise(F.split(t, " "))
        )
        return F.transform(blocks, _comparator)

    groups = F.transform(F.split(expr, r"\|\|"), group)
    broken = F.exists(groups, lambda g: F.exists(g, lambda c: c.isNull()))
    return F.when(~broken, groups)


def _npm_holds(key: Column, groups: Column) -> Column:
    position = V.point(key)
    pre = ~key.endswith("!~")
    return F.exists(
        groups,
        lambda g: F.forall(g, lambda c: _inside(position, c["lower"], c["upper"]))
        & (~pre | F.exists(g, lambda c: F.coalesce(c["core"] == _core(key), F.lit(False)))),
    )


def semver_range(expr: Column, join_spaced: bool = False) -> Column:
    """A range read once, for many versions: its text, bracket ends and npm comparators.

    An operator parted from its version by a blank (``>= 1.0``) is no npm comparator, so
    such a range cannot be decided outside PyPI; ``join_spaced`` reads it as one.
    """
    raw = strip(null_to_blank(expr))
    norm = strip(F.regexp_replace(F.replace(raw, F.lit(","), F.lit(" ")), r"\s+", " "))
    if join_spaced:
        norm = F.regexp_replace(norm, r"(<=|<|>=|>|=|\^|~) ", "$1")
    is_maven, left, right = _interval(raw)
    low, high = strip(left), strip(right)
    lkey, ukey = semver_key(low), semver_key(high)
    lower = F.when(low == "", F.lit(V.LOWEST)).otherwise(
        F.when(raw.startswith("["), V.end_before(lkey)).otherwise(V.end_after(lkey))
    )
    upper = F.when(high == "", F.lit(V.HIGHEST)).otherwise(
        F.when(raw.endswith("]"), V.end_after(ukey)).otherwise(V.end_before(ukey))
    )
    return F.struct(
        norm.alias("text"),
        is_maven.alias("is_maven"),
        F.when(is_maven, lower).alias("lower"),
        F.when(is_maven, upper).alias("upper"),
        F.when(~is_maven & (norm != ""), npm_range(norm)).alias("groups"),
    )


def semver_verdict(ecosystem: Column, version: Column, key: Column, rng: Column) -> Column:
    """IN_RANGE, OUT_OF_RANGE or UNDECIDABLE for a version, its ``semver_key`` and a range.

    Bracket ranges compare coerced semantic versions; anything else is an npm range, and
    what is none falls back to a specifier set for PyPI. A version below the lower end of
    a bracket range is out even if the upper end cannot be read.
    """
    out = lambda inside: F.when(inside, F.lit(IN_RANGE)).otherwise(F.lit(OUT_OF_RANGE))
    position = V.point(key)
    lower, upper = rng["lower"], rng["upper"]
    brackets = (
        F.when(lower.isNull(), F.lit(UNDECIDABLE))
        .when(position < lower, F.lit(OUT_OF_RANGE))
        .when(upper.isNull(), F.lit(UNDECIDABLE))
        .otherwise(out(position < upper))
    )
    spec = in_specifier_set(version, rng["text"])
    return (
        F.when((rng["text"] == "") | key.isNull(), F.lit(UNDECIDABLE))
        .when(rng["is_maven"], brackets)
        .when(rng["groups"].isNotNull(), out(_npm_holds(key, rng["groups"])))
        .when(F.lower(strip(ecosystem)) != "pypi", F.lit(UNDECIDABLE))
        .otherwise(F.when(spec.isNull(), F.lit(UNDECIDABLE)).otherwise(out(spec)))
    )


def semver_range_verdict(
    ecosystem: Column, version: Column, expr: Column, join_spaced: bool = False
) -> Column:
    """The verdict for one version and one range text."""
    both = F.struct(
        semver_key(version).alias("key"), semver_range(expr, join_spaced).alias("rng")
    )
    return _bind(both, lambda b: semver_verdict(ecosystem, version, b["key"], b["rng"]))


# --- event lists ------------------------------------------------------------------


def events_to_specifier(events: Column) -> Column:
    """Specifier set of an event list by the last event of each kind; null without bounds."""
    last = lambda name: F.element_at(
        F.concat(
            F.array(F.lit(None).cast("string")),
            F.filter(F.transform(events, lambda e: e[name]), lambda x: x.isNotNull()),
        ),
        -1,
    )
    start, fixed, last_bad = (
        F.nullif(last(name), F.lit("")) for name in ("introduced", "fixed", "last_affected")
    )
    return F.nullif(
        F.concat_ws(
            ",",
            F.when(start != "0", F.concat(F.lit(">="), start)),
            F.coalesce(
                F.concat(F.lit("<"), fixed),
                F.concat(F.lit("<="), last_bad),
            ),
        ),
        F.lit(""),
    )


def _events_hold(key: Column, events: Column) -> Column:
    """Walk ordered introduced/fixed events; an open tail is affected."""
    started = lambda intro: (intro == "0") | F.coalesce(
        V.version_key(intro) <= key, F.lit(False)
    )

    def step(state: Column, e: Column) -> Column:
        fix_key = V.version_key(e["fixed"])
        closes = e["introduced"].isNull() & e["fixed"].isNotNull()
        hit = closes & F.coalesce(started(state["start"]) & (fix_key > key), F.lit(False))
        return F.struct(
            F.when(closes, F.lit(None).cast("string"))
            .otherwise(F.coalesce(e["introduced"], state["start"]))
            .alias("start"),
            (state["hit"] | hit).alias("hit"),
        )

    first = F.struct(
        F.lit(None).cast("string").alias("start"), F.lit(False).alias("hit")
    )
    return F.aggregate(
        events,
        first,
        step,
        lambda s: s["hit"]
        | F.coalesce((s["start"] != "") & started(s["start"]), F.lit(False)),
    )


def is_affected(version: Column, affected: Column) -> Column:
    """Whether an advisory's ``affected`` list names the version or holds it in a SEMVER range."""
    def entry(key: Column) -> Column:
        return key.isNotNull() & F.exists(
            affected,
            lambda a: F.coalesce(F.array_contains(a["versions"], version), F.lit(False))
            | F.coalesce(
                F.exists(
                    F.filter(a["ranges"], lambda r: r["type"] == "SEMVER"),
                    lambda r: _events_hold(key, r["events"]),
                ),
                F.lit(False),
            ),
        )

    return F.coalesce(_bind(V.version_key(version), entry), F.lit(False))


# --- CPE bounds -------------------------------------------------------------------


def cpe_interval(node: Column) -> Column:
    """(lower, upper) ends of what a CPE node covers on the version axis.

    A pinned version is an interval around it, a node without version and bounds holds the whole
    axis. A version or bound that cannot be read covers nothing: its ends are null.
    """

    def end(name: str, place, otherwise: str) -> Column:
        given = F.nullif(node[name], F.lit(""))
        return F.when(given.isNull(), F.lit(otherwise)).otherwise(place(V.version_key(given)))

    lowers = [end("version_start_including", V.end_before, V.LOWEST), end("version_start_excluding", V.end_after, V.LOWEST)]
    uppers = [end("version_end_including", V.end_after, V.HIGHEST), end("version_end_excluding", V.end_before, V.HIGHEST)]
    pinned = V.version_key(node["version"])
    lowers.append(F.when(node["version"].isNull(), F.lit(V.LOWEST)).otherwise(V.end_before(pinned)))
    uppers.append(F.when(node["version"].isNull(), F.lit(V.HIGHEST)).otherwise(V.end_after(pinned)))
    # array_max skips nulls, so a null end is looked for first.
    known = lambda ends, pick: F.when(~F.exists(F.array(*ends), lambda e: e.isNull()), pick(F.array(*ends)))
    return F.struct(known(lowers, F.array_max).alias("lower"), known(uppers, F.array_min).alias("upper"))


def in_cpe_interval(position: Column, interval: Column) -> Column:
    """Whether a version's place lies inside; false for a null place or end."""
    return F.coalesce((interval["lower"] < position) & (position < interval["upper"]), F.lit(False))


def in_cpe_bounds(version: Column, node: Column) -> Column:
    """Whether a CPE node covers the version."""
    return in_cpe_interval(V.point(V.version_key(version)), cpe_interval(node))
