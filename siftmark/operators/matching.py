"""Findings against the ground truth: true positives, misses and extra findings.

Inputs. ``gt``: ord, ecosystem, component, version, cve, ghsa, osv_id.
``findings``: the same and tool, affected_version_range. ``ord`` is a unique,
sortable text that stands for input order.

Matching is decided once per *signature* (ecosystem, component, version and the three
ids), since rows of one signature share their verdict; only row-level outputs join
back. Ids are exploded so that sharing an id is an equality join.

A package of few rows is dealt out whole: both sides are shuffled by package once, and all
joins and groupings after that stay inside the task. Packages of many rows (``crowded``) go
through the version axis, whose cost is no product and which spreads one package over tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions import constants as K
from siftmark.functions import ranges as R
from siftmark.functions import versions as V
from siftmark.functions.identity import id_set
from siftmark.functions.text import filled, packed, unpacked
from siftmark.operators.intervals import covered, covering
from siftmark.session import written

# The finer column first: sorts compare its leading bytes before anything else.
PACKAGE = ["component", "ecosystem"]
IDS = ["cve", "ghsa", "osv_id"]
SIGNATURE = [*PACKAGE, "version", *IDS]


def with_signature(df: DataFrame) -> DataFrame:
    """Ids as empty text instead of null, so that signatures join by plain equality."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in IDS})


def signatures(gt: DataFrame, *more: Column) -> DataFrame:
    """Distinct signatures with their number of rows; partial sums absorb hot ones.

    ``more``: further aggregates of the rows.
    """
    return with_signature(gt).groupBy(*SIGNATURE).agg(F.count("*").alias("n_rows"), *more)


def _by_id(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns, F.explode(id_set(*[F.col(c) for c in IDS])).alias("id"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read, computed once per row.

    A filter on a plain projected column is pushed below it and computes it a second
    time; a generator is not crossed.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: A package is matched by pairs if one of its sides has at most so many rows, so that pairs grow
#: with the rows of the other side,
FEW = 128
#: and if it has at most so many rows in all, which one task takes.
ONE_TASK = 50_000


def crowded(*tables: DataFrame) -> DataFrame:
    """The packages that are not matched by pairs, written: a short list, since each has many rows.

    The second table, the findings, makes pairs with each of the others.
    """
    none = F.lit(0).cast("bigint")
    names = [f"n_{i}" for i in range(len(tables))]
    counted = [
        t.groupBy(*PACKAGE).agg(F.count("*").alias(n)).withColumns({m: none for m in names if m != n})
        for t, n in zip(tables, names, strict=True)
    ]
    counts = reduce(DataFrame.unionByName, counted).groupBy(*PACKAGE).agg(*[F.sum(n).alias(n) for n in names])
    pairs = [F.least(n, names[1]) > FEW for n in names if n != names[1]]
    many = reduce(or_, pairs) | (reduce(add, [F.col(n) for n in names]) > ONE_TASK)
    return written(counts.where(many).select(*PACKAGE).dropna())


def by_package(df: DataFrame, crowd: DataFrame) -> DataFrame:
    """The rows of the other packages, each package in one task. Rows without a package go.

    Digests in ``ord`` travel as bytes.
    """
    few = df.join(crowd, PACKAGE, "left_anti").dropna(subset=PACKAGE)
    if "ord" not in df.columns:
        return few.repartition(*PACKAGE)
    sent = few.withColumn("ord", packed(F.col("ord"))).repartition(*PACKAGE)
    return sent.withColumn("ord", unpacked(F.col("ord")))


def parsed_texts(findings: DataFrame) -> DataFrame:
    """Each range text once, with (lower, upper); texts that hold nothing go."""
    name = "affected_version_range"
    texts = findings.select(name).where(filled(F.col(name))).distinct()
    parsed = once(texts, "r", R.bare_range(F.col(name))).where("r.lower < r.upper")
    return parsed.select(name, "r.lower", "r.upper")


def parsed_ranges(ranges: DataFrame, findings: DataFrame) -> DataFrame:
    """Range texts as (lower, upper); ranges that hold nothing go.

    ``findings`` supplies the distinct texts: each is parsed once, from a scan of that one
    column, and the short result joins the many places that use it.
    """
    name = "affected_version_range"
    return ranges.join(parsed_texts(findings), name).drop(name)


def with_position(versions: DataFrame) -> DataFrame:
    """Versions that can be read, with their place on the version axis."""
    return once(versions, "position", V.point(V.version_key(F.col("version")))).where(
        "position is not null"
    )


def folded(findings: DataFrame, owner: list[str]) -> DataFrame:
    """Distinct (owner, package, version, ids, range) with the least ``ord``, written once.

    Exact and range matching and the range texts all read it, so findings are scanned once.
    """
    keys = [*owner, *PACKAGE, "version", *IDS, "affected_version_range"]
    return written(findings.groupBy(*keys).agg(F.min("ord").alias("ord")))


def candidates(sigs: DataFrame, findings: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, package, version, id, kind, ord): kind 0 same version, 1 by range.

    The least (kind, ord) of a version and id is the finding to choose. ``findings`` are folded.
    """
    by_id = _by_id(findings, *owner, "ord", *PACKAGE, "version", "affected_version_range")
    exact = (
        by_id.groupBy(*PACKAGE, "version", "id", *owner)
        .agg(F.min("ord").alias("finding_ord"))
        .withColumn("kind", F.lit(0))
    )
    intervals = parsed_ranges(
        by_id.where(filled(F.col("affected_version_range")))
        .groupBy(*PACKAGE, "id", "affected_version_range", *owner)
        .agg(F.min("ord").alias("finding_ord")),
        findings,
    )
    versions = with_position(_by_id(sigs, *PACKAGE, "version").distinct())
    ranged = covering(
        versions, intervals, [*PACKAGE, "id"], "version", owner, "finding_ord"
    ).withColumn("kind", F.lit(1))
    columns = [*owner, *PACKAGE, "version", "id", "kind", "finding_ord"]
    return exact.select(*columns).unionByName(ranged.select(*columns))


def matched_signatures(
    gt: DataFrame, findings: DataFrame, owner: list[str], first: bool = False
) -> DataFrame:
    """Per owner, the signatures it finds: match_type, the chosen finding, n_rows.

    The chosen finding is the first with the same version, else the first whose range
    holds the version, in finding order. Several signatures of a package may choose one finding;
    ``n_chosen`` is 1 at one of them and else 0. With ``first``, ``first_ord`` is the least ``ord``
    of a signature's rows.
    """
    more = [F.min("ord").alias("first_ord")] if first else []
    crowd = crowded(gt, findings)
    found = by_package(findings, crowd)
    sigs = signatures(by_package(gt, crowd), *more)
    carried = sigs.columns[len(SIGNATURE):]
    hits = _chosen(_paired(sigs, found, owner, written(parsed_texts(findings)), "inner"), owner, carried)
    if crowd.isEmpty():
        return hits
    return hits.unionByName(
        matched_by_axis(gt.join(crowd, PACKAGE), findings.join(crowd, PACKAGE), owner, *more)
    )


def _best(candidates: DataFrame, owner: list[str], *carried: str) -> DataFrame:
    return candidates.groupBy(*SIGNATURE, *owner).agg(
        F.min(F.struct("kind", "finding_ord")).alias("best"),
        *[F.first(c).alias(c) for c in carried],
    )


def _match_type() -> Column:
    kind = F.col("best.kind")
    return F.when(kind == 0, K.TP_EXACT).when(kind == 1, K.TP_RANGE).alias("match_type")


def _chosen(candidates: DataFrame, owner: list[str], carried: list[str]) -> DataFrame:
    one = Window.partitionBy(*PACKAGE, *owner, "finding_ord").orderBy(*SIGNATURE)
    return (
        _best(candidates, owner, *carried)
        .select(
            *owner,
            *SIGNATURE,
            _match_type(),
            F.col("best.finding_ord").alias("finding_ord"),
            *carried,
        )
        .withColumn(
            "n_chosen",
            ((F.row_number().over(one) == 1) & F.col("finding_ord").isNotNull()).cast("bigint"),
        )
    )


def shared_id(ids: list[Column], others: list[Column]) -> Column:
    """True when a filled id of the one side is one of the other's."""
    equal = [F.nullif(a, F.lit("")) == F.nullif(b, F.lit("")) for a in ids for b in others]
    return F.coalesce(reduce(or_, equal), F.lit(False))


def _paired(
    sigs: DataFrame, findings: DataFrame, owner: list[str], texts: DataFrame, how: str, by_id: bool = True,
    carried: list[str] = [],
) -> DataFrame:
    """Signatures with each finding they may choose; both sides are dealt out by package.

    Without ``by_id``, findings that share no id are there as well, and ``same_id`` tells which do.
    ``carried``: further columns of the findings. Theirs with a signature's name get a ``_``.
    Packages alone are the join's key, which the dealing serves: with ids in it, both sides would
    be shuffled again.
    """
    placed = once(sigs, "position", V.point(V.version_key(F.col("version"))))
    found = findings.join(texts, "affected_version_range", "left").select(
        *owner,
        *[F.col(c).alias(f"_{c}") for c in (*PACKAGE, "version")],
        *[F.col(c).alias(f"_{c}") for c in IDS],
        *carried,
        "lower",
        "upper",
        F.col("ord").alias("finding_ord"),
        F.lit(1).alias("kind"),
    )
    package = reduce(and_, [F.col(c) == F.col(f"_{c}") for c in PACKAGE])
    same_id = shared_id([F.col(c) for c in IDS], [F.col(f"_{c}") for c in IDS])
    same = F.col("version") == F.col("_version")
    inside = (F.col("lower") < F.col("position")) & (F.col("position") < F.col("upper"))
    pairs = placed.join(found, package & (same | inside) & (same_id if by_id else F.lit(True)), how)
    return pairs.withColumns({"kind": F.when(same, 0).otherwise(F.col("kind")), "same_id": same_id})


def _with_rows(gt: DataFrame, *rows: str) -> DataFrame:
    """``signatures``, with these columns of their rows as a list of structs, if there are any."""
    listed = [F.collect_list(F.struct(*rows)).alias("rows")] if rows else []
    return with_signature(gt).groupBy(*SIGNATURE).agg(F.count("*").alias("n_rows"), *listed)


def said_by_pairs(
    gt: DataFrame, findings: DataFrame, owner: list[str], texts: DataFrame, *rows: str
) -> DataFrame:
    """Every signature of packages dealt out whole: n_rows, and ``said``, a list of what each owner
    finds (owner, match_type, finding_ord), empty if none does.

    ``rows``: columns of the rows to carry along, as a list of structs of this name. Nothing is
    shuffled, so later groupings by package and more are not either.
    """
    carried = ["n_rows", *(["rows"] if rows else [])]
    best = _best(_paired(_with_rows(gt, *rows), findings, owner, texts, "left"), owner, *carried)
    verdict = F.struct(*owner, _match_type(), F.col("best.finding_ord").alias("finding_ord"))
    return best.groupBy(*SIGNATURE).agg(
        *[F.first(c).alias(c) for c in carried],
        F.collect_list(F.when(F.col("best.kind").isNotNull(), verdict)).alias("said"),
    )


def matched_by_axis(gt: DataFrame, findings: DataFrame, owner: list[str], *more: Column) -> DataFrame:
    """``matched_signatures`` without pairs, of packages that may be too large for a task.

    ``more``: further aggregates of a signature's rows.
    """
    sigs = written(signatures(gt, *more))
    carried = sigs.columns[len(SIGNATURE):]
    return _chosen(
        _by_id(sigs, *SIGNATURE, *carried).join(
            candidates(sigs, folded(findings, owner), owner), [*PACKAGE, "version", "id"]
        ),
        owner,
        carried,
    )


def for_each_tool(gt: DataFrame, tools: list[str]) -> DataFrame:
    """One copy of every row per configured tool, made in place without a join."""
    return gt.withColumn("tool", F.explode(F.array(*[F.lit(t) for t in tools])))


def match(gt: DataFrame, findings: DataFrame, tools: list[str], chosen: bool = True) -> DataFrame:
    """Every ground-truth row under every tool, with match_type and finding_ord (null: missed).

    Rows meet what all tools say of their signature once, and are copied afterwards. Without
    ``chosen`` there is no finding_ord, and findings are dealt out without their ``ord``.
    """
    crowd = crowded(gt, findings)
    verdict = ["match_type", *(["finding_ord"] if chosen else [])]
    dealt = findings if chosen else findings.withColumn("ord", F.lit(None).cast("string"))
    small = said_by_pairs(
        by_package(gt, crowd), by_package(dealt, crowd), ["tool"], written(parsed_texts(findings)), *_apart(gt)
    )
    by_tool = F.map_from_entries(
        F.transform("said", lambda v: F.struct(v["tool"], F.struct(*[v[c].alias(c) for c in verdict])))
    )
    small = small.select(*SIGNATURE, by_tool.alias("said"), F.inline("rows"))
    rest = not_dealt(gt, crowd)
    hits = matched_by_axis(rest.dropna(subset=PACKAGE), findings.join(crowd, PACKAGE), ["tool"])
    large = with_signature(rest).join(_per_signature(hits, F.struct(*verdict)), SIGNATURE, "left")
    rows = for_each_tool(small.unionByName(large), tools)
    return rows.withColumn("_said", F.try_element_at("said", F.col("tool"))).select(
        "tool", *gt.columns, *[f"_said.{c}" for c in verdict]
    )


def _apart(gt: DataFrame) -> list[str]:
    return [c for c in gt.columns if c not in SIGNATURE]


def not_dealt(df: DataFrame, crowd: DataFrame) -> DataFrame:
    """The rows that ``by_package`` leaves out."""
    listed = df.join(crowd.withColumn("_crowd", F.lit(True)), PACKAGE, "left")
    lacking = reduce(or_, [F.col(c).isNull() for c in PACKAGE])
    return listed.where(F.col("_crowd") | lacking).select(*df.columns)


def _per_signature(rows: DataFrame, value: Column) -> DataFrame:
    """``said``: a map from tool to value, with at most one entry per tool."""
    return rows.groupBy(*SIGNATURE).agg(
        F.map_from_entries(F.collect_list(F.struct("tool", value))).alias("said")
    )


def classified_misses(gt: DataFrame, findings: DataFrame, tools: list[str]) -> DataFrame:
    """Every missed row under every tool, with ``fn_class``."""
    crowd = crowded(gt, findings)
    small = _classes_by_pairs(gt, findings, tools, crowd, *_apart(gt)).select(
        "tool", *SIGNATURE, "fn_class", F.inline("rows")
    )
    if crowd.isEmpty():
        return small.select(*gt.columns, "tool", "fn_class")
    large, found = gt.join(crowd, PACKAGE), findings.join(crowd, PACKAGE)
    classes = _classes_by_axis(large, found, tools, matched_by_axis(large, found, ["tool"]))
    rows = with_signature(large).join(_per_signature(classes, F.col("fn_class")), SIGNATURE)
    rows = rows.select(*gt.columns, F.explode("said").alias("tool", "fn_class"))
    return small.select(*rows.columns).unionByName(rows.where(F.col("tool").isin(tools)))


def missed_signatures(
    gt: DataFrame, findings: DataFrame, tools: list[str], matched: DataFrame
) -> DataFrame:
    """Signatures a tool misses, with their number of rows and ``fn_class``."""
    crowd = crowded(gt, findings)
    small = _classes_by_pairs(gt, findings, tools, crowd)
    if crowd.isEmpty():
        return small
    large, found, hits = (df.join(crowd, PACKAGE) for df in (gt, findings, matched))
    classes = _classes_by_axis(large, found, tools, hits)
    return small.unionByName(classes.select(*small.columns))


def _classes_by_pairs(
    gt: DataFrame, findings: DataFrame, tools: list[str], crowd: DataFrame, *rows: str
) -> DataFrame:
    """(tool, signature, n_rows, fn_class), and ``rows``, of packages that one task takes whole."""
    carried = ["n_rows", *(["rows"] if rows else [])]
    sigs = _with_rows(by_package(gt, crowd).where("version is not null"), *rows)
    texts = written(parsed_texts(findings))
    pairs = _paired(sigs, by_package(findings, crowd), ["tool"], texts, "left", by_id=False)
    per_tool = pairs.groupBy(*SIGNATURE, "tool").agg(
        F.bool_or("same_id").alias("hit"), F.min("kind").alias("kind"), *[F.first(c).alias(c) for c in carried]
    )
    fn_class = F.when(F.col("kind") == 0, K.FN_EXACT).otherwise(K.FN_RANGE)
    said = F.when(F.col("kind").isNotNull(), F.struct("tool", F.when(~F.col("hit"), fn_class).otherwise("")))
    told = per_tool.groupBy(*SIGNATURE).agg(
        *[F.first(c).alias(c) for c in carried], F.map_from_entries(F.collect_list(said)).alias("said")
    )
    told = for_each_tool(told, tools).withColumn(
        "fn_class", F.coalesce(F.try_element_at("said", F.col("tool")), F.lit(K.FN_TRUE))
    )
    return told.where("fn_class <> ''").select("tool", *SIGNATURE, *carried, "fn_class")


def _classes_by_axis(
    gt: DataFrame, findings: DataFrame, tools: list[str], hits: DataFrame
) -> DataFrame:
    """The same without pairs; what is missed is written, since it is read twice."""
    found = hits.select("tool", *SIGNATURE)
    missed = written(for_each_tool(signatures(gt), tools).join(found, ["tool", *SIGNATURE], "left_anti"))
    return classify_misses(missed, folded(findings, ["tool"]))


def false_positives(findings: DataFrame, matched: DataFrame) -> DataFrame:
    """Findings no ground-truth row chose; a second finding of a matched row is one.

    Digests in ``ord`` are compared as bytes, which are shuffled at half their length.
    """
    chosen = matched.where("finding_ord is not null").select("tool", packed(F.col("finding_ord")).alias("ord"))
    sent = findings.withColumn("ord", packed(F.col("ord")))
    left = sent.join(chosen, ["tool", "ord"], "left_anti").select(*findings.columns)
    return left.withColumn("ord", unpacked(F.col("ord")))


def extra_findings(gt: DataFrame, findings: DataFrame) -> DataFrame:
    """``false_positives`` of what ``matched_signatures`` gives for each tool.

    In packages dealt out whole, the rows stay in the task that decides about them; only rows
    of ``crowded`` packages are shuffled once more.
    """
    small, rest = extra_parts(gt, findings, crowded(gt, findings))
    return small.unionByName(rest)


def extra_parts(gt: DataFrame, findings: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``extra_findings`` of the packages dealt out whole, and of the others.

    The first are still dealt by package, so tables that ``by_package`` deals join them by package
    without a shuffle.
    """
    sigs = signatures(by_package(gt, crowd))
    key = [*PACKAGE, "version", *IDS]
    apart = [c for c in findings.columns if c not in (*key, "tool", "ord")]
    # Numbers the rows inside a task, where all rows of a finding stay.
    found = by_package(findings, crowd).withColumn("_row", F.monotonically_increasing_id())
    pairs = _paired(sigs, found, ["tool"], written(parsed_texts(findings)), "right", carried=[*apart, "_row"])
    of_signature = Window.partitionBy(*[f"_{c}" for c in PACKAGE], "version", *IDS, "tool")
    this = F.struct("kind", "finding_ord")
    chosen = F.col("n_rows").isNotNull() & F.col("finding_ord").isNotNull() & (F.min(this).over(of_signature) == this)
    small = (
        pairs.withColumn("_chosen", chosen)
        .groupBy("_row", "tool", *[f"_{c}" for c in key], *apart, "finding_ord")
        .agg(F.max("_chosen").alias("_chosen"))
        .where(~F.col("_chosen"))
        .select("tool", F.col("finding_ord").alias("ord"), *[F.col(f"_{c}").alias(c) for c in key], *apart)
        .select(*findings.columns)
    )
    rest = not_dealt(findings, crowd)
    if crowd.isEmpty():
        return small, rest
    hits = matched_by_axis(gt.join(crowd, PACKAGE), findings.join(crowd, PACKAGE), ["tool"])
    return small, false_positives(rest, hits)


def false_negatives(matched: DataFrame) -> DataFrame:
    return matched.where("match_type is null").drop("match_type", "finding_ord")


def classify_misses(misses: DataFrame, findings: DataFrame) -> DataFrame:
    """Signature-level misses with ``fn_class``; ids play no part here.

    FN_exact: the tool reports the package in this version. FN_range: some reported
    range of the package holds the version. FN_true: neither.
    """
    key = ["tool", *PACKAGE, "version"]
    spots = misses.select(*key).distinct()
    same = findings.select(*key).distinct().withColumn("same_version", F.lit(True))
    ranges = parsed_ranges(
        findings.where(filled(F.col("affected_version_range")))
        .select("tool", *PACKAGE, "affected_version_range")
        .distinct(),
        findings,
    )
    located = once(spots, "position", V.point(V.version_key(F.col("version"))))
    group = ["tool", *PACKAGE]
    inside = covered(
        located.where("position is not null").select(*group, "position").distinct(), ranges, group
    ).withColumn("in_range", F.lit(True))
    classes = (
        located.join(same, key, "left")
        .join(inside, [*group, "position"], "left")
        .select(
            *key,
            F.when(F.col("same_version"), K.FN_EXACT)
            .when(F.col("in_range"), K.FN_RANGE)
            .otherwise(K.FN_TRUE)
            .alias("fn_class"),
        )
    )
    return misses.join(classes, key)


def pair_verdict(same_id: Column, gt_version: Column, tool_version: Column, in_range: Column) -> Column:
    """Verdict of one finding against one row: TP, TP_RANGE, FN (id only) or FP."""
    return (
        F.when(~same_id, F.lit("FP"))
        .when(gt_version == tool_version, F.lit("TP"))
        .when(in_range, F.lit("TP_RANGE"))
        .otherwise(F.lit("FN"))
    )


def in_range_by_text(pairs: DataFrame, version: str, text: str, versions: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with ``in_range``: whether the version lies in the bare-bound range.

    ``versions`` and ``texts`` hold all versions and range texts of the pairs. Each is read once,
    not once for every pair; both tables are written, so that joins go by their sizes.
    """
    placed = with_position(versions.select(F.col(version).alias("version")).distinct()).withColumnRenamed("version", version)
    ranges = texts.select(F.col(text)).where(F.col(text).isNotNull()).distinct()
    ranges = once(ranges, "r", R.bare_range(F.col(text))).where("r.lower < r.upper").select(text, "r.lower", "r.upper")
    placed, ranges = written(placed), written(ranges)
    inside = (F.col("lower") < F.col("position")) & (F.col("position") < F.col("upper"))
    return (
        pairs.join(placed, version, "left").join(ranges, text, "left")
        .withColumn("in_range", F.coalesce(inside, F.lit(False)))
        .drop("position", "lower", "upper")
    )


def findings_for(findings: DataFrame, ecosystem: str, component: str, version: str) -> DataFrame:
    """Point lookup of one component version."""
    return findings.where(
        (F.col("ecosystem") == ecosystem)
        & (F.col("component") == component)
        & (F.col("version") == version)
    )
