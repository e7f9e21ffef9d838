"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

A rule rejects a document when an integer ratio passes a cutoff. Cutoffs are picked per stratum
on labelled documents: for a cutoff that rejects ``k`` of ``n`` good documents, the exact
binomial tail P(X <= k) at the allowed rate is the p-value of "it rejects too many". A cutoff is
certified when that tail is at most ``delta / (strata * rules)``. Within a rule the tail can only
rise from lenient to strict cutoffs, so the certified ones are a prefix of the grid (a fixed
sequence of tests, which needs no further correction); over strata and rules the level is split
(Bonferroni). The allowed rate is split over the rules, so all rules together reject more than
``alpha`` of a stratum's good documents with a probability of at most ``delta`` over all strata.

Of the certified cutoffs of a rule the one with the largest "share of bad documents caught less
``cost`` times the share of good ones lost" is used, and the more lenient of equals; a rule with
no such gain, or with too few labels, rejects nothing in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.significance import log_factorial
from siftmark.session import written

BLANK = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
BROADCAST_STRATA = 10_000  # of a few hundred bytes each
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: rule -> (measure, base, cutoffs per 1000 of the base from lenient to strict, too much or too little)
RULES: dict[str, tuple[str, str, list[int], bool]] = {
    "symbols": ("n_symbols", "n_words", [2000, 1500, 1000, 750, 500, 400, 300, 200, 150, 100, 50], True),
    "dup_lines": ("n_dup_lines", "n_lines", [900, 800, 700, 600, 500, 400, 300, 200, 150, 100], True),
    "repeats": ("n_repeat_words", "n_words", [280, 260, 240, 220, 200, 180, 160, 140, 120, 100], True),
    "short_words": ("word_chars", "n_words", [1500, 2000, 2500, 2750, 3000, 3250, 3500], False),
    "long_words": ("word_chars", "n_words", [20000, 15000, 12000, 11000, 10000, 9000, 8500, 8000], True),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight that are found twice or more in the list."""
    at = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        repeated = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
            | ((i < last) & (F.get(ordered, i + 1)["h"] == x["h"])),
        )
        return F.aggregate(
            F.array_sort(F.transform(repeated, lambda x: x["i"])),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
            lambda s, i: F.struct(
                i.alias("last"), (s["total"] + F.least(F.lit(WINDOW), i - s["last"])).alias("total")
            ),
            lambda s: s["total"],
        )

    def count(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(ordered, covered)
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, count))


def measure(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """The rows with a struct of counts over the whole text, as longs.

    n_words (runs without blank characters), word_chars (code points in words), n_symbols,
    n_lines (lines with a word), n_dup_lines (those equal to an earlier one), n_repeat_words.
    A null text counts as empty: all zero. Windows are compared by 64-bit hashes within a text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    words = F.filter(F.split(body, BLANK, -1), lambda w: w != "")

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            _let(lines, lambda x: F.struct(
                F.size(x).cast("bigint").alias("all"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
            )).alias("lines"),
            _repeat_words(words).cast("bigint").alias("n_repeat_words"),
        )

    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    raw = F.col("_raw")
    return docs.select(*kept, _let(words, counts).alias("_raw")).select(
        *kept,
        F.struct(
            raw["n_words"].alias("n_words"), raw["word_chars"].alias("word_chars"),
            raw["n_symbols"].alias("n_symbols"), raw["lines"]["all"].alias("n_lines"),
            raw["lines"]["dup"].alias("n_dup_lines"), raw["n_repeat_words"].alias("n_repeat_words"),
        ).alias(name),
    )


def base_failed(m: Column) -> Column:
    """Too short, or more than three tenths of the words in repeated windows."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def _rejects(m: Column, rule: str, cutoff: Column) -> Column:
    measure_name, base, _, too_much = RULES[rule]
    value, bound = 1000 * m[measure_name], cutoff * m[base]
    return value > bound if too_much else value < bound


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials at rate p, for k below n p; 1 where k is not below.

    Terms are summed downwards from the largest, that of k. Each is at most a fixed part of the
    one before; past nine roots of n they are below double precision, so none that counts is
    left out and the work grows with the root of n.
    """
    reach = F.least(k, F.ceil(9 * F.sqrt(n)).cast("bigint") + 50)
    relative = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), reach),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"),
            (s["sum"] + s["term"]).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    log_first = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_first) * relative))


def calibrate(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang",
    alpha: float = 0.02, delta: float = 0.05, cost: int = 10, name: str = "measures",
) -> DataFrame:
    """One row per stratum with labels: (stratum, cutoffs), a map from rule to certified cutoff.

    ``labels`` has (doc_id, quality): 1 is good. A document with labels of both kinds counts as
    not good; null labels and null ids don't count. A null stratum is the stratum ''. Documents
    that fail the base rules are not tested. Every labelled row is used.
    """
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("_label_of")).agg(F.min("quality").alias("_quality"))
    )
    m = F.col("_m")
    tested = (
        measured.select(
            F.col("doc_id").alias("_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
            F.col(name).alias("_m"),
        )
        .where(~base_failed(m))
        .join(marks, F.col("_id") == F.col("_label_of"))
        .withColumn("good", F.col("_quality") == 1)
    )
    totals = [F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")]
    hits = [
        F.count_if(_rejects(m, rule, F.lit(cut)) & (F.col("good") == good)).alias(f"{rule}_{i}_{int(good)}")
        for rule, (_, _, grid, _) in RULES.items() for i, cut in enumerate(grid) for good in (True, False)
    ]
    counted = tested.groupBy("stratum").agg(*totals, *hits)
    # One small row per stratum from here on: strata are known only now, so their number is joined on.
    strata = counted.agg(F.count("*").alias("strata"))
    grids = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(cut).alias("cutoff"),
            F.col(f"{rule}_{i}_1").alias("k"), F.col(f"{rule}_{i}_0").alias("caught"),
        )
        for rule, (_, _, grid, _) in RULES.items() for i, cut in enumerate(grid)
    ])
    rows = counted.select("stratum", "n_good", "n_bad", F.explode(grids).alias("g")).select(
        "stratum", "n_good", "n_bad", "g.*"
    )
    rate = alpha / len(RULES)
    # As a one-row scalar, the number of strata is attached without a join of two tables.
    level = delta / (strata.scalar() * len(RULES))
    certified = rows.where(binomial_tail(F.col("k"), F.col("n_good"), rate) <= level)
    gain = F.col("caught") * F.col("n_good") - cost * F.col("k") * F.col("n_bad")
    best = (
        certified.withColumn("gain", gain).where("gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max_by("cutoff", F.struct("gain", (-F.col("place")).alias("lenient"))).alias("cutoff"))
    )
    return best.groupBy("stratum").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs")
    )


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", name: str = "measures") -> DataFrame:
    """The rows with base_failed and kept; a stratum without cutoffs only has the base rules.

    Cutoffs are one small row for each stratum that has hundreds of labels. Up to
    ``BROADCAST_STRATA`` of them are broadcast, so that rows with their texts stay where they
    are; beyond it, rows and cutoffs are joined by a shuffle.
    """
    cutoffs = written(cutoffs)
    m = F.col(f"`{name}`")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_rejects(m, rule, F.col("_cutoffs")[rule]), F.lit(False))
    limits = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    if cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    columns = [c for c in measured.columns if c not in ("base_failed", "kept")]
    return (
        measured.join(limits, F.coalesce(F.col(stratum), F.lit("")) == F.col("_stratum"), "left")
        .select(
            *[F.col(f"`{c}`") for c in columns], base_failed(m).alias("base_failed"),
            (~base_failed(m) & ~rejected).alias("kept"),
        )
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document; texts are read once.

    Repeated rows each get their verdict; an empty table gives none. Extra columns are ignored.
    """
    measured = written(measure(docs.select("doc_id", "lang", "text")).drop("text"))
    cutoffs = calibrate(measured, labels, alpha=alpha, delta=delta)
    return judge(measured, cutoffs).select("doc_id", *[f"measures.{c}" for c in MEASURES], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever these are named."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text")
    measured = written(measure(rows).drop("text"))
    cutoffs = calibrate(measured, labels, alpha=alpha, delta=delta)
    return judge(measured, cutoffs).where("kept").select("row.*")
