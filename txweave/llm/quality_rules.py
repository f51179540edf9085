"""Quality rules whose cutoffs are chosen with a guarantee on the share of good documents they reject.

Each rule rejects a document when one of its metrics is above a cutoff. The grid of cutoffs is fixed beforehand,
so every labelled good document serves as holdout. For a stratum (a band of document lengths) with n good holdouts,
k of which a cutoff rejects, the exact binomial tail P(Bin(n, alpha) <= k) tests "the cutoff rejects a share of alpha
or more of good documents". The cutoffs of a rule are tested in a fixed sequence, the loosest first, at the level
delta / (rules x strata): Bonferroni's correction over rules and strata; within the sequence none is needed, as testing
stops at the first that fails, and a tighter cutoff rejects no fewer, so its tail is no smaller. The lowest cutoff that
passes is taken. With probability 1 - delta, all chosen rules at once reject less than alpha each, so less than
alpha x rules together, of a stratum's good documents. A stratum with too few holdouts gets no cutoff and rejects
nothing.

Only DataFrame functions are used. Edge cases: null, empty and blank texts have no words and fail the base rule; long
texts are measured whole; a metric that equals (ties with) a cutoff is not above it; repeated rows are judged alike;
labels that contradict each other for one doc_id count as not good; labels without a document and documents without a
label are harmless; an empty table gives an empty result; `keep_good` carries all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import SPACE_RE, WORD_RE, cut, row_key, stored, words

#: Metric -> cutoffs tried, all fixed before any label is seen.
RULES = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8],
    "upper_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "shout_share": [0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3],
    "mean_word": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
#: Upper ends, in words, of all strata but the last; the table of cutoffs has a row for each stratum at most.
BANDS = [100, 400, 1600]
ALPHA = 0.005
DELTA = 0.05
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(w: Column, width: int = 5) -> Column:
    """Words covered by windows of `width` words that occur twice or more in the array `w`."""
    n = F.size(w) - (width - 1)
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = lambda k, step: F.coalesce(F.get(p, k)["h"] == F.get(p, k + step)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.array_sort(F.transform(at, lambda k: F.get(p, k)["i"]))

        positions = F.get(F.transform(F.array(order), twice), F.lit(0))
        # Runs of windows overlap: a window adds as many words as it starts after the one before, width at most.
        added = lambda q: F.transform(q, lambda x, k: F.when(k == 0, width).otherwise(F.least(F.lit(width), x - F.get(q, k - 1))))
        steps = F.get(F.transform(F.array(positions), added), F.lit(0))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    bound = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.get(bound, F.lit(0))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base counts and the metrics of RULES; both depend on the row's text alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_RE))
    # Bound in a lambda and put through a generator, so no optimizer rule copies them into other expressions, where
    # they would be computed anew for each use.
    counts = lambda w, x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        chars(SPACE_RE).alias("word_chars"),
        chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        chars(r"\P{Lu}+").alias("_upper"),
        chars(r"[^!]+").alias("_shout"),
        F.size(x).alias("_n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    each = F.transform(F.array(F.struct(words(F.col(text)).alias("w"), lines.alias("x"))), lambda p: counts(p["w"], p["x"]))
    counted = docs.select("*", F.inline(each))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("_upper", "word_chars"),
            "shout_share": share("_shout", "word_chars"),
            "mean_word": share("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "stratum": sum((F.when(F.col("n_words") > b, 1).otherwise(0) for b in BANDS), F.lit(0)),
        }
    ).drop("_upper", "_shout", "_n_lines")


def _log_factorial(n: Column) -> Column:
    """ln n!: by Stirling's series from 16 on, where it is exact to the last places."""
    x = F.greatest(n, F.lit(16)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(16)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n: the term of k by its logarithm, the others by their ratios down from it.

    Terms so far below the mean that they vanish are left out, and a k so far above that the tail is 1 needs none: some
    24 standard deviations remain, which is little more than the root of n."""
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    reach = F.ceil(12 * F.sqrt(n * p) + 200).cast("long")
    end = F.greatest(F.lit(0), F.floor(n * p).cast("long") - reach)
    one = k > F.ceil(n * p).cast("long") + reach
    down = F.when((k > end) & ~one, F.sequence(k.cast("long"), end + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * j / (n - j + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(down, start, step, lambda a: a["total"])
    log_tail = log_top + F.log(total)
    return F.when((k >= n) | one, F.lit(1.0)).when(log_tail > 0, 1.0).otherwise(F.exp(log_tail))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum with holdouts: the cutoff of each rule, null where none is safe.

    measured: doc_id, stratum, base_failed and the metrics. labels: doc_id, quality (1 is good). The result has
    len(BANDS) + 1 rows at most."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = measured.where(~F.col("base_failed")).join(good, "doc_id")
    counts = [F.count(F.lit(1)).alias("n")]
    counts += [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, grid in RULES.items() for i, c in enumerate(grid)]
    tests = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r, grid in RULES.items() for i, c in enumerate(grid)))
    tried = len(RULES) * (len(BANDS) + 1)
    rows = held.groupBy("stratum").agg(*counts).select("stratum", "n", F.inline(tests))
    safe = rows.where(binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / tried)
    return safe.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def tests_grid() -> list[tuple[str, float]]:
    return [(r, c) for r, grid in RULES.items() for c in grid]


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`measured` with kept: false where the base rule or a chosen cutoff rejects. cutoffs has a few rows by design."""
    out = measured.join(F.broadcast(cutoffs), "stratum", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*(f"cut_{r}" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the base counts, the metrics, base_failed, stratum and kept of every row of `docs`."""
    measured = cut(with_metrics(docs.select("doc_id", "text")).drop("text"))
    return judge(measured, choose_cutoffs(measured, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that are kept, with the same columns.

    Nothing is measured twice: what is rejected is stored as keys of doc_id and text, and the rest of the rows stays. As
    the verdict depends on the text alone, rows of one key share it."""
    own = docs.columns
    inner = docs.select("doc_id", "text")
    measured = cut(with_metrics(inner).withColumn("text_hash", F.xxhash64("text")).drop("text"))
    judged = judge(measured, choose_cutoffs(measured, labels, alpha, delta))
    rejected = stored(judged.where("not kept").select(*row_key(F.col("doc_id"), F.col("text_hash"))).distinct())
    keyed = docs.select(F.struct(*own).alias("_row"), *row_key(F.col("doc_id"), F.xxhash64("text")))
    return keyed.join(rejected, ["k1", "k2"], "left_anti").select(*(F.col("_row").getField(c).alias(c) for c in own))
