"""Quality rules whose cutoffs carry a guarantee.

Every rule rejects a document whose measure exceeds a cutoff.  On a labelled
holdout the good documents that a cutoff rejects are counted for each stratum,
and the exact binomial tail says how likely so few rejections would be if the
true rate were above the limit.  The strictest cutoff whose tail stays below
the error level, divided by the number of tests made, is taken; where none
passes, the rule rejects nothing there.  Each rule gets an equal share of the
limit, so all rules together reject at most the limit of good documents.

Everything is a DataFrame expression; no Python runs in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnloom.llm.shared import other_fields, written

# Of the good documents of a stratum, the share that may be rejected.
LIMIT = 0.02
# Probability that any stratum exceeds its limit.
ERROR = 0.05
# More strata than this are joined by shuffle instead of broadcast.
BROADCAST_STRATA = 10_000
WINDOW = 8

# Cutoffs tried for each rule; a document is rejected above the cutoff.
CUTOFFS = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25),
    "mean_word": (9.0, 10.0, 12.0, 15.0, 20.0),
}

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(words: str, hashes: str, pairs: str) -> Column:
    """Words inside windows that occur twice or more."""
    last = F.size(pairs) - 1
    repeated = F.filter(
        pairs,
        lambda p, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"]))
        | ((k < last) & (F.get(pairs, k + 1)["h"] == p["h"])),
    )
    starts = F.sort_array(F.transform(repeated, lambda p: p["i"]))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(
        starts,
        zero,
        lambda a, i: F.struct(
            (a["total"] + i + WINDOW - F.greatest(a["end"], i)).alias("total"), (i + WINDOW).alias("end")
        ),
    )
    return F.when(F.col(pairs).isNull(), 0).otherwise(covered["total"])


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by the counts in FEATURES (all long).

    A null or empty text has zero of everything.  Every row is measured on its
    own; repeated rows repeat.  Columns named like a count are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [f.name for f in other_fields(df, [text, *FEATURES])]
    rows = df.select(
        *kept,
        F.filter(F.split(whole, r"[ \x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^ \x09-\x0D]")).alias("_lines"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    count = F.size("_words")
    windows = F.transform(
        F.sequence(F.lit(0), count - WINDOW),
        lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)]),
    )
    rows = rows.withColumn("_hashes", F.when(count > WINDOW, windows))
    numbered = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some_repeat = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_pairs", F.when(some_repeat, F.sort_array(numbered)))
    return rows.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_words", "_hashes", "_pairs").cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The measure of each rule; 0 where its denominator is 0."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "mean_word": ratio("word_chars", "n_words"),
    }


def tail(rejected: Column, total: Column, rate: float) -> Column:
    """P(X <= rejected) for X binomial(total, rate); 1 if the observed rate reaches ``rate``."""
    first = total * F.log(F.lit(1.0 - rate))
    odds = F.log(F.lit(rate / (1.0 - rate)))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((total - j + 1) / j) + odds
        high, low = F.greatest(state["sum"], term), F.least(state["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), rejected), start, add)["sum"]
    return (
        F.when(rejected >= rate * total, F.lit(1.0))
        .when(rejected == 0, F.exp(first))
        .otherwise(F.exp(summed))
    )


def cutoffs(holdout: DataFrame, stratum: str, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """One row per stratum of the good, labelled documents: the cutoff of each rule.

    ``holdout`` holds counts as of ``features``.  A rule's cutoff is null where
    no tried cutoff can be guaranteed.
    """
    rules = measures()
    tests = [(rule, cut) for rule in rules for cut in CUTOFFS[rule]]
    strata = holdout.select(stratum).distinct().count()
    share, level = limit / len(rules), error / (len(tests) * max(1, strata))
    counted = holdout.filter(~base_failed()).groupBy(stratum).agg(
        F.count("*").alias("_n"),
        *[F.sum((rules[r] > c).cast("long")).alias(f"_k{i}") for i, (r, c) in enumerate(tests)],
    )
    listed = counted.select(
        stratum,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"_k{i}").alias("rejected"))
                    for i, (r, c) in enumerate(tests)
                ]
            )
        ).alias("_t"),
    ).select(stratum, "_n", "_t.*")
    passed = listed.filter(tail(F.col("rejected"), F.col("_n"), share) <= level)
    return passed.groupBy(stratum).agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in rules]
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    stratum: str = "lang",
    text: str = "text",
    limit: float = LIMIT,
    error: float = ERROR,
) -> DataFrame:
    """Add counts, base_failed, the measures' cutoffs and ``kept`` to every document.

    ``labels`` has ``key`` and quality (1 good, 0 bad); a document labelled both
    ways is not good, null labels and keys do not count.  A null stratum is a
    stratum of its own.  ``kept`` is false where the base rules fail or a measure
    exceeds its stratum's cutoff; without labels only the base rules reject.
    """
    others = [n for n in docs.columns if n not in (key, stratum, text)]
    # The text is read once: the small counts serve the holdout and the verdict.
    counted = written(features(docs.drop(*others), text), "quality")
    good = labels.groupBy(key).agg(F.min("quality").alias("_good")).filter("_good = 1").select(key)
    named = counted.withColumn("_stratum", F.struct(F.col(stratum).alias("value")))
    holdout = named.join(good, key, "left_semi")
    limits = written(cutoffs(holdout, "_stratum", limit, error), "cutoffs")
    small = F.broadcast(limits) if limits.count() <= BROADCAST_STRATA else limits
    rules = measures()
    beyond = reduce(
        lambda a, b: a | b, [F.coalesce(rules[r] > F.col(f"max_{r}"), F.lit(False)) for r in rules]
    )
    verdict = named.join(small, "_stratum", "left").withColumn("base_failed", base_failed())
    return verdict.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_stratum")
