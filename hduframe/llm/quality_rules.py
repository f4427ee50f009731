"""Quality rules whose cutoffs are chosen under a bound on the risk of rejecting good documents, with DataFrame functions only.

Signals of each document are compared with cutoffs.  On a labelled holdout, every cutoff of a grid, in every stratum
(language) and for every rule, is tested: the hypothesis that it rejects more than ``alpha`` of the good documents is
dropped if the exact binomial probability of seeing as few rejected good ones is at most its share of ``delta``.  That
share is delta divided by the number of strata times rules (Bonferroni); within a stratum and rule the cutoffs are tested
in a fixed order, from lenient to strict, up to the first that fails, which keeps the error over the whole sequence.  The
strictest cutoff that passed is used; where none passed the rule rejects nothing in that stratum.  So with a probability of 1 - delta
no rule rejects more than alpha of any stratum's good documents, and all rules together not more than alpha times their number.
A stratum needs log(delta / (strata * rules)) / log(1 - alpha) good documents, none of them rejected, for any cutoff at all:
190 with four strata, four rules, delta 0.05 and alpha 0.03.

The bound holds for independent draws, so the holdout has each text of a stratum once, and a doc_id that is labelled twice once;
it is good if all its labels say so.  Null and empty texts have no words, so the base rules reject them; texts of any length are read
whole.  A null language is a stratum of its own.  Documents without a label take part in no test; each row gets its own verdict.
Without labels, or without documents, nothing is rejected beyond the base rules.  Columns named like the signals are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

WS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
ALPHA, DELTA, STRATA_MOST = 0.03, 0.05, 10_000


def signals(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and text_key (its MD5) of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    # split leaves an empty string before leading and after trailing white space
    words = docs.select(*keep, t.alias("t"), F.array_remove(F.split(t, WS), "").alias("w"))
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    s = words.select(*keep, "t", "w", windows.alias("h"), lines.alias("lines"))
    s = s.select(
        *keep,
        F.md5(F.col("t").cast("binary")).alias("text_key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # windows and their places, in the order of the windows; none where no window comes twice
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("p"),
    )
    same = lambda x, k: F.coalesce(F.get("p", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("p", lambda x, k: same(x, k - 1) | same(x, k + 1))
    s = s.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # each window covers three words, or as many as lie before the next one
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.withColumn("n_repeat_words", covered).drop("p", "at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Signals and their cutoffs from lenient to strict; a document is rejected over the cutoff.
GRIDS: dict[str, list[float]] = {
    "symbols_per_word": [3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1],
    "chars_per_word": [20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0],
    "repeated_words": [0.48, 0.44, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2],
    "dup_lines": [64.0, 32.0, 16.0, 8.0, 6.0, 4.0, 3.0, 2.0, 1.0],
}


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Each rule's signal as a column, and its cutoffs."""
    n = F.col("n_words")
    signal = {"symbols_per_word": F.col("n_symbols") / n, "chars_per_word": F.col("word_chars") / n, "repeated_words": F.col("n_repeat_words") / n, "dup_lines": F.col("n_dup_lines").cast("double")}
    return {r: (signal[r], grid) for r, grid in GRIDS.items()}


def log_factorial(n: Column) -> Column:
    """By Stirling's series, eight places on."""
    x = n.cast("double") + 9
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - reduce(lambda a, b: a + b, (F.log(n + k) for k in range(1, 9)))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p) where k is at most the mean, and 1 beyond: the term of k, and the terms before it by their
    ratios.  Those more than twelve deviations below the mean are nothing, so there are few however large n is."""
    last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    many = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 50)
    first = F.struct(F.exp(last).alias("term"), F.lit(0.0).alias("sum"))
    add = lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    return F.when(k > n * p, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), many), first, add)["sum"])


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff of each stratum and rule that passed, with its counts."""
    each = rules()
    good_ids = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    good = scored.where(~base_failed()).join(good_ids, "doc_id").dropDuplicates([stratum, "text_key"])
    # one row for each stratum: n and, for each rule and cutoff, the good documents over it
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"),
        F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(c).alias("cutoff"), F.sum((x > c).cast("long")).alias("k")) for r, (x, grid) in each.items() for j, c in enumerate(grid))).alias("tests"),
    )
    strata = F.count("*").over(W.partitionBy(F.lit(0)))  # over a row for each stratum
    tests = counts.withColumn("strata", strata).select("stratum", "n", "strata", F.explode("tests").alias("t")).select("stratum", "n", "strata", "t.*")
    passed = tests.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / (F.col("strata") * len(each)))
    # fixed sequence: steps before the first that fails
    ends = passed.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("fails"), F.max_by("step", "step").alias("last"), F.collect_list(F.struct("step", "cutoff", "k", "n")).alias("all"))
    return ends.select("stratum", "rule", F.filter("all", lambda x: x["step"] == F.coalesce(F.col("fails"), F.col("last") + 1) - 1).alias("best")).where(F.size("best") > 0).select("stratum", "rule", F.col("best")[0]["cutoff"].alias("cutoff"), F.col("best")[0]["k"].alias("rejected"), F.col("best")[0]["n"].alias("good"))


def apply(scored: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept.  The cutoffs are a row for each stratum; only a checked number of them is broadcast."""
    each = rules()
    wide = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in each))
    few = chosen.limit(STRATA_MOST * len(each) + 1).count() <= STRATA_MOST * len(each)
    joined = scored.join(F.broadcast(wide) if few else wide, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    over = reduce(lambda a, b: a | b, (F.coalesce(x > F.col(f"_{r}"), F.lit(False)) for r, (x, _) in each.items()))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("stratum", *(f"_{r}" for r in each))


def quality_rules(spark, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """op8: signals are computed once for all documents and written; cutoffs and verdicts come from that table."""
    scratch = Scratch(spark, "quality-rules")
    scored = scratch.write(signals(docs), "signals")
    chosen = scratch.write(cutoffs(scored, labels, alpha=alpha, delta=delta), "cutoffs")
    return apply(scored, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang")
