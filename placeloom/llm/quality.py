"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  A document fails the base rules with under 50 words, or with over
half of its words in 3-word windows found twice or more.  Of the rest, each rule (a score and a cutoff per
stratum) rejects what scores above its cutoff.  Cutoffs come from a fixed grid.  The labelled good documents
that pass the base rules are the holdout.  A quarter of it proposes a cutoff per rule, the strictest one that
rejects its share of the risk there.  The rest tests all rules at once, at the full ``alpha``, in a fixed sequence:
from cutoffs laxer than those proposed by whole notches of the grid to those proposed.  A test passes if the exact
binomial probability of as few rejected ones, were the true rate of false rejections ``alpha``, is at most ``delta``
over the strata (Bonferroni over these; a fixed sequence needs none).  So with probability ``1 - delta`` at most
``alpha`` of the good documents of any stratum are rejected, by all rules together.  Strata whose holdout could not
certify even rules without rejections are one pool, and the guarantee holds for the pool.

Null texts count as empty, a null stratum is a stratum of its own, a document with any bad label is no good
one, unlabelled strata get no cutoffs, an empty table gives an empty result.  Rows are judged one by one;
extra columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: The rules' scores over n_words, in SQL, and the grid of cutoffs of each.
RULES = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "repeats": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.4)),
    "copied_lines": ("n_dup_lines / n_words", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
    "capitals": ("n_capitals / word_chars", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "marks": ("n_marks / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "long_words": ("word_chars / n_words", (8.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Strata whose cutoffs are broadcast; with more, they are joined by a shuffle.
MOST_STRATA = 10_000


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, BASE, n_capitals, n_marks and base_failed of every row."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    k = [f"_k{i}" for i in range(len(keep))]
    space = "\\x20\\x09-\\x0D"
    # Characters of a set: what is left without the runs of all others, which one match each takes.
    only = lambda kept: F.length(F.regexp_replace("t", f"[^{kept}]++", "")).cast("long")
    a = docs.select(*kept, F.coalesce("text", F.lit("")).alias("t"))
    a = a.select(
        *k,
        F.array_remove(F.split("t", f"[{space}]+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{space}]")).alias("lines"),
        (F.length("t") - only(space)).alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        only("A-Z").alias("n_capitals"),
        only("!?|").alias("n_marks"),
    )
    counts = ("word_chars", "n_symbols", "n_capitals", "n_marks")
    a = a.select(*k, *counts, "w", F.size("w").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # Only where a window's hash repeats: hashes whose low bits give way to the place, so that one sort of longs brings equal ones together.
    a = a.withColumn("h", F.expr("transform(if(n_words >= 3, sequence(0, int(n_words) - 3), array()), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"))
    a = a.withColumn("mask", F.expr("shiftleft(-1L, length(bin(n_words)))"))
    a = a.withColumn("p", F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> (x & mask) | bigint(i))), array())"))
    a = a.withColumn("near", F.expr("filter(p, (x, i) -> coalesce((get(p, i - 1) & mask) = (x & mask), false) or coalesce((get(p, i + 1) & mask) = (x & mask), false))"))
    # What may be equal is compared word by word.
    a = a.withColumn("g", F.expr("sort_array(transform(near, x -> struct(concat_ws(' ', w[int(x & ~mask)], w[int(x & ~mask) + 1], w[int(x & ~mask) + 2]) as g, int(x & ~mask) as i)))"))
    a = a.withColumn("at", F.expr("sort_array(transform(filter(g, (x, i) -> coalesce(get(g, i - 1).g = x.g, false) or coalesce(get(g, i + 1).g = x.g, false)), x -> x.i))"))
    a = a.withColumn("n_repeat_words", F.expr("aggregate(transform(at, (x, i) -> least(3, coalesce(get(at, i + 1) - x, 3))), 0L, (s, x) -> s + x)"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    return a.select(*(F.col(x).alias(c) for x, c in zip(k, keep)), *BASE, "n_capitals", "n_marks", failed)


def _log_gamma(x: str) -> str:
    """Stirling's series at x + 8, brought back by the recurrence."""
    y = f"({x} + 8)"
    back = " * ".join(f"({x} + {i})" for i in range(8))
    return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727D + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - ln({back}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(Binomial(n, p) <= k): terms from k downwards, as far as they can matter (k < n p)."""
    log_term = f"{_log_gamma(f'double({n} + 1)')} - {_log_gamma(f'double({k} + 1)')} - {_log_gamma(f'double({n} - {k} + 1)')} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D)"
    ratio = f"(i * (1 - {p}D)) / (({n} - i + 1) * {p}D)"
    steps = f"transform(sequence(0, int(least({k}, 50 + 12 * sqrt({n})))), j -> {k} - j)"
    total = f"aggregate({steps}, struct(1D as term, 0D as total), (a, i) -> struct(a.term * {ratio} as term, a.total + a.term as total), a -> a.total)"
    return f"least(1D, exp({log_term}) * {total})"


#: Which labelled documents propose cutoffs, in SQL: a quarter, by an order of ids that their own has no part in.
PROPOSES = "(doc_id % 1000003 + 1000003) % 1000003 * 7919 % 1000003 % 4 = 0"


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, a cutoff column per rule, null for none).  ``scored``: doc_id, stratum, features, base_failed."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    flags = [F.expr(f"coalesce({score} > {cut}D, false)").alias(f"{rule}_{i}") for rule, (score, grid) in RULES.items() for i, cut in enumerate(grid)]
    held = staged(scored.where("not base_failed").join(good, "doc_id").select(F.col(stratum).alias("_s"), F.expr(PROPOSES).alias("proposes"), *flags))
    sizes = staged(held.groupBy("_s").agg(F.count_if(~F.col("proposes")).alias("n")))
    n_strata = sizes.count()
    level = delta / (n_strata + 1)
    least = math.log(level) / math.log1p(-alpha)
    small = lambda df: F.broadcast(df) if n_strata <= MOST_STRATA else df
    groups = sizes.select("_s", F.when(F.col("n") < least, "pool").otherwise(F.to_json(F.struct("_s"))).alias("g"))
    held = held.withColumnRenamed("_s", "_h").join(small(groups), F.col("_h").eqNullSafe(F.col("_s")))
    # Per rule the strictest cutoff that rejects its share of what proposes; the grid's length for none.
    rare = lambda rule, i: F.count_if(F.col("proposes") & F.col(f"{rule}_{i}")) <= F.count_if("proposes") * (alpha / len(RULES))
    strictest = [F.coalesce(*(F.when((F.count_if("proposes") > 0) & rare(rule, i), i) for i in range(len(grid))), F.lit(len(grid))).alias(f"at_{rule}") for rule, (_, grid) in RULES.items()]
    proposed = staged(held.groupBy("g").agg(*strictest))
    notches = max(len(grid) for _, grid in RULES.values())
    rejects = lambda lax: F.expr(" or ".join(f"coalesce(get(array({', '.join(f'{rule}_{i}' for i in range(len(grid)))}), at_{rule} + {lax}), false)" for rule, (_, grid) in RULES.items()))
    tested = held.where("not proposes").join(small(proposed), "g").groupBy("g").agg(F.count("*").alias("n"), *(F.count_if(rejects(j)).alias(f"k_{j}") for j in range(notches)))
    # Rejections only grow along the sequence, so what comes before a certified test is certified.
    each = tested.select("g", "n", F.explode(F.array(*(F.struct(F.lit(j).alias("lax"), F.col(f"k_{j}").alias("k")) for j in range(notches)))).alias("x")).select("g", "n", "x.*")
    sure = each.where(F.expr(f"k < n * {alpha}D")).where(F.expr(f"{binomial_tail('k', 'n', alpha)} <= {level!r}D")).groupBy("g").agg(F.min("lax").alias("lax"))
    cuts = [F.expr(f"get(array({', '.join(f'{c}D' for c in grid)}), at_{rule} + lax)").alias(f"cut_{rule}") for rule, (_, grid) in RULES.items()]
    return groups.join(proposed.join(sure, "g"), "g").select(F.col("_s").alias(stratum), *cuts)


def judge(scored: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``scored`` (staged, as it is read twice) with ``kept``."""
    found = staged(cutoffs(scored, labels, stratum, alpha, delta))
    few = found.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    right = found.withColumnRenamed(stratum, "_stratum")
    joined = scored.join(F.broadcast(right) if few else right, scored[stratum].eqNullSafe(F.col("_stratum")), "left")
    passed = " and ".join(f"coalesce({score} <= cut_{rule}, true)" for rule, (score, _) in RULES.items())
    return joined.withColumn("kept", F.expr(f"not base_failed and ({passed})")).drop("_stratum", *(f"cut_{r}" for r in RULES))


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Per row: doc_id, stratum (its language), BASE, base_failed, kept."""
    scored = staged(features(docs, "doc_id", "lang").withColumnRenamed("lang", "stratum"))
    return judge(scored, labels, "stratum", alpha, delta).drop("n_capitals", "n_marks")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, whole."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text")
    scored = staged(features(whole, "row", "doc_id", "lang").withColumnRenamed("lang", "stratum"))
    return judge(scored, labels, "stratum", alpha, delta).where("kept").select("row.*")
