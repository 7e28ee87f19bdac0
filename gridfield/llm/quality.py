"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose metric is over a cutoff.  The rules are tightened together along a fixed grid of steps, so
every labelled document is a holdout, and a stratum (language) needs one test a step, not one a rule.  A step is certified if,
were the stratum's true rate of false rejection by any rule over ``risk``, so few rejected documents among its good ones would
have had a chance of ``level / strata`` at most: an exact binomial tail, Bonferroni-corrected.  Steps are tested from the most
lenient on, and testing stops at the first that fails (a fixed sequence needs no further correction); the last certified one
is used.  So with probability 1 - level no stratum loses over ``risk`` of its good documents to the rules.  A stratum with too
few good labels (under 173 of four strata) certifies nothing and its documents are kept, but for the base rules.

Plan.  One pass over the texts makes a narrow table of counts; labels join that; of a stratum only a dozen counts are gathered.
The certified steps, a row a stratum, are broadcast up to ``MAX_STRATA`` of them, and joined by stratum beyond.

Cases.  Null or blank text: zero counts, fails the base rules.  Null language: a stratum.  Null doc_id, rows that repeat
one: each row is judged; a label counts for each row.  Repeated labels: good only if all say so; null labels are none.
Ties with a cutoff are kept.  Very long texts: whole, as arrays of their words.  Extra columns, whatever their names, aren't
carried.  Empty table or no labels: nothing is certified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfield.llm.runtime import SPACES, Scratch

#: Rules and their cutoffs by step, the most lenient first.
GRIDS = {
    "symbol_share": (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05),
    "duplicate_line_share": (0.95, 0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35),
    "repeat_word_share": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.35),
    "capital_share": (0.95, 0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35),
    "exclamation_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
}
STEPS = 11
RISK, LEVEL, MAX_STRATA = 0.025, 0.05, 100_000


def counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    left = lambda pattern: F.char_length(F.regexp_replace("text", pattern, "")).cast("long")
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{stratum_column}`").cast("string").alias("stratum"), text.alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", SPACES), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    sorted_ = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))
    base = base.withColumn("n", n).withColumn("w", sorted_)
    # a window is repeated if a neighbour in hash order equals it; starts of repeated windows, in order
    same = lambda x, j: F.get("w", j - 1)["h"].eqNullSafe(x["h"]) | F.get("w", j + 1)["h"].eqNullSafe(x["h"])
    starts = F.sort_array(F.transform(F.filter("w", same), lambda x: x["i"]))
    base = base.withColumn("s", starts)
    # each start covers three words, or as many as stand before the next start
    covered = F.aggregate(F.transform("s", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("s", j + 1), F.lit(1 << 30)) - x)), F.lit(0), lambda a, x: a + x)
    return base.select(
        "doc_id",
        "stratum",
        F.col("n").cast("long").alias("n_words"),
        left(SPACES).alias("word_chars"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        left("[^A-Z]+").alias("n_capitals"),
        left("[^!]+").alias("n_marks"),
    )


def metrics() -> dict[str, F.Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_share": share("n_symbols", "word_chars"), "duplicate_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words"), "capital_share": share("n_capitals", "word_chars"), "exclamation_share": share("n_marks", "n_words") / 5}


def binomial_tail(k, n, p: float) -> F.Column:
    """P(X <= k) for X of n trials with chance p, exactly; 1 where k is over the mean, which no test needs."""
    import math

    odds = math.log(p) - math.log1p(-p)
    first = F.struct((n * math.log1p(-p)).cast("double").alias("t"), (n * math.log1p(-p)).cast("double").alias("s"))

    def add(a, j):
        t = a["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (F.greatest(a["s"], t) + F.log1p(F.exp(-F.abs(a["s"] - t)))).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * p, 1.0).otherwise(F.exp(F.aggregate(steps, first, add, lambda a: a["s"])))


def rejected_from() -> F.Column:
    """The first step that rejects a document by any rule; STEPS: none."""
    def over(rule: str, metric: F.Column) -> F.Column:
        return F.size(F.filter(F.array(*(F.lit(c) for c in GRIDS[rule])), lambda cutoff: metric > cutoff))

    return F.lit(STEPS) - F.greatest(*(over(r, x) for r, x in metrics().items()))


def certified(held: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """held: stratum and rejected_from of good labelled documents -> stratum and the last certified step, where there is one."""
    counts = held.groupBy("stratum", "rejected_from").agg(F.count("*").alias("n"))
    strata = max(1, counts.select("stratum").distinct().count())
    each = counts.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("rejected_from", "n")).alias("each"))  # STEPS + 1 at most
    k = F.aggregate(F.filter("each", lambda e: e["rejected_from"] <= F.col("step")), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    tested = each.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).select("stratum", "step", "n", k.alias("k"))
    passed = binomial_tail(F.col("k"), F.col("n"), risk) <= level / strata
    failed = F.sum(F.when(passed, 0).otherwise(1)).over(Window.partitionBy("stratum").orderBy("step"))
    return tested.withColumn("failed", failed).where("failed = 0").groupBy("stratum").agg(F.max("step").alias("step"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """counts, base_failed and kept, a row a document."""
    scratch = Scratch(docs.sparkSession, "quality")
    seen = scratch.save(counts(docs, id_column, text_column, stratum_column).withColumn("rejected_from", rejected_from()), "counts")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").alias("good_id"))
    fails = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    held = seen.where(~fails).join(good, F.col("doc_id") == F.col("good_id")).select("stratum", "rejected_from")
    steps = scratch.save(certified(held, risk, level), "steps").withColumnRenamed("stratum", "of_stratum")
    if steps.count() <= MAX_STRATA:
        steps = F.broadcast(steps)
    out = seen.join(steps, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left").withColumn("base_failed", fails)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("rejected_from") > F.col("step"), F.lit(True)))
