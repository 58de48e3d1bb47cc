"""Quality rules whose cutoffs are certified on labelled documents.

Everything here is DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from probeline.llm.common import stored

BLANKS = "[\\x20\\x09-\\x0D]"
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Rules: name -> (numerator, denominator, share of it in percent at which the rule has severity 100). The shares are
#: usual thresholds of such rules, set before any label is seen; only their proportions matter (fixed values).
RULES = {
    "symbols": ("n_symbols", "n_words", 10),
    "dup_lines": ("n_dup_lines", "n_lines", 30),
    "repeats": ("n_repeat_words", "n_words", 20),
    "capitals": ("n_capitals", "word_chars", 25),
}
TOP_SEVERITY = 10_000
#: Strata with too few labels are judged together as one.
POOL = "*"


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts of each text: words, their code points, symbols, lines that repeat an earlier one, words in
    repeated three-word windows, capitals. A null text has none of them.

    Windows are sorted by hash within the row, so equal ones stand side by side: n log n in a row, no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", text.alias("text"))
    lines = base.select(
        "doc_id",
        "lang",
        F.filter(F.split("text", f"{BLANKS}+"), lambda w: w != "").alias("words"),
        F.char_length(F.regexp_replace("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")))
        .cast("bigint")
        .alias("n_capitals"),
        F.filter(F.split("text", "\n"), lambda s: F.regexp_replace(s, BLANKS, "") != "").alias("lines"),
    )
    hashed = lines.select(
        "doc_id",
        "lang",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    window = lambda i: F.struct(
        F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("x"), i.alias("i")
    )
    positions = F.when(F.size("h") >= 3, F.sequence(F.lit(0), F.size("h") - 3)).otherwise(F.array().cast("array<int>"))
    ordered = hashed.select(*kept, F.sort_array(F.transform(positions, window)).alias("s"))
    same = lambda s, i, j: F.coalesce(F.get("s", j)["x"] == s["x"], F.lit(False))
    repeated = F.filter("s", lambda s, i: same(s, i, i - 1) | same(s, i, i + 1))
    found = ordered.select(*kept, F.sort_array(F.transform(repeated, lambda s: s["i"])).alias("p"))
    covered = F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(*kept, total.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def severity(rule: str) -> Column:
    """The feature in percent of the rule's share, rounded down, 0 to ``TOP_SEVERITY``."""
    above, below, share = RULES[rule]
    level = F.floor(10_000 * F.col(above) / (share * F.col(below)))
    return F.when(F.col(below) > 0, F.least(F.lit(TOP_SEVERITY), level)).otherwise(0)


def binomial_tail(n: Column, r: Column, rate: float) -> Column:
    """log P(X <= r) for X binomial(n, rate), summed term by term in log space."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(r >= 1, F.sequence(F.lit(1).cast("bigint"), r)).otherwise(F.array().cast("array<bigint>"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] + F.log((n - k + 1) / k) + odds
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.aggregate(steps, start, add, lambda state: state["total"])


def tested_strata(sizes: DataFrame, rate: float, error: float) -> DataFrame:
    """``stratum, judged_in, tests``: each stratum is judged in itself or, if too small for that, in the pool.

    With m strata of their own and the pool there are ``m + 1`` tests, each at ``error / (m + 1)``; m is the largest
    number whose m largest strata could all certify a cutoff that rejects none of their good documents. That
    depends on the strata's sizes alone, not on what their documents look like.
    """
    ranked = sizes.agg(F.sort_array(F.collect_list(F.struct("n", "stratum")), asc=False).alias("s")).select(
        F.posexplode("s").alias("k", "s")  # one entry per language
    )
    enough = F.col("s.n") * F.log(F.lit(1 - rate)) <= F.log(F.lit(error) / (F.col("k") + 2))
    own = ranked.agg(F.coalesce(F.max(F.when(enough, F.col("k") + 1)), F.lit(0)).alias("own"))
    judged_in = F.when(F.col("k") < F.col("own"), F.col("s.stratum")).otherwise(POOL)
    return ranked.crossJoin(F.broadcast(own)).select(  # one row
        "s.stratum", judged_in.alias("judged_in"), (F.col("own") + 1).alias("tests")
    )


def certified_cutoffs(counts: DataFrame, labels: DataFrame, false_rejection: float, error: float) -> DataFrame:
    """Lowest severity per stratum (``lang``, or the pool) at which rejecting is certified, as ``stratum, cutoff``.

    Labelled good documents that pass the base rules are the holdout. All rules act at one severity, so the
    rejection sets of falling severities form one sequence, fixed beforehand. The hypothesis at a severity is that
    good documents are rejected, by any rule, at a rate of ``false_rejection`` or more; it falls if the exact
    binomial probability of so few rejections is at most ``error / tests``. Testing goes from the most lenient
    severity downwards and stops at the first that stands, so with probability ``1 - error`` no stratum loses more
    than ``false_rejection`` of its good documents. Strata with too few labels share the pool's cutoff, which holds for
    the pool as a whole; a pool with too few labels gets none.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    held = counts.where(~base_failed()).join(good, "doc_id", "left_semi")
    level = F.greatest(*[severity(rule) for rule in RULES])
    bins = held.groupBy(F.coalesce("lang", F.lit("")).alias("stratum"), level.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    strata = tested_strata(bins.groupBy("stratum").agg(F.sum("n").alias("n")), false_rejection, error)
    sizes = (
        bins.join(F.broadcast(strata), "stratum")  # one row per language
        .groupBy(F.col("judged_in").alias("stratum"), "tests", "bin")
        .agg(F.sum("n").alias("n"))
        .groupBy("stratum", "tests")
        .agg(F.sum("n").alias("n_good"), F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
    )
    # each occupied severity plus one is a cutoff, which rejects the documents above it
    before = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("bigint").alias("r"), F.array().cast("array<struct<bin:bigint,r:bigint>>").alias("out")),
        lambda a, x: F.struct(
            (a["r"] + x["n"]).alias("r"),
            F.concat(a["out"], F.array(F.struct((x["bin"] + 1).alias("bin"), a["r"].alias("r")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    tests = sizes.select("stratum", "n_good", "tests", F.posexplode(before).alias("step", "t"))
    small = F.col("t.r") < F.col("n_good") * false_rejection
    judged = tests.select(
        "stratum",
        "step",
        F.col("t.bin").alias("bin"),
        F.when(
            small,
            binomial_tail(F.col("n_good"), F.col("t.r"), false_rejection) <= F.log(F.lit(error) / F.col("tests")),
        )
        .otherwise(F.lit(False))
        .alias("certified"),
    )
    stop = judged.groupBy("stratum").agg(F.min(F.when(~F.col("certified"), F.col("step"))).alias("stop"))
    passed = judged.join(stop, "stratum").where(F.col("stop").isNull() | (F.col("step") < F.col("stop")))
    return passed.groupBy("stratum").agg(F.min("bin").alias("cutoff"))


def risk_controlled_rules(
    docs: DataFrame, labels: DataFrame, false_rejection: float = 0.01, error: float = 0.05
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``failed_rules`` and ``kept``.

    A null or empty text has no words and fails the base rules; a null language is a stratum of its own. Repeated
    rows are judged one by one. Without labels only the base rules act. Other columns are ignored.
    """
    counts = stored(text_counts(docs), "text_counts")
    cutoffs = certified_cutoffs(counts, labels, false_rejection, error)
    pooled = cutoffs.agg(F.max(F.when(F.col("stratum") == POOL, F.col("cutoff"))).alias("pool_cutoff"))
    cutoff = F.coalesce("cutoff", "pool_cutoff")
    judged = (
        counts.withColumn("stratum", F.coalesce("lang", F.lit("")))
        .join(F.broadcast(cutoffs.where(F.col("stratum") != POOL)), "stratum", "left")  # one row per language
        .crossJoin(F.broadcast(pooled))  # one row
        .withColumn("failed_rules", F.array_compact(F.array(*[F.when(severity(r) >= cutoff, F.lit(r)) for r in RULES])))
        .withColumn("base_failed", base_failed())
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules",
    )
