"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Base counts come from the whole text. On top, each rule compares one ratio with a cutoff of its stratum (language).
Cutoffs are learnt from labelled documents: of a fixed grid, from lenient to strict, a cutoff is certified while the
exact binomial test rejects "it rejects more than `risk` / rules of the good documents" at level `error` divided by
the number of (stratum, rule) tests. Within a rule, the fixed order needs no further correction; over rules and
strata, Bonferroni's holds. So with probability 1 - error, no stratum loses more than `risk` of its good documents.
Strata with so few good rows that not even a rule without a rejection could pass at the level of a lone stratum are
not tested, and count for no test.

Defined results: a null text is empty (no words, so base_failed); a null stratum is the empty one; a stratum in which
nothing can be certified rejects nothing by the learnt rules; a document that several label rows name is good if one
says so; no labels: only the base rules decide; repeated rows are each judged; an empty table gives an empty result;
columns beyond those named are ignored; of columns carried along, those with the name of a result give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NOT_SPACE, SPACE, Scratch

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where value > cutoff (or < cutoff, if below); grid: cutoffs from lenient to strict."""

    name: str
    value: str
    grid: tuple[float, ...]
    below: bool = False


def _grid(start: float, stop: float, n: int) -> tuple[float, ...]:
    return tuple(round(start + (stop - start) * i / (n - 1), 6) for i in range(n))


#: Ratios have a denominator of at least 1. The grids are fixed beforehand, as the test needs.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", _grid(0.6, 0.01, 60)),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", _grid(0.99, 0.1, 90)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", _grid(0.95, 0.1, 35)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _grid(0.95, 0.1, 35)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", _grid(40.0, 8.0, 65)),
    Rule("short_words", "word_chars / greatest(n_words, 1)", _grid(0.5, 3.0, 26), below=True),
)


def base_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (all long).

    A window of five words is compared by a 64-bit hash; only texts in which some hash occurs twice are sorted.
    """
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select(*keep, "t", F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    t = t.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z!]+", "")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= WINDOW + 1,
            F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))),
        ).alias("h"),
    )
    counts = COUNTS[:-1]
    t = t.select(*keep, *counts, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    twice = F.filter(
        F.transform("s", lambda e, k: F.when((e["x"] == F.get("s", k - 1)["x"]) | (e["x"] == F.get("s", k + 1)["x"]), e["i"])),
        lambda i: i.isNotNull(),
    )
    t = t.select(*keep, *counts, F.sort_array(twice).alias("p"))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), F.lit(0).cast("long"), lambda a, j: a + F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - F.get("p", j), F.lit(WINDOW))).cast("long"))
    return t.select(*keep, *counts, F.when(F.size("p") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


# ---------------------------------------------------------------- exact binomial tail


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1 to double precision: Stirling's series at x + 8, and the recurrence back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, 7))
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    return series - shift


def binomial_cdf(df: DataFrame, n: str, k: str, p: float, name: str) -> DataFrame:
    """df with P(Binomial(n, p) <= k): terms from k down, as many as can matter (40 standard deviations, 60 at least)."""
    nn, kk = F.col(n).cast("double"), F.col(k).cast("double")
    top = log_gamma(nn + 1) - log_gamma(kk + 1) - log_gamma(nn - kk + 1) + kk * F.log(F.lit(p)) + (nn - kk) * F.log(F.lit(1 - p))
    terms = F.least(F.col(k), F.ceil(40 * F.sqrt(nn * p * (1 - p)) + 60)).cast("int")
    step = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (kk - i) / (nn - kk + i + 1) * step).alias("term")),
    )["sum"]
    return df.withColumn(name, F.when(kk >= nn, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total)))


# ---------------------------------------------------------------- cutoffs


def least_good(risk: float, error: float, rules: int) -> int:
    """Good rows of a lone stratum with which a rule that rejects none of them is certified."""
    return math.ceil(math.log(error / rules) / math.log(1 - risk / rules))


def learn_cutoffs(counts: DataFrame, labels: DataFrame, risk: float, error: float, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """stratum, cutoffs: a map from rule to the strictest certified cutoff, for the strata that have any.

    counts: _id, _stratum and the counts. A row a stratum and rule after the first aggregation, however many documents.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))
    held = counts.join(good, counts["_id"] == good["good_id"], "left_semi")
    index = []
    for r in rules:
        grid = "array(" + ", ".join(f"{c}D" for c in r.grid) + ")"
        index.append(F.expr(f"struct('{r.name}' AS rule, size(filter({grid}, c -> {r.value} {'<' if r.below else '>'} c)) AS rejecting)"))
    per = held.select(F.col("_stratum").alias("stratum"), F.explode(F.array(*index)).alias("r")).groupBy("stratum", "r.rule", "r.rejecting").count()
    # a value that `rejecting` cutoffs reject is rejected by the strictest ones: positions from the end of the grid
    sizes = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(len(r.grid)))))
    grids = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.array(*(F.lit(c) for c in r.grid)))))
    total = per.groupBy("stratum", "rule").agg(F.sum("count").alias("n"), F.collect_list(F.struct("rejecting", "count")).alias("by"))
    total = total.where(F.col("n") >= least_good(risk, error, len(rules)))
    tests = total.agg(F.count_distinct("stratum").alias("strata")).withColumn("tests", F.col("strata") * len(rules)).select("tests")
    at = total.select("stratum", "rule", "n", "by", F.explode(F.sequence(F.lit(0), sizes[F.col("rule")] - 1)).alias("at"), sizes[F.col("rule")].alias("size"))
    k = F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + F.when(x["rejecting"] >= F.col("size") - F.col("at"), x["count"]).otherwise(0))
    p = binomial_cdf(at.select("stratum", "rule", "n", "at", k.alias("k")), "n", "k", risk / len(rules), "p").crossJoin(F.broadcast(tests))  # one row
    order = W.partitionBy("stratum", "rule").orderBy("at")
    passed = p.withColumn("worst", F.max("p").over(order)).where(F.col("worst") <= error / F.col("tests"))
    best = passed.groupBy("stratum", "rule").agg(F.max("at").alias("at")).select("stratum", F.struct("rule", grids[F.col("rule")][F.col("at")].alias("cutoff")).alias("e"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list("e")).alias("cutoffs"))


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, keep_columns: tuple[str, ...] = (), stratum: str = "lang", risk: float = 0.02, error: float = 0.05, min_words: int = 10, max_repeat: int = 20, few_strata: int = 10_000
) -> DataFrame:
    """doc_id, keep_columns, stratum, the counts, base_failed, failed_rule (the first rule that rejects, null if none), kept.

    keep_columns: columns of docs to carry along with the counts (the pipeline's, so that no join is needed).
    risk: the share of good documents a stratum may lose to the learnt rules; error: the chance that one loses more.
    few_strata: rows of the table of cutoffs up to which it is broadcast; a larger one is joined by shuffling.
    """
    scratch = Scratch(docs.sparkSession)
    results = ("stratum", *COUNTS, "base_failed", "failed_rule", "kept")
    held = [c for c in dict.fromkeys(("doc_id", *keep_columns)) if c not in results]
    key = F.concat(F.lit("="), F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("_stratum")
    named = docs.select(F.struct(*held).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), key)
    counts = scratch.write(base_counts(named, text="_text", keep=("_row", "_id", "_stratum")), "quality-counts")
    cutoffs = scratch.write(learn_cutoffs(counts, labels.select("doc_id", "quality"), risk, error), "cutoffs")
    if cutoffs.count() <= few_strata:
        cutoffs = F.broadcast(cutoffs)
    out = counts.join(cutoffs, counts["_stratum"] == cutoffs["stratum"], "left").drop("stratum")
    base = F.col("n_words").__lt__(min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    failed = F.when(F.col("n_words") < min_words, "few_words").when(100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"), "repetition")
    for r in RULES:
        cutoff = F.try_element_at("cutoffs", F.lit(r.name))
        failed = failed.when(F.expr(r.value) < cutoff if r.below else F.expr(r.value) > cutoff, r.name)
    out = out.withColumns({"base_failed": base, "failed_rule": failed, "stratum": F.substr("_stratum", F.lit(2))}).withColumn("kept", F.col("failed_rule").isNull())
    return out.select(*(F.col("_row")[c].alias(c) for c in held), *results)
