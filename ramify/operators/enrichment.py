"""Enrichment statistics over long tables of set members: multifunctionality, ORA, average precision, permutation nulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import EngineError, before_partitions, cut_lineage, in_order, total_rank


def mf_score(facts: DataFrame, *, entity: str, term: str) -> DataFrame:
    """entity, n_annotations, mf_score: the sum over its terms of 1 / (n (N - n)); n entities have the term, of N.

    Facts are (entity, term), propagated if they shall be; a term that all entities have weighs nothing.
    """
    facts = facts.select(entity, term).distinct()
    total = facts.agg(F.count_distinct(entity).alias("_total"))
    per_term = facts.groupBy(term).agg(F.count("*").alias("n"))
    weights = per_term.crossJoin(F.broadcast(total)).select(term, F.when((F.col("n") >= 1) & (F.col("n") < F.col("_total")), 1.0 / (F.col("n") * (F.col("_total") - F.col("n")))).otherwise(0.0).alias("w"))
    return facts.join(weights, term).groupBy(entity).agg(F.count("*").alias("n_annotations"), F.sum("w").alias("mf_score"))


def mf_rank(scores: DataFrame, *, entity: str, score: str = "mf_score", places: int = 12) -> DataFrame:
    """scores with mf_rank (1 is highest; ties by entity) and mf_percentile = (N - rank + 1) / N. Scores compare rounded, as sums have no order."""
    ranked = total_rank(scores.withColumn("_s", F.round(score, places)), [F.desc("_s"), F.asc(entity)], "mf_rank").drop("_s")
    n = ranked.count()
    if n < 2:
        raise EngineError("mf_rank", "it takes two entities or more")
    return ranked.withColumn("mf_percentile", (F.lit(n) - F.col("mf_rank") + 1) / F.lit(n))


def bh_qvalues(df: DataFrame, p: str = "pvalue", q: str = "qvalue", by: tuple[str, ...] = (), *, few: bool = False) -> DataFrame:
    """df with Benjamini-Hochberg q-values: over ranks from the largest p down, the running minimum of p m / rank, at most 1.

    Distinct p-values are ranked, not rows, and rows get theirs by a join. They are ranked over range partitions; where
    there are few (a row a set), or in each group of `by`, by one window. Null p-values have null q-values.
    """
    key = [*by, "_p"]
    rows = df.withColumn("_p", F.col(p))
    steps = rows.where("_p IS NOT NULL").groupBy(*key).agg(F.count("*").alias("_n"))
    if by or few:
        w = W.partitionBy(*by).orderBy("_p")
        steps = steps.withColumn("_rank", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_m", F.sum("_n").over(W.partitionBy(*by)))
        steps = steps.withColumn(q, F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(w.rowsBetween(0, W.unboundedFollowing)))).select(*key, q)
        return rows.join(steps, key, "left").drop("_p")
    parted = in_order(steps, [F.asc("_p")])
    m = parted.agg(F.sum("_n")).first()[0] or 0
    w = W.partitionBy("_pid").orderBy("_row")
    placed = parted.join(F.broadcast(before_partitions(parted, F.col("_n"))), "_pid")
    placed = placed.withColumn("_rank", F.col("_before") + F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("_least", F.min(F.col("_p") * m / F.col("_rank")).over(w.rowsBetween(0, W.unboundedFollowing)))
    # the least value of later partitions: one row a partition
    later = placed.groupBy("_pid").agg(F.min("_least").alias("_own"))
    later = later.select("_pid", F.min("_own").over(W.orderBy("_pid").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    steps = placed.join(F.broadcast(later), "_pid").select("_p", F.least(F.lit(1.0), "_least", "_later").alias(q))
    return rows.join(steps, "_p", "left").drop("_p")


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def _log_gamma(x: Column) -> Column:
    """ln Gamma of x >= 1: Stirling's series at x + 7 and the recurrence back, to double precision."""
    y = x + 7
    s = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    for i in range(7):
        s = s - F.log(x + i)
    return s


def _log_choose(n: Column, k: Column) -> Column:
    return _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)


def hypergeom_sf(N: Column, K: Column, n: Column, k: Column) -> Column:
    """P(X >= k) for k of n draws among N with K marked; 1 if k, K or n is not positive.

    One log-probability at max(k, n - (N - K)), and then the terms by their ratios, all in one expression.
    """
    N, K, n = (c.cast("double") for c in (N, K, n))
    start = F.greatest(k.cast("double"), n - (N - K))
    stop = F.least(K, n)
    first = _log_choose(K, start) + _log_choose(N - K, n - start) - _log_choose(N, n)
    total = F.aggregate(
        F.sequence(start.cast("long"), F.greatest(start, stop).cast("long")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, x: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (K - x) * (n - x) / ((x + 1.0) * (N - K - n + x + 1.0))).alias("term")),
    )["sum"]
    p = F.when(start > stop, 0.0).otherwise(F.least(F.lit(1.0), F.exp(first) * total))
    return F.when((k <= 0) | (K <= 0) | (n <= 0), 1.0).otherwise(p)


def ora(
    sets: DataFrame, hits: DataFrame, background: DataFrame, *, set_col: str = "set_id", member: str = "member", name_col: str | None = None, min_size: int = 5, max_size: int = 200, mf: DataFrame | None = None
) -> DataFrame:
    """Over-representation of hits in each set, all restricted to the background; sets of min_size to max_size restricted members.

    Columns: set_id, set_name (if any), set_size, set_size_after_filter, n_hits_in_set, expected_hits, fold_enrichment,
    pvalue, qvalue; with mf (member, mf_percentile) also mf_baseline_n_hits_in_set, mf_baseline_pvalue and
    mf_baseline_qvalue, for the top n members of the background by percentile, n being the number of hits.
    Hits and background are marks on the members, so that sets are joined once.
    """
    bg = background.select(F.col(member).alias("m")).where("m IS NOT NULL").distinct()
    marked = bg.join(hits.select(F.col(member).alias("m")).distinct().withColumn("hit", F.lit(1)), "m", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    counts = marked.agg(F.count("*").alias("_total"), F.sum("hit").alias("n"))
    if mf is not None:
        ranked = mf.select(F.col(member).alias("m"), "mf_percentile").groupBy("m").agg(F.max("mf_percentile").alias("mf_percentile")).join(bg, "m", "left_semi")
        ranked = total_rank(ranked, [F.desc("mf_percentile"), F.asc("m")], "_rank").select("m", "_rank")
        marked = marked.join(ranked, "m", "left").crossJoin(F.broadcast(counts.select("n"))).withColumn("top", F.coalesce((F.col("_rank") <= F.col("n")).cast("int"), F.lit(0))).drop("_rank", "n")
        marked = cut_lineage(marked)  # read for the totals and for the sets
        counts = marked.agg(F.count("*").alias("_total"), F.sum("hit").alias("n"), F.sum("top").alias("n_top"))
    else:
        marked = marked.withColumn("top", F.lit(0))
    names = [name_col] if name_col else []
    long = sets.select(F.col(set_col).alias("set_id"), *names, F.col(member).alias("m")).distinct()
    per = long.join(marked, "m", "left").groupBy("set_id", *names).agg(
        F.count("*").alias("set_size"), F.count("hit").alias("set_size_after_filter"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hits_in_set"), F.coalesce(F.sum("top"), F.lit(0)).alias("n_top_in_set")
    )
    per = per.where(F.col("set_size_after_filter").between(min_size, max_size)).crossJoin(F.broadcast(counts))
    K = F.col("set_size_after_filter")
    expected = K * F.col("n") / F.col("_total")
    out = per.withColumns({
        "expected_hits": expected,
        "fold_enrichment": F.when(expected > 0, F.col("n_hits_in_set") / expected),
        "pvalue": hypergeom_sf(F.col("_total"), K, F.col("n"), F.col("n_hits_in_set")),
    })
    cols = ["set_id", *names, "set_size", "set_size_after_filter", "n_hits_in_set", "expected_hits", "fold_enrichment", "pvalue", "qvalue"]
    if mf is not None:
        out = out.withColumn("mf_baseline_n_hits_in_set", F.col("n_top_in_set")).withColumn("mf_baseline_pvalue", hypergeom_sf(F.col("_total"), K, F.col("n_top"), F.col("n_top_in_set")))
        out = bh_qvalues(out, "mf_baseline_pvalue", "mf_baseline_qvalue", few=True)
        cols += ["mf_baseline_n_hits_in_set", "mf_baseline_pvalue", "mf_baseline_qvalue"]
    out = bh_qvalues(out, "pvalue", "qvalue", few=True).select(*cols)
    return (out.withColumnRenamed(name_col, "set_name") if name_col else out).orderBy("pvalue", "set_id")


def mf_baseline_hits(mf: DataFrame, background: DataFrame, n: int, *, member: str = "member") -> DataFrame:
    """The n members of the background with the highest percentile; ties by member."""
    return mf.join(background.select(member).distinct(), member, "left_semi").groupBy(member).agg(F.max("mf_percentile").alias("mf_percentile")).orderBy(F.desc("mf_percentile"), member).limit(n).select(member)


def rank_entities(scores: DataFrame, *, entity: str, score: str, ascending: bool = False) -> DataFrame:
    """entity, rank from 1: by score, ties by entity; rows without a key or a finite score are dropped, of a repeated key its best score counts."""
    s = F.col(score).cast("double")
    rows = scores.where(F.col(entity).isNotNull() & s.isNotNull() & ~F.isnan(s)).groupBy(entity).agg((F.min(s) if ascending else F.max(s)).alias("_s"))
    return total_rank(rows, [F.asc("_s") if ascending else F.desc("_s"), F.asc(entity)], "rank").select(entity, "rank")


def average_precision(ranks: DataFrame, sets: DataFrame, *, member: str = "member", set_col: str = "set_id") -> DataFrame:
    """set_id, n_members, pr_auc: the mean over a set's ranked members of (members so far) / rank."""
    joined = sets.select(set_col, member).distinct().join(ranks.select(member, "rank"), member)
    seen = F.row_number().over(W.partitionBy(set_col).orderBy("rank"))
    return joined.withColumn("_p", seen / F.col("rank")).groupBy(set_col).agg(F.count("*").alias("n_members"), F.avg("_p").alias("pr_auc"))


def _null_draws(n: int, size: int, seed: int, chunk: int, draws: int) -> np.ndarray:
    """Average precision of `draws` random sets of a size among n ranks.

    Each rank is marked with one chance, a little above size / n, by geometric gaps over many sets of ranks in a row. By
    their number alone, sets with fewer marks are drawn again and of others random marks are taken away, so that all
    sets of the size are equally likely. The work is in proportion to the members of the sets.
    """
    rng = np.random.default_rng((seed, size, chunk))
    chance = min(1.0, (size + 2 * np.sqrt(size)) / n)
    scale = -1 / np.log1p(-chance) if chance < 1 else 0.0
    nth, out, left = np.arange(1, size + 1), [], draws
    while left:
        m = min(left + left // 8 + 1, max(1, 200_000 // size))
        # marks from 1 to m n; gaps are drawn until they reach that far
        marks, reached = [], 0
        while reached < m * n:
            more = int((m * n - reached) * chance * 1.01) + 100
            gaps = (rng.standard_exponential(more) * scale).astype(np.int64)
            gaps += 1
            gaps[0] += reached
            marks.append(np.cumsum(gaps, out=gaps))
            reached = int(gaps[-1])
        at = np.concatenate(marks)
        ends = np.searchsorted(at, np.arange(1, m + 1) * n, "right")
        starts = np.concatenate(([0], ends[:-1]))
        found = ends - starts
        good = np.flatnonzero(found >= size)[:left]
        wanted = np.zeros(m, bool)
        wanted[good] = True
        keep = np.repeat(wanted, found)
        todo = found[good] - size
        while (short := np.repeat(np.arange(len(good)), todo)).size:
            pick = np.unique(starts[good][short] + rng.integers(0, found[good][short]))
            pick = pick[keep[pick]]
            keep[pick] = False
            todo -= np.bincount(np.searchsorted(starts[good], pick, "right") - 1, minlength=len(good))
        ranks = at[: len(keep)][keep].reshape(-1, size) - good[:, None] * n
        out.append((nth / ranks).mean(1))
        left -= len(good)
    return np.concatenate(out) if out else np.zeros(0)


def permutation_null(sizes: DataFrame, n_ranked: int, *, permutations: int = 10_000, seed: int = 0, chunk: int = 250, size_col: str = "size") -> DataFrame:
    """size, chunk, null (array of doubles) for each distinct size: the null depends on the size alone, and each chunk of
    draws has a seed of its own, so chunks run on different executors and repeat exactly."""
    chunks = -(-permutations // chunk)
    jobs = sizes.select(F.col(size_col).cast("int").alias("size")).where(f"size > 0 AND size <= {n_ranked}").distinct()
    # a stated number of tasks: rows this narrow would else be gathered in one
    tasks = max(4 * sizes.sparkSession.sparkContext.defaultParallelism, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    jobs = jobs.select("size", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).repartition(tasks, "size", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"size": b["size"], "chunk": b["chunk"], "null": [_null_draws(n_ranked, int(s), seed, int(c), min(chunk, permutations - int(c) * chunk)) for s, c in zip(b["size"], b["chunk"], strict=True)]})

    return jobs.mapInPandas(run, "size int, chunk int, null array<double>")


def empirical_p(observed: DataFrame, null: DataFrame, *, value: str, size: str, name: str, permutations: int, key: str = "set_id") -> DataFrame:
    """key, name: (draws of the same size that are >= the value, + 1) / (permutations + 1)."""
    above = F.size(F.filter("null", lambda x: x >= F.col("_v")))
    joined = observed.select(key, F.col(size).cast("int").alias("size"), F.col(value).alias("_v")).join(null, "size").select(key, above.alias("_a"))
    return joined.groupBy(key).agg(((F.sum("_a") + 1) / F.lit(permutations + 1)).alias(name))


def pr_enrichment(
    scores: DataFrame, sets: DataFrame, background: DataFrame | None = None, *, entity: str = "member", score: str = "score", set_col: str = "set_id", ascending: bool = False,
    min_size: int = 5, max_size: int = 200, permutations: int = 10_000, seed: int = 0, mf: DataFrame | None = None,
) -> DataFrame:
    """Average-precision enrichment: set_id, set_size, set_size_after_filter, n_genes_in_input, pr_auc, pvalue, qvalue; with
    mf (entity, mf_percentile) also mf_pr_auc, mf_corrected_pvalue and mf_corrected_qvalue.

    The corrected statistic is pr_auc - (mf_pr_auc - mean of the null). Entities without a percentile rank last.
    """
    if background is not None:
        scores = scores.join(background.select(entity).distinct(), entity, "left_semi")
    ranks = rank_entities(scores, entity=entity, score=score, ascending=ascending)
    n = ranks.count()
    sized = sets.select(F.col(set_col).alias("set_id"), entity).distinct()
    full = sized.groupBy("set_id").agg(F.count("*").alias("set_size"))
    auc = average_precision(ranks, sized, member=entity).where(F.col("n_members").between(min_size, max_size))
    out = full.join(auc, "set_id").withColumnRenamed("n_members", "set_size_after_filter").withColumn("n_genes_in_input", F.lit(n).cast("long"))
    out = cut_lineage(out)
    null = cut_lineage(permutation_null(out.select(F.col("set_size_after_filter").alias("size")), n, permutations=permutations, seed=seed))
    out = bh_qvalues(out.join(empirical_p(out, null, value="pr_auc", size="set_size_after_filter", name="pvalue", permutations=permutations), "set_id"), few=True)
    if mf is not None:
        best = mf.select(entity, "mf_percentile").groupBy(entity).agg(F.max("mf_percentile").alias("_pc"))
        by_mf = rank_entities(ranks.join(best, entity, "left").withColumn("_pc", F.coalesce("_pc", F.lit(-1.0))), entity=entity, score="_pc")
        mf_auc = average_precision(by_mf, sized, member=entity).select("set_id", F.col("pr_auc").alias("mf_pr_auc"))
        means = null.groupBy("size").agg((F.sum(F.aggregate("null", F.lit(0.0), lambda a, x: a + x)) / permutations).alias("_mean"))
        out = out.join(mf_auc, "set_id").join(means, out["set_size_after_filter"] == means["size"]).drop("size")
        out = out.withColumn("_obs", F.col("pr_auc") - (F.col("mf_pr_auc") - F.col("_mean"))).drop("_mean")
        corrected = empirical_p(out, null, value="_obs", size="set_size_after_filter", name="mf_corrected_pvalue", permutations=permutations)
        out = bh_qvalues(out.join(corrected, "set_id").drop("_obs"), "mf_corrected_pvalue", "mf_corrected_qvalue", few=True)
    first = ["set_id", "set_size", "set_size_after_filter", "n_genes_in_input", "pr_auc", "pvalue", "qvalue"]
    return out.select(*first, *(c for c in out.columns if c not in first)).orderBy("pvalue", "set_id")
