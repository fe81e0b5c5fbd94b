"""Statistics of distributions, matrices and schedules, as column expressions and aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import EngineError, total_rank


def finite(*columns: str) -> Column:
    """All of the columns are numbers: not null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Distances from k / n down to and up to the ends of the score interval, not negative; (0, 0) if n is 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    side = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), x)).otherwise(F.lit(0.0))
    return side(p - (mid - half)), side((mid + half) - p)


def grand_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: mean and median of the finite values."""
    return df.where(finite(value)).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def box_stats(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """group, n, q1, median, q3, low, high: whiskers are the extreme data within `reach` interquartile ranges of the box."""
    rows = df.where(finite(value))
    q = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(group, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    whiskers = rows.join(q, group).groupBy(group).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))
    # a whisker never ends inside the box
    return q.join(whiskers, group).select(group, "n", "q1", "median", "q3", F.least("low", "q1").alias("low"), F.greatest("high", "q3").alias("high"))


def auto_bins(df: DataFrame, value: str) -> int:
    """The larger of Sturges' and Freedman and Diaconis' number of bins."""
    r = df.where(finite(value)).agg(F.count("*"), F.min(value), F.max(value), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))).first()
    n, lo, hi, q = r
    if not n or lo == hi:
        return 1
    sturges = (hi - lo) / (math.log2(n) + 1)
    fd = 2 * (q[1] - q[0]) / n ** (1 / 3)
    width = min(sturges, fd) if fd else sturges
    return max(1, math.ceil((hi - lo) / width))


def histogram(df: DataFrame, group: str, value: str, bins: int | None = None) -> DataFrame:
    """group, bin (from 0), left, right, count, density over shared edges; bins without rows are absent; the last is closed."""
    rows = df.where(finite(value))
    bins = bins or auto_bins(rows, value)
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("_w", width)
    placed = placed.withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(group, "bin").agg(F.count("*").alias("count"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    total = F.sum("count").over(W.partitionBy(group))
    left = F.col("_lo") + F.col("bin") * F.col("_w")
    return counts.select(group, "bin", left.alias("left"), (left + F.col("_w")).alias("right"), "count", (F.col("count") / (total * F.col("_w"))).alias("density"))


def kde(df: DataFrame, group: str, value: str, *, points: int = 512, lower: float | None = None, upper: float | None = None, scale_by_copies: bool = True) -> DataFrame:
    """group, x, density: Gaussian kernels with Scott's bandwidth on a grid of the group's range +- 3 deviations, or the bounds.

    At a bound the sample is reflected, densities are multiplied by the number of copies (by 2 if scale_by_copies is
    off), and are 0 beyond. Values are counted first, so equal values cost one kernel; kernels are added up where the
    values are.
    """
    rows = df.where(finite(value)).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_x"))
    copies = [F.col("_x")] + ([2 * F.lit(lower) - F.col("_x")] if lower is not None else []) + ([2 * F.lit(upper) - F.col("_x")] if upper is not None else [])
    reflected = rows.select("_g", F.explode(F.array(*copies)).alias("_x"))
    s = reflected.groupBy("_g").agg(F.count("*").alias("_n"), F.stddev_samp("_x").alias("_sd")).where("_n > 1 AND _sd > 0")
    ends = rows.groupBy("_g").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.stddev_samp("_x").alias("_s0"))
    s = s.join(ends, "_g").withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    lo = F.lit(lower) if lower is not None else F.col("_lo") - 3 * F.col("_s0")
    hi = F.lit(upper) if upper is not None else F.col("_hi") + 3 * F.col("_s0")
    weighted = reflected.groupBy("_g", "_x").agg(F.count("*").alias("_c"))
    # each partition adds its values' kernels onto the grids of its groups: points rows a group and partition move on
    parts = weighted.join(s.select("_g", "_h", lo.alias("_from"), hi.alias("_to")), "_g")
    group_type = dict(weighted.dtypes)["_g"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for key, rows in b.groupby("_g", dropna=False):
                h, start, end = rows["_h"].iloc[0], rows["_from"].iloc[0], rows["_to"].iloc[0]
                x = start + np.arange(points) * (end - start) / (points - 1)
                got = sums.setdefault(key, np.zeros(points))
                for at in range(0, len(rows), 1000):
                    value, copies = rows["_x"].to_numpy()[at : at + 1000], rows["_c"].to_numpy()[at : at + 1000]
                    got += copies @ np.exp(-0.5 * ((x[None, :] - value[:, None]) / h) ** 2)
        for key, got in sums.items():
            yield pd.DataFrame({"_g": [key] * points, "_k": np.arange(points), "_s": got})

    added = parts.select("_g", "_x", "_c", "_h", "_from", "_to").mapInPandas(partial, f"_g {group_type}, _k int, _s double").groupBy("_g", "_k").agg(F.sum("_s").alias("_s"))
    factor = (len(copies) if scale_by_copies else 2) if len(copies) > 1 else 1
    d = added.join(s.select("_g", "_n", "_h", lo.alias("_from"), hi.alias("_to")), "_g").withColumn("x", F.col("_from") + F.col("_k") * (F.col("_to") - F.col("_from")) / (points - 1))
    return d.select(F.col("_g").alias(group), "x", (factor * F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def hexbin(df: DataFrame, x: str, y: str, width: int = 40) -> DataFrame:
    """hx, hy, count over hexagons, `width` along x: each point goes to the nearer of two staggered grids' centres."""
    rows = df.where(finite(x, y))
    e = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    u = (F.col(x) - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-12)) * width
    ny = max(1, int(width / math.sqrt(3)))
    v = (F.col(y) - F.col("y0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-12)) * ny
    p = rows.crossJoin(F.broadcast(e)).select(u.alias("u"), v.alias("v"))
    d1 = F.pow(F.col("u") - F.round("u"), 2) + 3 * F.pow(F.col("v") - F.round("v"), 2)
    d2 = F.pow(F.col("u") - F.floor("u") - 0.5, 2) + 3 * F.pow(F.col("v") - F.floor("v") - 0.5, 2)
    hx = F.when(d1 < d2, F.round("u")).otherwise(F.floor("u") + 0.5)
    hy = F.when(d1 < d2, F.round("v")).otherwise(F.floor("v") + 0.5)
    return p.select(hx.alias("hx"), hy.alias("hy")).groupBy("hx", "hy").agg(F.count("*").alias("count"))


def zscore_clip(df: DataFrame, row: str | Sequence[str], value: str, name: str = "z", limit: float = 3.0) -> DataFrame:
    """df with the value's z-score in its row (sample deviation; null if it is 0), clipped."""
    w = W.partitionBy(*([row] if isinstance(row, str) else row))
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    return df.withColumn("_z", z).withColumn(name, F.when(F.col("_z").isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("_z"))))).drop("_z")


def mask_diagonal(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    return df.withColumn(value, F.when(F.col(row) != F.col(col), F.col(value)))


def clip_small_negative(df: DataFrame, value: str, least: float = -0.1) -> DataFrame:
    """Negative values become 0 if none is below `least`; else nothing changes."""
    low = F.broadcast(df.agg(F.min(value).alias("_low")))
    return df.crossJoin(low).withColumn(value, F.when((F.col("_low") >= least) & (F.col(value) < 0), F.lit(0.0)).otherwise(F.col(value))).drop("_low")


def log_transform(df: DataFrame, value: str, kind: str = "auto", pseudocount: float = 1.0, name: str | None = None) -> DataFrame:
    """log2 or log10 of value + pseudocount (null where that isn't positive); auto: log10 if the largest exceeds 1000; none if nothing is positive."""
    name = name or value
    if kind in ("log2", "log10"):
        return df.withColumn(name, (F.log2 if kind == "log2" else F.log10)(F.col(value) + pseudocount))
    if kind != "auto":
        raise EngineError("log_transform", f"unknown kind: {kind}")
    top = F.broadcast(df.where(finite(value)).agg(F.max(value).alias("_top")))
    return df.crossJoin(top).withColumn(name, F.when(F.col("_top") > 1000, F.log10(F.col(value) + pseudocount)).otherwise(F.col(value))).drop("_top")


def suggest_log(df: DataFrame, value: str, ratio: float = 100.0) -> DataFrame:
    """One row: whether the largest positive value exceeds the smallest by the ratio."""
    rows = df.where(finite(value) & (F.col(value) > 0))
    return rows.agg(F.coalesce(F.max(value) / F.min(value) > ratio, F.lit(False)).alias("suggest_log"))


def schedule_variance(plan_start: Column, plan_end: Column, done_end: Column, today: Column, tolerance: float = 0.0) -> Column:
    """complete, not_started, overdue, behind, ahead or on_track, from numbers on one time axis; a null done_end is the start."""
    done = F.coalesce(done_end, plan_start)
    return (
        F.when(done >= plan_end, "complete")
        .when(today < plan_start, "not_started")
        .when(today > plan_end, "overdue")
        .when(done < today - tolerance, "behind")
        .when(done > today + tolerance, "ahead")
        .otherwise("on_track")
    )


def status_change(before: DataFrame, after: DataFrame, key: str, status: str, ranks: Sequence[str]) -> DataFrame:
    """key, change: promotion or regression by the order of ranks; equal and unknown ones are unchanged; only keys in both."""
    at = F.create_map(*(x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))))
    both = before.select(key, at[F.col(status)].alias("a")).join(after.select(key, at[F.col(status)].alias("b")), key)
    return both.select(key, F.when(F.col("b") > F.col("a"), "promotion").when(F.col("b") < F.col("a"), "regression").otherwise("unchanged").alias("change"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("count"))


def group_collect(df: DataFrame, by: str | Sequence[str], value: str, name: str = "values", sep: str | None = None) -> DataFrame:
    """by, sorted distinct values (joined, if sep is given) and their number n."""
    values = F.array_sort(F.collect_set(value))
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg((F.array_join(values, sep) if sep is not None else values).alias(name), F.size(values).alias("n"))


def top_terms(results: DataFrame, *, database: str = "database", term: str = "term", order: Sequence[Column | str] = ("rank",)) -> DataFrame:
    """A row for each database with results: total_terms and top_term, the first by the order (ties by term)."""
    first = F.min_by(term, F.struct(*order, F.col(term)))
    return results.groupBy(database).agg(F.count("*").alias("total_terms"), first.alias("top_term"))


def group_order(df: DataFrame, group: str, order: Sequence[object] | None = None, *, by: str = "ordinal") -> DataFrame:
    """group and its position from 0: by first appearance (the least of `by`), or as listed; then groups that aren't in df have found = false."""
    if order is None:
        seen = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(by).alias("_first"))
        return total_rank(seen, [F.asc("_first"), F.asc(group)], "_rank").select(group, (F.col("_rank") - 1).alias("position"), F.lit(True).alias("found"))
    listed = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(order)], f"{group} {dict(df.dtypes)[group]}, position long")
    present = df.select(group).distinct().withColumn("_here", F.lit(True))
    return listed.join(present, group, "left").select(group, "position", F.coalesce("_here", F.lit(False)).alias("found"))


def topk(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """The first k rows by a total order, of all or of each group."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
