"""Algebra of named sets: members are rows of a long table, attributes come from the first member set in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import EngineError


def compose(members: Sequence[tuple[str, DataFrame]], op: str, key: str, attributes: Sequence[str] = (), *, uniform: Sequence[str] = ()) -> DataFrame:
    """Union or intersection of named sets: key, attributes of the first member in order that has the key, sources (sorted array).

    Null and empty keys are dropped. Names form a set: a member listed twice counts once. `uniform` columns (such as
    species or release) must have one value over all members.
    """
    if op not in ("union", "intersection"):
        raise EngineError("compose", f"unknown operation: {op}")
    if not members:
        raise EngineError("compose", "no members")
    parts = []
    for i, (name, df) in enumerate(members):
        missing = [c for c in (key, *attributes, *uniform) if c not in df.columns]
        if missing:
            raise EngineError("compose", f"{name} lacks {', '.join(missing)}")
        parts.append(df.select(F.col(key), *(F.col(c) for c in dict.fromkeys((*attributes, *uniform)) if c != key), F.lit(name).alias("_set"), F.lit(i).alias("_ord")))
    rows = reduce(DataFrame.unionByName, parts).where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    for c in uniform:
        values = [r[0] for r in rows.select(c).distinct().limit(3).collect()]
        if len(values) > 1:
            raise EngineError("compose", f"mixed {c}: {', '.join(sorted(map(str, values)))}")
    kept = [c for c in attributes if c != key]
    first = F.min(F.struct("_ord", *kept)).alias("_first")
    out = rows.groupBy(key).agg(first, F.array_sort(F.collect_set("_set")).alias("sources"))
    if op == "intersection":
        out = out.where(F.size("sources") == len({n for n, _ in members}))
    return out.select(key, *(F.col(f"_first.{c}").alias(c) for c in kept), "sources")


def set_and(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def set_minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def is_subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).join(b.select(key), key, "left_anti").isEmpty()


def concat_rows(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def cross_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the parts in order, one per key: of the first part that has it, and of its rows the smallest."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("_ord", F.lit(i)) for i, p in enumerate(parts)))
    others = [c for c in parts[0].columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct("_ord", *others)).alias("_f")).select(key, *(F.col(f"_f.{c}").alias(c) for c in others))


def terms_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and status: a_only, b_only or shared."""
    tagged = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    both = tagged.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return both.select(key, F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), "shared").when(F.col("in_a") == 1, "a_only").otherwise("b_only").alias("status"))
