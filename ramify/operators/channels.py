"""Dataflow verbs over DataFrames: what pipelines of channels of tuples say with map, join, groupTuple and the like."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import at_most


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], remainder: bool = False) -> DataFrame:
    """Inner join by key; with remainder, what is unmatched on either side stays."""
    return left.join(right, on, "full_outer" if remainder else "inner")


def combine(left: DataFrame, right: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """All pairs, within equal keys if `by` is given."""
    return left.join(right, by) if by else left.crossJoin(right)


def group_tuple(df: DataFrame, by: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with an array of each other column, all in the same total order."""
    keys = [by] if isinstance(by, str) else list(by)
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in others if c not in order)))).alias("_r"))
    return rows.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others))


def transpose(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The inverse of group_tuple: a row for each position of the arrays."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.arrays_zip(*columns)).alias("_z")).select(*rest, *(F.col(f"_z.{c}").alias(c) for c in columns)).select(df.columns)


def collect(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row: the column's values as one array in order; a million values at most."""
    df = at_most(df, 1_000_000, "collect")
    return df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("_v")))), lambda x: x["_v"]).alias(column))


def mix(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def concat(*parts: DataFrame, name: str = "part") -> DataFrame:
    """All rows, with the number of the part they come from, which orders them."""
    return reduce(DataFrame.unionByName, (p.withColumn(name, F.lit(i)) for i, p in enumerate(parts)))


def branch(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """df with the name of the first condition that holds; rows for which none does are dropped."""
    out = reduce(lambda a, kv: a.when(kv[1], kv[0]), list(conditions.items())[1:], F.when(next(iter(conditions.values())), next(iter(conditions))))
    return df.withColumn(name, out).where(F.col(name).isNotNull())


def multi_map(df: DataFrame, **selects: Sequence[Column | str]) -> dict[str, DataFrame]:
    return {k: df.select(*v) for k, v in selects.items()}


def if_empty(df: DataFrame, default: DataFrame) -> DataFrame:
    """df, or the default where df has no rows; decided in the plan."""
    none = df.limit(1).agg((F.count("*") == 0).alias("_e"))
    return df.unionByName(default.crossJoin(F.broadcast(none)).where("_e").drop("_e"))


def flatten(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.explode(column))


def first(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(1)
