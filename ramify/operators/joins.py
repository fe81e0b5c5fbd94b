"""Joins: semi, anti, lookup, band, candidate match, rectangle overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of left whose key is in right."""
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of left whose key is not in right."""
    return left.join(right, on, "left_anti")


def left_lookup(left: DataFrame, table: DataFrame, on: str, fill: dict[str, object]) -> DataFrame:
    """left with table's columns named in fill. A value that left has (and isn't empty) stays; what is missing in both is the fill."""
    table = table.select(F.col(on), *(F.col(c).alias(f"_{c}") for c in fill))
    out = left.join(table, on, "left")
    for c, value in fill.items():
        own = [F.nullif(F.col(c).cast("string"), F.lit("")).cast(left.schema[c].dataType)] if c in left.columns else []
        out = out.withColumn(c, F.coalesce(*own, F.col(f"_{c}"), F.lit(value)))
    return out.drop(*(f"_{c}" for c in fill))


def symbol_resolve(names: DataFrame, table: DataFrame, name_col: str, key_col: str) -> DataFrame:
    """names with table's columns, matched without regard to case; unmatched names have nulls."""
    return names.join(table.withColumn("_k", F.upper(key_col)), F.upper(name_col) == F.col("_k"), "left").drop("_k")


def band_join(points: DataFrame, *, by: Sequence[str], pos: str, side: Column, distance: float, keys: Sequence[str], divergent_only: bool = False) -> DataFrame:
    """Pairs of a true-side and a false-side point of the same `by` whose positions differ by at most `distance`.

    Columns: by, keys as left_*/right_*, pos as left_pos/right_pos, gap (long or double), both directions (mirrored
    rows: the left point is on either side). Positions are cut into buckets of `distance`; one side is repeated in the
    buckets beside its own, and an equi-join on the bucket is filtered by the exact difference.
    """
    width = F.lit(max(distance, 1))
    cols = [*by, *keys, pos]
    a = points.where(side).select(*(F.col(c).alias(f"a_{c}") for c in cols), F.floor(F.col(pos) / width).alias("_bucket"))
    b = points.where(~side).select(*(F.col(c).alias(f"b_{c}") for c in cols), F.explode(F.array(*(F.floor(F.col(pos) / width) + k for k in (-1, 0, 1)))).alias("_b"))
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by] + [F.col("_bucket") == F.col("_b"), F.abs(F.col(f"a_{pos}") - F.col(f"b_{pos}")) <= distance]
    if divergent_only:
        on.append(F.col(f"b_{pos}") <= F.col(f"a_{pos}"))
    pairs = a.join(b, on)
    gap = F.abs(F.col(f"a_{pos}") - F.col(f"b_{pos}")).alias("gap")

    def way(x: str, y: str) -> DataFrame:
        return pairs.select(*(F.col(f"a_{c}").alias(c) for c in by), *(F.col(f"{x}_{c}").alias(f"left_{c}") for c in [*keys, pos]), *(F.col(f"{y}_{c}").alias(f"right_{c}") for c in [*keys, pos]), gap)

    both = way("a", "b").unionByName(way("b", "a"))
    return both.dropDuplicates([*by, *(f"{s}_{k}" for s in ("left", "right") for k in keys)])


def candidate_match(stated: DataFrame, found: DataFrame, *, block: str, key: str, similarity: Column, source: str, sources: Sequence[str], accept: float = 0.35, may: Column | None = None) -> DataFrame:
    """For each stated row the best candidate by similarity, of the first source (in the order given) that has one of at least `accept`.

    Both sides carry the blocking column; candidates are only compared within a block, each pair once however many
    blocks it shares, and only where `may` (a cheap bound) holds. Of equal similarities the smallest candidate row (as a
    struct) wins. Unmatched stated rows stay, with a null candidate.
    """
    cand = F.struct(*(c for c in found.columns if c != block)).alias("cand")
    pairs = stated.join(found.select(F.col(block), cand, F.col(source).alias("_source")), block).where(F.lit(True) if may is None else may)
    pairs = pairs.dropDuplicates([key, "cand"]).withColumn("sim", similarity)
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in sources)), F.col("_source")), F.lit(0))
    pairs = pairs.where(F.col("sim") >= accept).withColumn("_rank", F.when(rank > 0, rank).otherwise(len(sources) + 1))
    order = W.partitionBy(key).orderBy("_rank", F.desc("sim"), "cand")
    best = pairs.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(F.col(key), "cand", "sim")
    return stated.dropDuplicates([key]).drop(block).join(best, key, "left")


def rect_overlap_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], box: Sequence[str] = ("x0", "y0", "x1", "y1"), grow: float = 0.0, tile: float = 100.0) -> DataFrame:
    """Pairs of boxes (same `by`) of which left's, grown on all sides, meets right's. Tiles make it an equi-join; right's columns get right_.

    A pair that shares many tiles is taken in one of them: that where the later of its two boxes begins. So equal rows
    are dropped on each side and the pairs, of which there may be far more, are not sorted. Sides are dealt by tile
    whatever their size, as a small table can have many pairs.
    """
    x0, y0, x1, y1 = box

    def tiles(df: DataFrame, p: str, g: float) -> DataFrame:
        df = df.distinct().withColumns({f"_{p}{n}": F.floor((F.col(p + c) + d) / tile) for n, c, d in (("ax", x0, -g), ("bx", x1, g), ("ay", y0, -g), ("by", y1, g))})
        df = df.withColumn("_tx", F.explode(F.sequence(f"_{p}ax", f"_{p}bx"))).withColumn("_ty", F.explode(F.sequence(f"_{p}ay", f"_{p}by")))
        return df.drop(f"_{p}bx", f"_{p}by")

    r = right.select(*(F.col(c) if c in by else F.col(c).alias(f"right_{c}") for c in right.columns))
    first = (F.col("_tx") == F.greatest("_ax", "_right_ax")) & (F.col("_ty") == F.greatest("_ay", "_right_ay"))
    meet = (F.col(x0) - grow <= F.col(f"right_{x1}")) & (F.col(x1) + grow >= F.col(f"right_{x0}")) & (F.col(y0) - grow <= F.col(f"right_{y1}")) & (F.col(y1) + grow >= F.col(f"right_{y0}"))
    joined = tiles(left, "", grow).join(tiles(r, "right_", 0.0).hint("shuffle_hash"), [*by, "_tx", "_ty"])
    return joined.where(first & meet).drop("_tx", "_ty", "_ax", "_ay", "_right_ax", "_right_ay")
