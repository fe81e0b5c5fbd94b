"""Helpers that all operators share: errors, schema checks, total orders, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


class EngineError(ValueError):
    """A failure that names the operator it comes from."""

    def __init__(self, operator: str, message: str):
        super().__init__(f"{operator}: {message}")
        self.operator = operator


def session(name: str = "ramify", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def assert_schema(df: DataFrame, columns: Sequence[str], operator: str, *, require_non_empty: bool = False) -> DataFrame:
    """df, if it has the columns (further ones may follow) and, where asked, a row."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise EngineError(operator, f"missing columns: {', '.join(missing)}")
    if require_non_empty and df.isEmpty():
        raise EngineError(operator, "no rows")
    return df


def standard_first(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in order, then all others."""
    return df.select(*columns, *(c for c in df.columns if c not in set(columns)))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by a total order, unlike dropDuplicates(), which keeps any."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """df with a number that rises in the order of its partitions and rows (for files: their order in the scan), with gaps."""
    return df.withColumn(name, F.monotonically_increasing_id())


def in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df in a total order over its partitions, written once: with _pid, the partition, and _row, the place in it from 0.

    As the rows are written, all that is derived from them sees one and the same partitioning.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # fixed by Spark: the partition's number is above the lowest 33 bits
    return cut_lineage(parted.withColumns({"_pid": F.shiftright("_at", 33).cast("int"), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))


def before_partitions(parted: DataFrame, amount: Column) -> DataFrame:
    """_pid, _before: the sum of the amounts of all rows in earlier partitions. One row a partition, so it may be broadcast."""
    sizes = parted.groupBy("_pid").agg(F.sum(amount).alias("_n"))
    return sizes.select("_pid", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def total_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with its rank from 1 in a total order, without a window over all rows.

    Rows are range-partitioned and sorted once; a rank is the row's place in its partition plus the sizes of those before.
    """
    parted = in_order(df, order)
    placed = parted.join(F.broadcast(before_partitions(parted, F.lit(1))), "_pid")
    return placed.withColumn(name, (F.col("_row") + F.col("_before") + 1).cast("long")).drop("_pid", "_row", "_before")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: that of spark.checkpoint.dir; on a local master, where it is unset, one of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder is None and not sc.master.split("[")[0] == "local":
            raise EngineError("scratch_dir", "spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="ramify-"))
    return (folder or sc.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the scratch folder; it goes when the application ends, or by drop_path()."""
    path = f"{scratch_dir(spark)}/ramify-{tag}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, if it is still there and Spark still runs."""
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the scratch folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int, operator: str) -> DataFrame:
    """df, if it has no more rows than that: for what is gathered in one place."""
    found = df.limit(rows + 1).count()
    if found > rows:
        raise EngineError(operator, f"more than {rows} rows to gather in one place")
    return df


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"
