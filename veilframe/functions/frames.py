"""DataFrames that are written and read again, and columns that are computed once."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Folders that settled() is going to delete.
_passing: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which a cluster sets.

    Only a local master, where driver and executors are one process, may leave it unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", top)
    _passing.append(f"{top}/{uuid.uuid4().hex}")
    return _passing[-1]


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a write has ended: what it wrote is what later steps read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, outlives a lost executor."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), materialized; all other folders that were written for them go."""
    begin = len(_passing)
    out = materialize(make())  # its folder is the last
    for folder in _passing[begin:-1]:
        _delete(spark, folder)
    del _passing[begin:-1]  # out itself may be on the way to something
    return out


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator of one row, which the optimizer neither copies nor moves."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers from 0 in an order, without sorting it in one task: sorted by ranges, and each range starts where those
    before it end (a row per range). Rows that are equal in the order get different numbers."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())  # range and place in it
    rows = materialize(rows)
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_id")


def numbered_within(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers from 1 within each value of a key (of which there are few), in an order."""
    rows = numbered(df, [F.col(key), *order], "_no")
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_no").alias("_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_no") - F.col("_first") + 1).drop("_key", "_no", "_first")
