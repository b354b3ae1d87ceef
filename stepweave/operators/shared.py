"""Tables that operators write into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows that one task may have of a key: a key that may have more is dealt by ranges of its rows.
HOT = 1_000_000


def few_rows(rows: DataFrame) -> bool:
    """Whether there are no more than HOT rows in all, so that no key can have more: no more than that are counted."""
    return rows.select(F.lit(1)).limit(HOT + 1).count() <= HOT


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once into Parquet in the shared folder: spark.checkpoint.dir, or one of our own in local mode alone."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stepweave-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranks(rows: DataFrame, column: str, into: str) -> DataFrame:
    """The distinct values of a column, nulls aside, and their ranks from 0: numbered within ranges and by range, so that no task has all."""
    ranged = written(rows.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1 + F.col("start")
    return ranged.join(starts, "__range").select(column, place.cast("long").alias(into))


def numbered(rows: DataFrame, by: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """rows, which must differ in `by`, with idx (from 0, in the order of by, within each group), total (rows of the group)
    and start (rows before the group). `within` are the first columns of by, none of them null.

    Ranges of rows are numbered apart, and what comes before each is added: no task has all rows, nor all of one group.
    """
    if tuple(by[: len(within)]) != tuple(within):
        raise ValueError("the columns of groups come first among those of the order")
    ranged = written(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    whole = ranged.join(starts, "__range").withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1 + F.col("__start"))
    bounds = whole.groupBy(*within).agg(F.min("__at").alias("start"), F.count("*").alias("total"))
    whole = whole.join(bounds, list(within)) if within else whole.crossJoin(F.broadcast(bounds))  # one row
    return whole.select(*rows.columns, (F.col("__at") - F.col("start")).cast("long").alias("idx"), F.col("total").cast("long").alias("total"), F.col("start").cast("long").alias("start"))
