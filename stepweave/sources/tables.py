"""Readers, and the sequences that the test tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.prepare import Prepared, prepare
from ..operators.sequences import Sequences, from_wide

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file of sequences, wide or long, with a header; all columns as text."""
    return spark.read.csv(path, header=True)


def read_wide(spark: SparkSession, path: str, prefix: str = "T") -> Sequences:
    """Wide sequences, one a row, their states in columns of the prefix and a number."""
    rows = read_csv(spark, path).withColumn("seq_id", F.monotonically_increasing_id())
    columns = sorted((c for c in rows.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return from_wide(rows, columns, "seq_id")


def read_long(spark: SparkSession, path: str, **options) -> Prepared:
    return prepare(read_csv(spark, path), **options)


def event_sessions(spark: SparkSession, sf_dir: str, threshold: float = DAY, actor: str | list[str] = "user_id") -> Prepared:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return prepare(rows, "event_type", actor, "ts", tiebreak=("event_id",), time_threshold=threshold)


def orders(spark: SparkSession, sf_dir: str, state: str = "o_orderpriority", segments: bool = False, where: str | None = None) -> Sequences:
    """A customer's orders by date; the group, if asked for, is the customer's market segment."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col(state).alias("state"))
    if where:
        rows = rows.where(where)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = rows.select(F.col("o_custkey").alias("seq_id"), place.alias("raw_pos"), "state")
    if not segments:
        return Sequences(rows)
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq_id"), F.col("c_mktsegment").alias("grp"))
    return Sequences(rows.join(who, "seq_id"), groups=("grp",))


def conversations(spark: SparkSession, sf_dir: str) -> Sequences:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return Sequences(rows.select(F.col("conv_id").alias("seq_id"), place.alias("raw_pos"), F.col("role").alias("state")))
