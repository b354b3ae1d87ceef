"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where they are one process and
    it is unset, a folder of our own. On a cluster without it nothing is written anywhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stepweave-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which remove_written() clears."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def hadoop(spark: SparkSession, path: str):
    """The path as Hadoop's file systems see it, with scheme and host, and the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path), system


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, computed once into a Parquet table of the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def remove_written(spark: SparkSession) -> int:
    """Removes what written() and shared_folder()'s callers put into the shared folder so far, for callers whose results are stored by then: DataFrames
    that were made from these tables can't be computed any more. Returns how many there were."""
    count = len(_made)
    while _made:
        path, system = hadoop(spark, _made.pop())
        system.delete(path, True)
    return count


def fold_of(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def hash_share(*cols):
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one object, the one asked for last, so that the tables of stages
    that a worker served before don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def column(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_text(rows: DataFrame, text: Column) -> tuple[DataFrame, int]:
    """rows and the place of their column `text`, as Spark finds it; where there is none, or more than one, with the given one
    behind them. A text that is there needn't go to Python twice."""
    found = [k for k, c in enumerate(rows.columns) if c.lower() == "text"]
    if len(found) == 1:
        return rows, found[0]
    return rows.select("*", text.alias(fresh(rows.columns, "__text"))), len(rows.columns)


def mapped(rows: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """rows.mapInArrow(run, schema), whatever the columns' names: inside they are c0, c1 and so on, by place."""
    inner = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])
    names = inner.names

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]).mapInArrow(renamed, inner).toDF(*schema.names)


def fresh(taken: list[str], name: str) -> str:
    """The name, or one like it that none of the columns has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
