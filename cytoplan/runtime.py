"""Session helpers: lineage cuts in the shared folder, hot-key detection and salting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many of the sampled rows; so there are at most that many hot keys.
HOT_SHARE = 1000
#: Pieces a hot key is split into.
SALTS = 32
#: Share of the rows read to look for hot keys. It decides the plan only, never the result.
HOT_SAMPLE = 0.05


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cytoplan-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and reads it from there, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    own = spark.sparkContext._jsc.sc().getCheckpointDir().get()  # a folder of this session's own below the shared one
    if own not in _written:
        _written.append(own)
    return df.checkpoint(eager=True)


_written: list[str] = []


@atexit.register
def _clear() -> None:
    """Removes what this session wrote to the shared folder, on whatever store it lies, when the driver ends; lazy results may need it until then."""
    gateway = SparkContext._gateway
    for root in _written:
        try:
            path = gateway.jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # the engine is gone already
            if root.startswith("file:"):
                shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


class Scratch:
    """Tables written to the shared folder, by name; drop() removes those no longer needed, the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"cytoplan-{uuid.uuid4().hex}")
        _written.append(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they find it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_cytoplan_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="cytoplan-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "cytoplan.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(root, f), os.path.relpath(os.path.join(root, f), os.path.dirname(here)))
    context.addPyFile(path)
    context._cytoplan_shipped = True


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold over 1/HOT_SHARE of a 5 % sample of the rows: at most HOT_SHARE rows, so they may be broadcast."""
    counted = df.select(*keys).sample(HOT_SAMPLE, seed=7).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counted.agg(F.sum("__n").alias("__t"))
    return counted.join(F.broadcast(total), (F.col("__n") * HOT_SHARE > F.col("__t")) & (F.col("__n") > 50)).select(*keys)


def salted(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column __salt: hot keys of left are spread over SALTS pieces by the columns in spread, those of right are repeated for each piece."""
    flag = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    on = lambda df: df.join(flag, keys, "left")
    piece = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    a = on(left).withColumn("__salt", F.when(F.col("__hot"), piece).otherwise(F.lit(0))).drop("__hot")
    b = on(right).withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a, b
