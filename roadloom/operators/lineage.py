"""Cutting the plan of iterative operators in a folder that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; a temporary folder in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if re.match("local($|\\[)", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.gettempdir()
    return str(top).rstrip("/")


#: Folders written by ``materialised``, with their application.
_steps: list[tuple[str, str]] = []


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``shared_folder`` and read back; ``release`` deletes what is no longer needed."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    _steps.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *needed: DataFrame) -> int:
    """Deletes the folders that operators of this application have written, but for those that ``needed`` read; how many went."""
    app, used = spark.sparkContext.applicationId, [f for df in needed for f in df.inputFiles()]
    gone = [step for step in _steps if step[0] == app and not any(step[1].rsplit("/", 1)[1] in f for f in used)]
    for step in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _steps.remove(step)
    return len(gone)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos: 0, 1, ... in the order of the columns ``order``, which go.

    Rows are sorted in ranges; each range is numbered by itself, after the sizes of the
    ranges before it, of which there are as many as tasks.
    """
    parts = materialised(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_earlier"))  # a row for each task
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = parts.withColumn("_place_in_range", place).join(F.broadcast(before), "_range")
    return placed.withColumn("_number", (F.col("_earlier") + F.col("_place_in_range")).cast("long")).drop("_range", "_place_in_range", "_earlier", *order).withColumnRenamed("_number", "pos")
