"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in a local session and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; the innermost ``scratch`` around the call deletes it."""
    path = f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    for made in getattr(spark.sparkContext, "_corpusloom_scratch", [])[-1:]:
        made.append(path)
    return path


def written(df: DataFrame, name: str = "work") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes on leaving what was written to the shared folder inside; results have to be used up or saved by then."""
    stack = spark.sparkContext.__dict__.setdefault("_corpusloom_scratch", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
