"""Helpers shared by the operators: intermediate tables and table reading."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only in local mode, and an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tracewell-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(df: DataFrame, rows: list[dict[str, int]], schema: str) -> DataFrame:
    """A small table of whole numbers."""
    kind = "array<struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", ")) + ">>"
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
