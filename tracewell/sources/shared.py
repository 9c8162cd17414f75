"""Folders for tables and files that a job writes for itself, and how many partitions its rows are dealt to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a local folder only where Spark runs in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tracewell-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts(spark: SparkSession, rows: int, most: int) -> int:
    """How many partitions hold ``rows`` with ``most`` in each, and no fewer than Spark's own: what a task holds doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))
