"""Blocks of vectors: rows of a table gathered into matrices of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str, zero: bool = True) -> Column:
    """True where the vector is there, isn't empty and all its components are finite numbers (and, unless ``zero``, one isn't 0)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & (F.size(v) > 0) & ~bad
    return F.coalesce(good if zero else good & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series, dtype: type) -> np.ndarray:
    """Rows of a column of lists; shorter ones are filled with zeros."""
    rows = [np.asarray(x, dtype=dtype) for x in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=dtype)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def blocks(df: DataFrame, size: int, name: str, rows: int, *by: str) -> DataFrame:
    """``df`` with the column ``name``, a number of a block of about ``size`` of its ``rows`` rows, by a hash of ``by``."""
    return df.withColumn(name, F.pmod(F.xxhash64(*by, F.lit(name)), F.lit(max(1, -(-rows // size)))).cast("int"))


def to_every(df: DataFrame, count: int, name: str) -> DataFrame:
    """``df`` once for each block number below ``count``, in the column ``name``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
