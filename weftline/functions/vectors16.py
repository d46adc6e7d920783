"""Vectors as packed half-precision bytes and back, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.BinaryType())
def packed16(vectors: pd.Series) -> pd.Series:
    """Two little-endian bytes a value; null for null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())


@pandas_udf(T.ArrayType(T.FloatType()))
def unpacked16(data: pd.Series) -> pd.Series:
    """The values of packed bytes; null for null and for none."""
    return data.map(lambda b: np.frombuffer(b, "<f2").astype(np.float32) if b else None)
