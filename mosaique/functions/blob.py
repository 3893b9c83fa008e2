"""Vectors as little-endian float blobs, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode(blobs: pd.Series) -> pd.Series:
    """Bytes after the last whole number are ignored."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4"))
