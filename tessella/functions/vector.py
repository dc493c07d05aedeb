"""Vector functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in doubles; vectors of different lengths fail, as zip_with would pad them."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def l2_normalise(v: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def decode_f32(blob: Column) -> Column:
    """Little-endian 32-bit floats of a blob; a cut-off last one is left out."""

    def decoded(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist())

    return F.pandas_udf(decoded, "array<float>")(blob)


def encode_f32(vector: Column) -> Column:
    def encoded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(encoded, "binary")(vector)
