"""Scalar functions around labels: palette, formatting, identifiers, typed-array codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Colour of cells without a label (fixed value).
UNLABELLED = "#999999"


def _hex(x: Column) -> Column:
    # halves round up: what is rounded is never negative
    return F.lower(F.lpad(F.hex(F.floor(x * 255 + 0.5).cast("long")), 2, "0"))


def label_color(index: Column, total: Column) -> Column:
    """F16: hues evenly from 30 to below 360 degrees, saturation .7, lightness .5; index = total gives UNLABELLED."""
    hue = 30 + index * 330 / total
    chroma, low = 0.7, 0.15
    part = F.pmod(hue / 60, F.lit(2.0))
    side = chroma * (1 - F.abs(part - 1))
    sector = F.floor(hue / 60)
    zero, full = F.lit(0.0), F.lit(chroma)

    def channel(*by_sector: Column) -> Column:
        return _hex(F.element_at(F.array(*by_sector), F.least(sector, F.lit(5)).cast("int") + 1) + low)

    red = channel(full, side, zero, zero, side, full)
    green = channel(side, full, full, side, zero, zero)
    blue = channel(zero, zero, side, full, full, side)
    return F.when(index >= total, UNLABELLED).otherwise(F.concat(F.lit("#"), red, green, blue))


def list_file_name(partition: Column) -> Column:
    """zero-padded list number."""
    return F.lpad(partition.cast("string"), 4, "0")


def sample_cell_id(sample: Column, barcode: Column) -> Column:
    """P11."""
    return F.concat_ws("_", sample, barcode)


def quoted(x: Column) -> Column:
    """as the result file quotes strings, without escaping."""
    return F.concat(F.lit('"'), x, F.lit('"'))


def user_index_id(created_ms: Column, token: Column | None = None) -> Column:
    """the random part may be given, for reproducible ids."""
    return F.concat_ws("-", F.lit("user"), created_ms.cast("string"), token if token is not None else F.substring(F.uuid(), 1, 8))


def _packed(v: pd.Series, kind: str) -> pd.Series:
    """Base64 of typed arrays: the values of all rows are converted at once, a row's bytes are a stretch of them."""
    import base64

    sizes = v.map(lambda x: 0 if x is None else len(x)).to_numpy(np.int64)
    data = np.concatenate([np.zeros(0, kind), *(x for x in v if x is not None)]).astype(kind).tobytes()
    ends = np.cumsum(sizes) * np.dtype(kind).itemsize
    return pd.Series([None if x is None else base64.b64encode(data[a:b]).decode() for x, a, b in zip(v, np.append(0, ends[:-1]), ends)], dtype=object)


def _unpacked(v: pd.Series, kind: str, out: type) -> pd.Series:
    import base64

    return v.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), kind).astype(out))


def _codec(kind: str, out: type, element: T.DataType):
    """columns of arrays to base64 of little-endian values, and back."""

    @F.pandas_udf(T.StringType())
    def encode(v: pd.Series) -> pd.Series:
        return _packed(v, kind)

    @F.pandas_udf(T.ArrayType(element))
    def decode(v: pd.Series) -> pd.Series:
        return _unpacked(v, kind, out)

    return encode, decode


#: 32-bit floats, 16-bit integers, bytes.
encode_floats, decode_floats = _codec("<f4", np.float32, T.FloatType())
encode_shorts, decode_shorts = _codec("<i2", np.int32, T.IntegerType())
encode_bytes, decode_bytes = _codec("u1", np.int32, T.IntegerType())
