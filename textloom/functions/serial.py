"""UBF-A terms as binary columns, JSON on the other side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import types as T

from ..core import ubf as K
from .strings import ColumnOrName, _c
from .udf import BOOL, TEXT, kernel, struct


def ubf_encode(c: ColumnOrName, record_names: tuple[str, ...] = ()) -> Column:
    """A term in JSON as bytes; null for what is no term."""
    return kernel(K.encode, T.BinaryType(), record_names=record_names)(_c(c))


#: struct<ok, json, error> of bytes.
ubf_decode = kernel(K.decode, struct(ok=BOOL, json=TEXT, error=TEXT))
