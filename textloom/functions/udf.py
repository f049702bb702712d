"""Python kernels as Arrow-batched column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TEXT, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    """A struct type; unlike a DDL string it needs no session, so workers can import modules that hold one."""
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


ATTRS = T.ArrayType(struct(k=TEXT, v=TEXT))
#: Rows and bytes that are Python objects at once; a single larger value is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 1024, 1 << 16


def _none(x: Any) -> Any:
    return None if isinstance(x, float) and x != x else x


def _pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The same rows in order, cut in halves until they are small."""
    todo = [columns]
    while todo:
        some = todo.pop()
        n = len(some[0])
        if n <= 1 or n <= PIECE_ROWS and sum(c.nbytes for c in some) <= PIECE_BYTES:
            yield some
        else:
            todo += [tuple(c.slice(n // 2) for c in some), tuple(c.slice(0, n // 2) for c in some)]


def _values(a: pa.Array) -> list:
    """As to_pylist, column by column where values are nested."""
    kind = a.type
    if pa.types.is_list(kind):
        inner, at, out = _values(a.flatten()), 0, []
        for n in a.value_lengths().to_pylist():
            out.append(None if n is None else inner[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, r, strict=True)) for r in zip(*map(_values, a.flatten()), strict=True)]
        return [r if there else None for r, there in zip(rows, a.is_valid().to_pylist(), strict=True)] if a.null_count else rows
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_boolean(kind):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def _packer(out: T.DataType) -> Callable[[Any], Any] | None:
    """What turns dicts into the pairs that Arrow takes for maps; None where there are no maps."""
    if isinstance(out, T.MapType):
        inner = _packer(out.valueType)
        return lambda x: None if x is None else [(k, inner(v) if inner else v) for k, v in x.items()]
    if isinstance(out, T.ArrayType):
        inner = _packer(out.elementType)
        return inner and (lambda x: None if x is None else [inner(v) for v in x])
    if isinstance(out, T.StructType):
        packers = {f.name: p for f in out.fields if (p := _packer(f.dataType))}
        return packers and (lambda x: None if x is None else {k: packers[k](v) if k in packers else v for k, v in x.items()}) or None
    return None


def results(fn: Callable[..., Any], out: T.DataType, columns: Iterable[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """fn's values over the rows of columns, in small arrays: what is held at once does not grow with the batch."""
    kind, pack = to_arrow_type(out), _packer(out)
    for batch in columns:
        for piece in _pieces(batch):
            rows = [fn(*(_none(x) for x in row)) for row in zip(*map(_values, piece), strict=True)]
            if isinstance(out, T.StructType):
                rows = [r or {} for r in rows]
            yield pa.array([pack(r) for r in rows] if pack else rows, kind)


def kernel(fn: Callable[..., Any], out: T.DataType = TEXT, **options: Any) -> Callable[..., Column]:
    """A column function of fn(value, **options), called once for every row; struct results are dicts."""
    one = functools.partial(fn, **options) if options else fn

    def batch(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return results(one, out, ((v,) for v in values))

    batch.__name__ = fn.__name__
    return F.arrow_udf(batch, out)


def kernel2(fn: Callable[..., Any], out: T.DataType = TEXT) -> Callable[..., Column]:
    """As kernel, for two columns."""

    def batch(values: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return results(fn, out, values)

    batch.__name__ = fn.__name__
    return F.arrow_udf(batch, out)


def kernel3(fn: Callable[..., Any], out: T.DataType = TEXT) -> Callable[..., Column]:
    """As kernel, for three columns."""

    def batch(values: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return results(fn, out, values)

    batch.__name__ = fn.__name__
    return F.arrow_udf(batch, out)
