from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from textloom.functions import udf


def test_results_leave_before_the_batch_is_read():
    """What is held in Python does not grow with the rows of an Arrow batch, nor with their size."""
    for value, most in (("x", udf.PIECE_ROWS), ("x" * 50_000, 1)):
        asked = []

        def fn(x, asked=asked):
            asked.append(x)
            return [{"k": x, "v": None}] * 3

        out = udf.kernel(fn, udf.ATTRS).func(iter([pa.array([value] * 5000)]))
        first = len(next(out))
        assert first == len(asked) <= most
        assert first + sum(map(len, out)) == len(asked) == 5000


def test_nested_values_and_maps():
    pairs = pa.array([None, [], [{"k": "a", "v": None}, {"k": "b", "v": "c"}]], pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))
    for k in range(4):
        assert udf._values(pairs.slice(k)) == pairs.slice(k).to_pylist()
    kind = T.ArrayType(T.MapType(udf.TEXT, T.ArrayType(T.MapType(udf.TEXT, udf.TEXT))))
    made = next(udf.results(lambda x: None if x is None else [{x: [{"a": "b"}]}], kind, [(pa.array(["x", None]),)]))
    assert made.to_pylist() == [[[("x", [[("a", "b")]])]], None]
    one = udf.struct(ok=udf.BOOL, n=udf.LONG)
    assert next(udf.results(lambda x: x and {"ok": True}, one, [(pa.array(["x", None]),)])).to_pylist() == [{"ok": True, "n": None}, {"ok": None, "n": None}]
