"""Fixed-width payloads: structs of primitive fields packed little-endian without gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import InvalidError

_KINDS = {"byte": "i1", "short": "<i2", "integer": "<i4", "long": "<i8", "float": "<f4", "double": "<f8"}
_ARROW = {"i1": pa.int8(), "<i2": pa.int16(), "<i4": pa.int32(), "<i8": pa.int64(), "<f4": pa.float32(), "<f8": pa.float64()}


def layout(schema: T.StructType) -> np.dtype:
    """Byte layout of a struct's fields, in order."""
    try:
        return np.dtype([(f.name, _KINDS[f.dataType.typeName()]) for f in schema.fields])
    except KeyError as e:
        raise InvalidError(f"a fixed-width payload can't hold {e}") from e


def pack(frame: DataFrame, schema: T.StructType, out: str = "value") -> DataFrame:
    """The columns of ``schema`` as one binary column; a null in any makes the value null."""
    kind, names = layout(schema), schema.fieldNames()
    rest = [c for c in frame.columns if c not in names and c != out]

    def run(batches):
        for batch in batches:
            rows = np.zeros(len(batch), kind)
            bad = np.zeros(len(batch), bool)
            for name in names:
                column = batch.column(name)
                bad |= column.is_null().to_numpy(zero_copy_only=False)
                rows[name] = column.fill_null(0).to_numpy(zero_copy_only=False)
            raw, w = rows.tobytes(), kind.itemsize
            values = [None if b else raw[i * w : (i + 1) * w] for i, b in enumerate(bad.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(values, pa.binary())], [*rest, out])

    return frame.select(*rest, *names).mapInArrow(run, T.StructType([*(frame.schema[c] for c in rest), T.StructField(out, T.BinaryType())]))


def unpack(frame: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """A binary column as the columns of ``schema``; a null gives nulls, another width is an error."""
    kind, names = layout(schema), schema.fieldNames()
    rest = [c for c in frame.columns if c != value and c not in names]

    def run(batches):
        for batch in batches:
            values = batch.column(value).to_pylist()
            if any(v is not None and len(v) != kind.itemsize for v in values):
                raise InvalidError(f"a value isn't {kind.itemsize} bytes wide")
            rows = np.frombuffer(b"".join(v or bytes(kind.itemsize) for v in values), kind)
            none = np.array([v is None for v in values], bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(np.ascontiguousarray(rows[n]), _ARROW[_KINDS[schema[n].dataType.typeName()]], mask=none) for n in names)], [*rest, *names])

    return frame.select(*rest, value).mapInArrow(run, T.StructType([*(frame.schema[c] for c in rest), *schema.fields]))
