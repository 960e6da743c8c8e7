"""Columns of what the kernel gives to Spark, as Arrow types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DataType

from quire.kernel.engine import STATS

_S, _I = pa.string(), pa.int32()


def struct(**fields: pa.DataType) -> pa.StructType:
    return pa.struct(list(fields.items()))


TOKEN = struct(pos=_I, kind=_S, text=_S, aux=_S, level=_I)
KIND_COUNT = struct(kind=_S, n=pa.int64())
BLOCK = struct(
    block_id=_I, parent_id=_I, ord=_I, depth=_I, kind=_S, level=_I, lang=_S, text=_S, label=_S, number=_S, title=_S, markdown=_S
)
INLINE = struct(inline_id=_I, block_id=_I, parent_id=_I, ord=_I, kind=_S, text=_S)
CELL = struct(block_id=_I, row=_I, col=_I, is_header=pa.bool_(), align=_S, text=_S)
EVENT = struct(
    pos=_I, event=_S, kind=_S, label=_S, number=_S, title=_S, level=_I, shown=_S, keys=pa.list_(_S), mode=_S, before=_S, after=_S
)
ENTRY = struct(ord=_I, key=_S, entry_type=_S, fields=pa.map_(_S, _S))
STATISTICS = struct(**dict.fromkeys(STATS, _I))
CONVERTED = struct(markdown=_S, error=_S, warnings=pa.list_(_S), metadata=pa.map_(_S, _S), bibliography=_S, stats=STATISTICS)


def spark_type(kind: pa.DataType) -> DataType:
    return from_arrow_type(kind)
