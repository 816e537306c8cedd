"""Vectors as bytes: one clean row for each usable vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(vec_id long, label, vec binary of the original floats); null, empty, zero, null-holding and non-finite vectors are left out."""
    double = isinstance(df.schema[vec_col].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32
    cols = [df[id_col].cast("long").alias("vec_id"), *([df[label_col].cast("string").alias("label")] if label_col else []), df[vec_col].alias("vec")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("vec"))
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            flat = v.flatten()
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(sizes)
            data, keep = [], []
            for i, (n, e) in enumerate(zip(sizes, ends, strict=True)):
                x = values[e - n : e]
                if n and np.isfinite(x).all() and x.any():
                    keep.append(i)
                    data.append(x.tobytes())
            rest = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[rest.column(i) for i in range(rest.num_columns - 1)], pa.array(data, pa.binary())], names=rest.schema.names)

    return df.select(*cols).mapInArrow(rows, "vec_id long, " + ("label string, " if label_col else "") + "vec binary")


def dtype_of(df: DataFrame, vec_col: str) -> str:
    return "f8" if isinstance(df.schema[vec_col].dataType.elementType, T.DoubleType) else "f4"
