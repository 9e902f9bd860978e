"""mapInArrow over a key column and a text column, a bounded run of texts at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbuf


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back the memory that is free in it.

    Workers stay for the tasks of later stages, and what Arrow and the C library keep for
    them would count beside all that their executor needs by then.
    """

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return then_release


def per_chunk(df: DataFrame, text: str, keep: list[str], schema: T.StructType, fn: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    """One output row for each input row: the ``keep`` columns and those that ``fn`` makes.

    ``fn`` gets the bytes and the offsets of consecutive texts and returns, by name,
    an array or list for each further column of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for lo, hi, buf, offs in textbuf.chunks(batch.column(0)):
                made = fn(buf, offs)
                arrays = [batch.column(i + 1).slice(lo, hi - lo) for i in range(len(keep))] + [pa.array(made[f.name], f.type) for f in list(out)[len(keep) :]]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    return df.select(text, *keep).mapInArrow(tidy(run), schema)
