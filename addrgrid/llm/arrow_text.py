"""Arrow helpers of the operators that run Python inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: between a character that no engine calls white space and a plain space
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: the same before any white space that every engine agrees on
BEFORE_GAP = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def per_worker(key: tuple, make: Callable):
    """``make()``, kept for later tasks of the same Python worker. (Functions
    come by value, so a global of this module would live for one task only.)"""
    kept = sys.modules.setdefault("_addrgrid_worker", types.ModuleType("_addrgrid_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def latest_per_worker(name: str, version: str, make: Callable):
    """``make()`` of the last (name, version) that this Python worker met. A
    worker outlives its stage, so it holds one such object at a time: what an
    earlier version or another operator made is let go first."""
    held = per_worker(("latest",), dict)
    if (name, version) not in held:
        held.clear()
        held[name, version] = make()
        give_back()
    return held[name, version]


def let_go() -> None:
    """What ``latest_per_worker`` holds is let go, for an operator that needs none of it."""
    held = per_worker(("latest",), dict)
    if held:
        held.clear()
        give_back()


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc, nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, null texts as empty strings."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def schema_with(docs: DataFrame, id_col: str, fields: str) -> T.StructType:
    """doc_id with the type it has in ``docs``, then the fields of a DDL string."""
    own = T.StructField("doc_id", docs.schema[id_col].dataType, True)
    return T.StructType([own, *T.StructType.fromDDL(fields).fields])


def byte_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``max_bytes`` of text each, one row at
    least: work per step follows the bytes, not the number of rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
                     .astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def parts(text: str, max_chars: int) -> list[str]:
    """A long text in parts of about ``max_chars``, cut only where a space,
    tab or line end follows a non-blank: the pre-splitting patterns of
    byte-level BPE never match across such a place, so encoding the parts
    gives the ids of the whole. A stretch without such a place stays whole."""
    if len(text) <= max_chars:
        return [text]
    out, start = [], 0
    while len(text) - start > max_chars:
        cut = BEFORE_GAP.search(text, start + max_chars)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]
