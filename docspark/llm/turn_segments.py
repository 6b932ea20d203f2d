"""Sorted rows of conversations packed into segments: one row holds neighbouring turns of one conversation.

Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over as many tasks as its
rows need. A segment never crosses an Arrow batch and has at most ``ROWS`` turns; it is ``open`` where its
conversation may go on in another segment. Only open segments, a few a batch, ever need their neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.tables import release

ROWS = 4096


def in_order(conv: str = "conv_id") -> list[Column]:
    """The order of turns: by turn, null first; rows of one turn by role and text."""
    return [F.col(conv).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def segmented(df: DataFrame, order: list[Column], keep: list[str], conv: str = "conv_id", rows: int = ROWS) -> DataFrame:
    """One row per segment: ``conv``, segment (ascending in the conversation), open, and the columns of ``keep`` as lists.

    No rows give no segments. Rows that are alike in all of ``order`` meet in one task, so callers add up or salt them.
    """
    others = keep
    lists = [T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in others]
    out = T.StructType([df.schema[conv], T.StructField("segment", T.LongType()), T.StructField("open", T.BooleanType()), *lists])

    def pack(batches):
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            key = b.column(0)
            same = pa.compute.equal(key.slice(1), key.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            null = key.is_null().to_numpy(zero_copy_only=False)
            first = np.ones(n, bool)
            first[1:] = ~(same | (null[1:] & null[:-1]))
            begins = np.flatnonzero(first)
            cut = first.copy()
            cut[(np.arange(n) - begins[np.cumsum(first) - 1]) % rows == 0] = True
            at = np.flatnonzero(cut)
            ends = np.append(at[1:], n)
            whole = first[at] & np.append(first, True)[ends]
            whole[0] = whole[-1] = False  # the conversation may have more in the batch before or after
            offsets = pa.array(np.append(at, n), pa.int32())
            made = [key.take(pa.array(at)), pa.array(number + np.arange(len(at))), pa.array(~whole)]
            made += [pa.ListArray.from_arrays(offsets, c) for c in b.columns[1:]]
            number += len(at)
            yield pa.RecordBatch.from_arrays(made, names=out.names)
        release()

    return df.sort(*order).select(conv, *others).mapInArrow(pack, out)


def earlier(conv: str = "conv_id") -> Window:
    """The segments before this one in its conversation, for narrow rows of open segments."""
    return Window.partitionBy(conv).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
