"""Token counts by the whole-token shortcut.

Offline, once per tokenizer, every vocabulary string is encoded alone: those that give just their own id are
proved whole. A text is cut into pre-tokens; one that is a proved string counts as one token by lookup, and
only the rest is merged by the library, once for each distinct pre-token of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docspark.llm.pretokens import Encoder
from docspark.llm.tables import fields, map_batches
from docspark.llm.textbytes import chunks, joined


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """``keep`` columns with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    One row out per row in, repeated rows included; a null text is empty and has no tokens. Strings of
    special tokens inside a text are special tokens, the library's default. Other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    encoder = Encoder(path)
    out = fields(docs, keep, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))

    def make():
        memo = encoder.open()

        def step(b: pa.RecordBatch):
            data, at = joined(b.column(len(keep)))
            n = [memo.counts(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
            n = np.concatenate(n).astype(np.int64)
            made = [pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names=out.names)

        return step

    return map_batches(docs.select(*keep, text), out, make)
