"""SentencePiece ids of whole tables, and their texts again; the matching is in ``piece_matching``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docspark.llm.piece_matching import Pieces, matcher
from docspark.llm.tables import fields, map_batches
from docspark.llm.textbytes import binary, chunks, joined

# Bytes of texts matched together: what a task holds are some dozen arrays over their new words' edges.
BATCH = 1 << 20


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ids (array of int) of every row, without begin or end, as the library encodes.

    A null text is empty and has no ids. One row out per row in; no rows give no rows; other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    pieces = Pieces(path)
    out = fields(docs, keep, ("ids", T.ArrayType(T.IntegerType())))

    def make():
        words = matcher(pieces)

        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(len(keep)))
            for i, j in chunks(offsets, BATCH):
                ids, at = words.encoded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[: len(keep)]), lists], names=out.names)

        return step

    return map_batches(docs.select(*keep, text), out, make)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns but ``ids``, and text: what the ids stand for. Null or no ids give an empty text.

    Blanks and the bar character are one to the model, so a bar comes back as a blank. Bytes that are no UTF-8
    are replaced as the library replaces them, one sign each.
    """
    pieces = Pieces(path)
    keep = [c for c in encoded.columns if c != ids]
    out = fields(encoded, keep, ("text", T.StringType()))

    def make():
        def step(b: pa.RecordBatch):
            lists = b.column(len(keep)).fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            data, ends = pieces.decode(flat, at)
            try:
                texts = binary(data, ends).cast(pa.string())
            except pa.ArrowInvalid:
                raw = data.tobytes()
                texts = pa.array([raw[x:y].decode(errors="replace") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], texts], names=out.names)

        return step

    return map_batches(encoded.select(*keep, ids), out, make)
