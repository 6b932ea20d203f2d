"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.bind import let
from docspark.functions.counts import token_runs
from docspark.functions.slices import row_slices


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x)))


def softmax(logits: Column) -> Column:
    e = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    scale = lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda n: F.transform(v, lambda x: x / n))
    return let(e, scale)


# Tokens whose digests a worker remembers; with more it starts afresh.
MEMO = 1 << 18


class _Memo(dict):
    """Of every token two bytes of its digest, its place before it is cut to a dimension, and the bit after them, its sign."""

    def __missing__(self, token: str) -> int:
        h = hashlib.md5(token.encode("utf-8")).digest()
        self[token] = code = h[0] << 9 | h[1] << 1 | h[2] >> 7
        return code


_memo = _Memo()


def _codes(tokens: list[str]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, tokens), np.int64, len(tokens))


def _embedded(lens: np.ndarray, codes: np.ndarray, dim: int) -> np.ndarray:
    """Unit rows of rows of ``lens`` tokens each, by the tokens' codes."""
    out = np.zeros((len(lens), dim))
    if len(codes):
        at = np.repeat(np.arange(len(lens)) * dim, lens) + (codes >> 1) % dim
        out = np.bincount(at, weights=1.0 - 2.0 * (codes & 1), minlength=out.size).reshape(out.shape)  # sums of whole numbers, exact in any order
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def hash_embed(token_lists: list, dim: int) -> np.ndarray:
    """Signed token feature hashing, unit length: the default encoder (no weights needed)."""
    lens = np.fromiter((0 if t is None else len(t) for t in token_lists), dtype=np.int64)
    return _embedded(lens, _codes(list(itertools.chain.from_iterable(t for t in token_lists if t is not None))), dim)


def _vectors(lens: np.ndarray, tokens: pa.Array, dim: int) -> pa.Array:
    """The vectors of rows of ``lens`` tokens each; a token that occurs again is looked up once."""
    words = tokens.dictionary_encode()
    out = _embedded(lens, _codes(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()], dim)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), pa.array(out.ravel()))


def hash_embed_column(dim: int = 64):
    """Arrow UDF: array<string> tokens to array<double> vector, a few rows of a batch at a time."""

    def vectors(tokens: pa.Array) -> pa.Array:
        return _vectors(pc.fill_null(tokens.value_lengths(), 0).to_numpy(), tokens.flatten(), dim)

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield from map(vectors, row_slices(b))

    return embed


# Runs of letters and digits, as ``text.tokens`` cuts a lower-cased text.
TOKEN = re.compile(r"[^\W_]+")
_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()}


def tokens(text: str) -> list[str]:
    """The tokens of one lower-cased text; ``counts.token_runs`` has those of many."""
    return text.translate(_GAPS).split() if text.isascii() else TOKEN.findall(text)


def hash_embed_text(dim: int = 64):
    """Arrow UDF: lower-cased text to array<double> vector; its tokens are made in the worker, a few rows of a batch at a time."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for part in row_slices(b):
                yield _vectors(*token_runs([t or "" for t in part.to_pylist()]), dim)

    return embed
