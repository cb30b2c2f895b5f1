"""Text -> vector.

Default: an offline hashed bag of words (tokens found by the JVM, counted in
numpy per Arrow batch).  A caller's batch embedder runs through
``mapInPandas``: it is created once per task, called once per Arrow batch,
and each call is retried with exponential back-off (5 attempts, 1-60 s, as
in the reference)."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutline.session import ship_package

RETRY_ATTEMPTS = 5
RETRY_MIN_S, RETRY_MAX_S = 1.0, 60.0


def with_retry(fn, attempts: int = RETRY_ATTEMPTS, lo: float = RETRY_MIN_S, hi: float = RETRY_MAX_S,
               sleep=time.sleep):
    def run(*a, **kw):
        for i in range(attempts):
            try:
                return fn(*a, **kw)
            except Exception:  # noqa: BLE001
                if i == attempts - 1:
                    raise
                sleep(min(hi, lo * (2 ** i)))
    return run


SLICE = 512                 # rows counted at a time


def _places(tokens: pa.Array, dim: int) -> np.ndarray:
    """The place of every token; each distinct one of the batch is hashed once."""
    seen = tokens.dictionary_encode()
    place = [int(hashlib.md5(t).hexdigest()[:8], 16) % dim for t in seen.dictionary.cast(pa.binary()).to_pylist()]
    return np.array(place, np.int64)[seen.indices.to_numpy(zero_copy_only=False)]


def token_vectors(tokens: pa.Array, dim: int) -> pa.Array:
    """Unit vectors of token counts of a column of token lists."""
    ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    place = _places(tokens.flatten(), dim) if ends[-1] else np.zeros(0, np.int64)
    out = np.empty((len(tokens), dim), np.float32)
    for at in range(0, len(tokens), SLICE):
        own = ends[at:at + SLICE + 1]
        row = np.repeat(np.arange(len(own) - 1), np.diff(own))
        counts = np.bincount(row * dim + place[own[0]:own[-1]], minlength=(len(own) - 1) * dim).reshape(-1, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        out[at:at + SLICE] = counts / np.where(norms > 0, norms, 1.0)
    return pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), pa.array(out.ravel()))


def embed_hashed(df: DataFrame, col: str, out: str = "embedding", dim: int = 64, apart: bool = False) -> DataFrame:
    """Unit vector of token counts.  A token's place is its md5 (first eight hex
    digits) modulo ``dim``, which any engine can compute; a text without tokens
    gives the zero vector.  Tokens are found by the JVM and counted by numpy over Arrow batches.

    Below a Python function Spark merges all projections into one, which writes an expression out anew
    wherever its column is used.  ``apart`` keeps them as they are, for rows that come from a long chain; the
    rows then pass through Python whole."""
    ship_package(df.sparkSession)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    if apart:
        def with_vectors(batches):
            for batch in batches:
                vectors = token_vectors(batch.column(len(batch.schema) - 1), dim)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], out])

        given = [F.col(f"`{c}`") for c in df.columns if c != out]
        schema = T.StructType([f for f in df.schema.fields if f.name != out]).add(out, T.ArrayType(T.FloatType(), False))
        return df.select(*given, tokens.alias("_tokens")).mapInArrow(with_vectors, schema)

    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def vectors(tokens: pa.Array) -> pa.Array:
        return token_vectors(tokens, dim)

    return df.withColumn(out, vectors(tokens))


def embed_with(df: DataFrame, col: str, make_embedder: Callable[[], Callable[[list], list]],
               out: str = "embedding", error: str = "embedding_error", sleep=time.sleep) -> DataFrame:
    """``make_embedder()`` is called once per task and returns a function from
    a list of texts to a list of vectors.

    A batch that fails all its attempts is tried text by text, so one bad text
    costs its own row only: a null vector, with the reason in ``error`` (null
    where embedding worked).
    """
    ship_package(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += f", `{out}` array<float>, `{error}` string"

    def run(batches):
        raw = make_embedder()
        fn = with_retry(raw, sleep=sleep)

        def checked(texts, call):
            vecs = list(call(texts))
            if len(vecs) != len(texts):
                raise ValueError(f"{len(vecs)} vectors for {len(texts)} texts")
            return vecs

        for pdf in batches:
            texts = pdf[col].fillna("").tolist()
            errors: list = [None] * len(texts)
            try:
                vecs = checked(texts, fn)
            except Exception:  # noqa: BLE001
                vecs = [None] * len(texts)
                for i, t in enumerate(texts):
                    try:
                        vecs[i] = checked([t], raw)[0]
                    except Exception as e:  # noqa: BLE001
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pdf.assign(**{out: pd.Series(vecs, index=pdf.index, dtype=object),
                                error: pd.Series(errors, index=pdf.index, dtype=object)})
    return df.mapInPandas(run, schema)


def embed(df: DataFrame, col: str, embedder=None, out: str = "embedding", dim: int = 64, apart: bool = False) -> DataFrame:
    """Vector of ``col``; a caller's ``embedder`` also adds ``embedding_error``."""
    if embedder is None:
        return embed_hashed(df, col, out=out, dim=dim, apart=apart)
    return embed_with(df, col, embedder, out=out)
