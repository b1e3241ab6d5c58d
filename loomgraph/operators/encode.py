"""Text encoders. An encoder is any callable Column -> Column giving an array<float> vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_windows, window_tokens
from ..functions.vectors import sum_vectors

Encoder = Callable[[Column], Column]
_WORD = re.compile(r"\w+")
KNOWN_TOKENS = 1 << 16  # tokens whose slots a worker remembers
ENCODE_TEXTS = 128  # texts encoded at a time


def _blake_slot(token: str, dim: int) -> tuple[int, float]:
    value = int.from_bytes(hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest(), "little")
    return value % dim, -1.0 if (value >> 8) & 1 else 1.0


def _md5_slot(token: str, dim: int) -> tuple[int, float]:
    value = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16)
    return value % dim, -1.0 if (value >> 8) & 1 else 1.0


_SLOTS = {"blake2b": _blake_slot, "md5": _md5_slot}


def hash_encoder(dim: int = 384, digest: str = "blake2b") -> Encoder:
    """Signed bag-of-words hashing into ``dim`` slots, L2-normalised; blank text gives the zero vector.

    Spark has no blake2b, so this is an Arrow batch function. ``digest='md5'`` uses the first 32 bits
    of md5 instead and can be reproduced in SQL.
    """
    slot_of = _SLOTS[digest]

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}  # twice the slot, plus 1 for a negative sign

        def codes(tokens: list[str]) -> list[int]:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            for token in tokens:
                if token not in known:
                    slot, sign = slot_of(token, dim)
                    known[token] = 2 * slot + (sign < 0)
            return [known[token] for token in tokens]

        for texts in batches:
            parts = []
            for at in range(0, len(texts), ENCODE_TEXTS):
                hits, sizes = [], []
                for text in texts.iloc[at:at + ENCODE_TEXTS]:
                    found = codes(_WORD.findall((text or "").lower()))
                    hits.extend(found)
                    sizes.append(len(found))
                flat = np.fromiter(hits, np.int64, len(hits))
                cell = np.repeat(np.arange(len(sizes)), sizes) * dim + (flat >> 1)
                rows = np.bincount(cell, weights=1.0 - 2.0 * (flat & 1), minlength=len(sizes) * dim).reshape(len(sizes), dim)
                norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                parts.extend((rows / np.maximum(norms, 1e-12)).astype(np.float32))
            yield pd.Series(parts, dtype=object)

    return encode


def model_encoder(make_predict: Callable[[], Callable], batch_size: int = 128) -> Encoder:
    """Wrap a sentence-embedding model: ``make_predict`` loads it once per Python worker and returns
    a function from a numpy array of strings to a 2-d float array."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)


def chunk_vectors(nodes: DataFrame, encoder: Encoder, max_tokens: int = 64,
                  keys: tuple[str, ...] = ("client_id", "node_id"), text: str = "text") -> DataFrame:
    """One vector per token window of every node text: keys, chunk_id, x."""
    staged = nodes.select(*keys, window_tokens(F.col(text)).alias("_tokens"))
    windows = staged.select(*keys, F.posexplode(chunk_windows(F.col("_tokens"), max_tokens)).alias("chunk_id", "chunk"))
    return windows.select(*keys, "chunk_id", encoder(F.col("chunk")).alias("x"))


def pooled_vectors(chunks: DataFrame, dim: int, keys: tuple[str, ...] = ("client_id", "node_id")) -> DataFrame:
    """Mean of the window vectors per node."""
    return sum_vectors(chunks, list(keys), "x", dim, name="x", mean=True)
