"""Encoders and rerankers: model operators with the model injected.

An encoder is any picklable object with ``encode(texts) -> array [n, d]``; it may have
``encode_query`` and ``encode_document`` instead. It is loaded once per Python worker, in
an iterator UDF. ``HashEncoder`` is a deterministic stand-in for tests, without any claim
to quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylight.operators.dense import top_k
from quarrylight.schemas import require


@dataclass
class HashEncoder:
    """Words hashed to signed dimensions and counted; the same text always has the same vector."""

    dimension: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        return out


def encode_texts(encoder: Any, texts: list[str], role: str, normalize: bool = False) -> np.ndarray:
    """The [n, d] vectors of texts by an encoder's method for the role, or its plain one."""
    if not texts:
        return np.zeros((0, 0), np.float32)
    method = getattr(encoder, f"encode_{role}", None) or encoder.encode
    vectors = np.asarray(method(list(texts)), np.float32)
    vectors = vectors.reshape(1, -1) if vectors.ndim == 1 else vectors
    if len(vectors) != len(texts):
        raise ValueError("the encoder gave another number of vectors than texts")
    if normalize:
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    return vectors


def embed(df: DataFrame, load: Callable[[], Any], role: str = "document", content: str = "content", out: str = "embedding", normalize: bool = False, batch_size: int = 32, blanks: str = "allow") -> DataFrame:
    """``df`` with a vector ``out`` of each content; ``load`` makes the encoder, once per worker.

    A null content raises on reading, and so does a blank one with ``blanks='error'``.
    """
    if role not in ("query", "document"):
        raise ValueError("role must be 'query' or 'document'")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            rows = [v.tolist() for at in range(0, len(texts), batch_size) for v in encode_texts(encoder, list(texts[at : at + batch_size]), role, normalize)]
            yield pd.Series(rows, dtype=object)

    ok = F.col(content).isNotNull()
    if blanks == "error":
        ok &= F.col(content).rlike(r"\S")
    return require(df, ok, f"a {role} has no text").withColumn(out, run(F.col(content)))


def rerank(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], Any]], k: int = 10, scale_score: bool = False, calibration_factor: float = 1.0, score_threshold: float | None = None, query: str = "query_id") -> DataFrame:
    """(pairs' columns, score, rank): candidates by a cross-encoder, best k of each query.

    ``pairs`` has query_content and content. ``load`` makes a function of two lists of texts
    that gives raw scores; ``scale_score`` maps them by the logistic function of score times
    calibration factor. Scores below the threshold are left out.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for asked, texts in batches:
            yield pd.Series(np.asarray(model(list(asked), list(texts)), np.float64))

    checked = require(pairs, F.col("query_content").isNotNull() & F.col("content").isNotNull(), "a pair has no text")
    raw = run("query_content", "content")
    score = F.lit(1.0) / (1.0 + F.exp(-raw * F.lit(float(calibration_factor)))) if scale_score else raw
    scored = checked.withColumn("score", score)
    if score_threshold is not None:
        scored = scored.where(F.col("score") >= score_threshold)
    return top_k(scored, k, query)
