"""Recursive splitting of documents into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylight.schemas import require

#: Separators from coarse to fine; the empty one cuts anywhere. Fixed values.
SEPARATORS = ("\n\n", "\n", " ", "")


def _parts(text: str, separators: tuple[str, ...], size: int, length: Callable[[str], int]) -> list[tuple[str, int]]:
    """The text as pieces (piece, its length) of at most ``size`` where separators allow; each but the
    first of a cut begins with the separator that stood before it."""
    whole = length(text)
    if whole <= size or not text:
        return [(text, whole)] if text else []
    separator = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(separator) + 1 :] if separator in separators else ()
    if not separator:
        return [(c, length(c)) for c in text]
    cells = text.split(separator)
    joined = [cells[0], *(separator + c for c in cells[1:])]
    out: list[tuple[str, int]] = []
    for cell in joined:
        if not cell:
            continue
        n = length(cell)
        out += [(cell, n)] if n <= size else _parts(cell, finer or ("",), size, length)
    return out


def split_recursively(text: str, chunk_size: int = 360, chunk_overlap: int = 60, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``chunk_size`` that repeat at most ``chunk_overlap`` of the one before, blank ones left out.

    Pieces are gathered until the next would exceed the size; the next chunk begins with as
    many of the last pieces as the overlap holds. Chunks are stripped. With a ``length`` that
    isn't additive (a tokenizer's), sizes hold up to what joining pieces changes.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece, n in _parts(text, separators, chunk_size, length):
        if held and total + n > chunk_size:
            out.append("".join(p for p, _ in held))
            while held and (total > chunk_overlap or total + n > chunk_size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    if held:
        out.append("".join(p for p, _ in held))
    return [c for c in (c.strip() for c in out) if c]


def token_length(path: str) -> Callable[[str], int]:
    """The number of tokens of a text by a tokenizer file, without special tokens; loaded at first use."""
    loaded: list = []

    def length(text: str) -> int:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return len(loaded[0].encode(text, add_special_tokens=False).ids)

    return length


def chunk_documents(df: DataFrame, chunk_size: int = 360, chunk_overlap: int = 60, tokenizer_path: str | None = None, key: str = "id", content: str = "content") -> DataFrame:
    """Chunks of documents: all columns but ``embedding``, with a new id and three more columns.

    id is ``{id}::chunk-{i}``; ``source_document_id``, ``chunk_index``, ``chunk_count`` count the
    chunks that are kept. A document without text but blanks has none. A null id or content
    raises on reading. Length is characters, or tokens of ``tokenizer_path``.
    """
    if chunk_size <= 0 or not 0 <= chunk_overlap <= chunk_size:
        raise ValueError("chunk_size must be positive and the overlap within it")

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = token_length(tokenizer_path) if tokenizer_path else len
        for texts in batches:
            yield texts.map(lambda t: split_recursively(t, chunk_size, chunk_overlap, measure) if t else [])

    checked = require(df, F.col(key).isNotNull() & F.col(content).isNotNull(), "a document has no id or no content")
    old = [c for c in df.columns if c not in ("embedding", "source_document_id", "chunk_index", "chunk_count")]
    rows = checked.select(*old, split(F.col(content)).alias("_chunks"))
    spread = rows.select(*old, F.size("_chunks").alias("chunk_count"), F.posexplode("_chunks").alias("chunk_index", "_chunk"))
    named = spread.withColumn("source_document_id", F.col(key).cast("string"))
    return named.withColumn(key, F.concat(F.col("source_document_id"), F.lit("::chunk-"), F.col("chunk_index").cast("string"))).withColumn(content, F.col("_chunk")).drop("_chunk")
