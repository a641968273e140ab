"""Encoding with a public byte-level BPE: ids, character offsets, decoding, and counts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Where the public vocabulary files lie; a parameter, never part of the repository.
TOKENIZERS = os.environ.get("QUARRYLIGHT_TOKENIZERS", "/opt/tokenizers")
DEFAULT = f"{TOKENIZERS}/byte_bpe_50k.json"

#: Texts go to the library in groups of about so many characters, which bounds its memory.
GROUP_CHARS = 200_000
#: A longer text is encoded in segments; see :func:`segments`.
SEGMENT_CHARS = 100_000
SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file; its special tokens' strings count as plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_truncation()
    found.no_padding()
    return found


def byte_table() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, built from its rule.

    Printable Latin-1 bytes stand for themselves, the others are counted up from 256.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    table = byte_table()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = added[i].encode() if i in added else bytes(table[c] for c in piece)
    return out


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Cuts a long text where no token can cross: before white space that follows something else.

    The pre-tokenizer's pattern never joins a character with white space after it, and its
    look-ahead only concerns a run of white space and what follows, which stay together.
    A stretch without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = next((m.start() for m in SAFE_CUT.finditer(text, start + size)), None)
        if cut is None:
            break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def encode(texts: list[str | None], path: str = DEFAULT) -> list[np.ndarray]:
    """The ids of each text, without special tokens; null and empty texts give empty lists."""
    found = tokenizer(path)
    parts: list[tuple[int, str]] = [(i, s) for i, t in enumerate(texts) if t for s in segments(t)]
    out: list[list] = [[] for _ in texts]
    start = 0
    while start < len(parts):
        end, n = start, 0
        while end < len(parts) and (n == 0 or n + len(parts[end][1]) <= GROUP_CHARS):
            n += len(parts[end][1])
            end += 1
        for (i, _), e in zip(parts[start:end], found.encode_batch_fast([s for _, s in parts[start:end]], add_special_tokens=False), strict=True):
            out[i].append(e.ids)
        start = end
    return [np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32) for ids in out]


def offsets(text: str, ids: np.ndarray, path: str = DEFAULT) -> list[tuple[int, int]]:
    """The characters (start, end) of each token, end exclusive.

    Bytes are mapped to characters; a token that holds some bytes of a character covers
    it, so tokens that split a character overlap in it.
    """
    pieces = token_bytes(path)
    ends = np.cumsum([len(pieces[i]) for i in ids]) if len(ids) else np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.r_[0, ends[:-1]] if len(ids) else ends
    return [(int(char_of[s]), int(char_of[e - 1]) + 1) for s, e in zip(starts, ends, strict=True)]


def decode(ids: list[int] | np.ndarray | None, path: str = DEFAULT) -> str:
    """The text of ids: their bytes joined first, so characters split over tokens come back whole.

    Ids cut inside a character give U+FFFD for the broken part.
    """
    pieces = token_bytes(path)
    return b"".join(pieces[i] for i in (ids if ids is not None else ())).decode("utf-8", "replace")


def encode_documents(df: DataFrame, key: str, text: str, path: str = DEFAULT, out: str = "ids") -> DataFrame:
    """(key, ids ARRAY<INT>): one row per row of ``df``, whatever its other columns are.

    Null and empty texts give the empty list. Whole texts are encoded, long ones in
    segments with the same result. Only ``key`` and ``text`` are read and sent to Python.
    """
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encode(part.column(1).to_pylist(), path)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["key", out])

    chosen = df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].cast("string").alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_documents(df: DataFrame, key: str, ids: str, path: str = DEFAULT, out: str = "decoded") -> DataFrame:
    """(key, decoded STRING): the text of each row's ids; null and empty lists give the empty text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(v.values.to_numpy() if v.is_valid else None, path) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    return df.select(df[f"`{key}`"].alias(key), df[f"`{ids}`"]).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str = DEFAULT, out: str = "n_tokens") -> DataFrame:
    """(keys..., n_tokens BIGINT): the number of ids of each row's text; 0 for null and empty texts."""
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = pa.array([len(x) for x in encode(part.column(len(keys)).to_pylist(), path)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], names=[*keys, out])

    chosen = df.select(*(df[f"`{k}`"].alias(k) for k in keys), df[f"`{text}`"].cast("string").alias("_text"))
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType(), False)]))
