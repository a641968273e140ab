"""Top-k search of a block of sparse queries over a partition of sparse documents.

A block's queries are held as an inverted index, key number -> (queries, weights). Documents
pass by once; their matches are looked up and added up in Arrow and numpy, and every query
keeps its best. So a partition gives at most k rows a query, whatever the lengths of posting
lists are.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Documents whose matches are added up together.
ROWS = 256


def arrow_types(schema: T.StructType) -> list:
    """The Arrow types of a flat schema of strings, integers and doubles."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return [kinds[f.dataType.simpleString()] for f in schema]


def keep_best(kept: list, k: int, tie: Callable | None) -> None:
    """Cuts (score, id) pairs to the k best: score descending, then by ``tie`` of ids ascending, or ids as text descending."""
    if tie is None:
        kept.sort(key=lambda x: str(x[1]), reverse=True)
    else:
        kept.sort(key=lambda x: tie(x[1]))
    kept.sort(key=lambda x: -x[0])
    del kept[k:]


@dataclass(frozen=True)
class Index:
    """Posting lists of a block's queries: the n-th key has a stretch of query numbers and weights."""

    keys: list[Hashable]
    start: np.ndarray
    length: np.ndarray
    queries: np.ndarray
    weights: np.ndarray


def query_index(queries: Iterable[tuple[Hashable, Iterable, Iterable]]) -> tuple[list, Index]:
    """(ids, index) of queries given as (id, keys, weights)."""
    ids: list = []
    lists: dict[Hashable, tuple[list, list]] = {}
    for q, keys, weights in queries:
        for key, w in zip(keys, weights, strict=True):
            at, values = lists.setdefault(key, ([], []))
            at.append(len(ids))
            values.append(w)
        ids.append(q)
    length = np.array([len(a) for a, _ in lists.values()], np.int64)
    flat = lambda i, kind: np.array([x for pair in lists.values() for x in pair[i]], kind)
    return ids, Index(list(lists), np.cumsum(length) - length, length, flat(0, np.int64), flat(1, np.float64))


def looked_up(lists: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, number): the entries of a list column that are among ``keys``, by their row and place in all entries."""
    numbers = pc.index_in(lists.flatten(), value_set=keys)
    place = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
    rows = pc.list_parent_indices(lists).to_numpy()[place]
    return rows, place, numbers.drop_null().to_numpy().astype(np.int64)


def best_of_partition(ids: list, index: Index, k: int, digits: int | None, schema: T.StructType, least: float = -np.inf, tie: Callable | None = None, weigh: Callable | None = None):
    """A function over batches of documents (id, keys, weights, ...) that yields (query, id, score) of the best of each query.

    ``weigh(weights, rows, batch)`` turns the weights of the entries that matched, of the given
    rows, into others. Only documents that share a key with a query, and score above
    ``least``, count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        keys = None
        for whole in batches:
            if keys is None:
                keys = pa.array(index.keys, whole.schema.field(1).type.value_type)
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows, place, found = looked_up(batch.column(1), keys)
                if not len(rows):
                    continue
                weights = batch.column(2).flatten().to_numpy(zero_copy_only=False)[place].astype(np.float64)
                if weigh is not None:
                    weights = weigh(weights, rows, batch)
                n_rows = batch.num_rows
                sizes = index.length[found]
                ends = np.cumsum(sizes)
                take = np.arange(ends[-1]) + np.repeat(index.start[found] - ends + sizes, sizes)
                cell = index.queries[take] * n_rows + np.repeat(rows, sizes)
                used, cells = np.unique(cell, return_inverse=True)
                scores = np.bincount(cells, index.weights[take] * np.repeat(weights, sizes))
                if digits is not None:
                    scores = np.round(scores, digits) + 0.0
                wanted = scores > least
                used, scores = used[wanted], scores[wanted]
                if not len(used):
                    continue
                asking = used // n_rows
                names = batch.column(0).to_pylist()
                starts = np.flatnonzero(np.r_[True, asking[1:] != asking[:-1]])
                for s, e in zip(starts, np.r_[starts[1:], len(asking)], strict=True):
                    q, mine = int(asking[s]), scores[s:e]
                    bound = -np.partition(-mine, k - 1)[k - 1] if len(mine) > k else -np.inf
                    kept = best.setdefault(q, [])
                    kept.extend((float(mine[j]), names[int(used[s + j] % n_rows)]) for j in np.flatnonzero(mine >= bound))
                    if len(kept) > 4 * k:
                        keep_best(kept, k, tie)
        out = []
        for q, kept in best.items():
            keep_best(kept, k, tie)
            out += [(ids[q], d, s) for s, d in kept]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow_types(schema), strict=True)], names=schema.fieldNames())

    return run
