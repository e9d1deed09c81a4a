"""Words and shingles of Arrow text columns as numpy arrays.

Texts stay the UTF-8 bytes Arrow holds. A word's hash comes from differences of one running
polynomial sum over the bytes, so a batch of documents costs a few vector operations, not a
Python call for each word. Hashes are 64 bits and mixed; equal words have equal hashes in every
task and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([pow(0xD1342543DE82EF95, j + 1, 1 << 64) | 1 for j in range(16)], np.uint64)
#: Bytes of text worked on at once; a longer document is worked on alone.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64; grown by doubling and kept."""
    while len(_powers["up"]) < n:
        k = len(_powers["up"])
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            old = _powers[name]
            _powers[name] = np.concatenate([old, old * np.uint64(pow(base, k, 1 << 64))])
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # the byte after its last
    hash: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words
    sums: np.ndarray  # running sums for span_hash

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    down = powers(len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of documents data[offsets[i]:offsets[i + 1]]; offsets start at 0."""
    n = len(data)
    up = powers(n + 1)[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = ~space & edge[:n]
    opens[1:] |= ~space[1:] & space[:-1]
    closes = ~space & edge[1:]
    closes[:-1] |= ~space[:-1] & space[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, span_hash(sums, start, end), np.searchsorted(start, offsets), sums)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of k words inside a document."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = w.hash[: n - k + 1] * _STEPS[0]
    for j in range(1, k):
        h = h + w.hash[j : n - k + 1 + j] * _STEPS[j]
    last = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last[: n - k + 1])
    return at, mixed(h[at])


def whole_hash(w: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words at each of starts as one shingle."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = np.full(len(starts), n, np.uint64)
    for j in range(n):
        h = mixed(h ^ w.hash[starts + j] * _STEPS[j + 8])
    return h


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k-word shingle, repeats included, by document; a document of 1 to k - 1 words has one, its whole sequence."""
    at, h = windows(w, k)
    n = np.diff(w.first)
    doc = w.doc[at] if len(at) else at
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            doc, h = np.concatenate([doc, short]), np.concatenate([h, whole_hash(w, w.first[short], m)])
    if (n[n > 0] < k).any():
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def in_document(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """h made different for each document of a piece."""
    return mixed(h + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about PIECE bytes at most."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield at, to, LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at]
        at = to


def map_texts(df: DataFrame, text_col: str, make: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray | pa.Array]], added: str, lower: bool = False) -> DataFrame:
    """df's columns and those that make(bytes, offsets) returns for each piece, in the order of the DDL `added`."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    schema = StructType([*df.schema.fields, *new.fields])
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(text_col), lower):
                columns = make(data, offsets)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *[pa.array(columns[f.name]) for f in new.fields]], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Arrow batches of whole texts are kept to this many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
