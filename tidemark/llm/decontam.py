"""Benchmark decontamination by SimHash windows.

Every document is read in windows of each benchmark item's own length, one shorter than the item
as one window, whole. A window's SimHash is
compared with the items' through a multi-index: the fingerprint is cut into blocks, and two
fingerprints within RADIUS bits differ in some block by RADIUS / BLOCKS bits at most, so a table
of each block's near values finds all of them. Candidates are verified by the exact similarity
of their shingle weights (counts): sum of minima over sum of maxima.

A window can only be that similar to an item if most of its shingles are shingles of some item,
so windows that hold too few of them are not fingerprinted.

A similar window lies beyond RADIUS with a probability of about 1 in 70,000. With exact=True each
window that holds enough shingles is a candidate for every item of its length, and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import LOWER, buffers, mixed, pieces, shingles, small_batches, split, whole_hash, windows

SHINGLE = 5
SIMILARITY = 0.75
#: At similarity 0.75 fingerprints differ in 22 of 128 bits on average, standard deviation about 4.3.
BITS, BLOCKS, RADIUS = 128, 8, 40
#: Items in one pass: what a task holds and the closure carries is bounded by it.
ITEMS = 1024
_BLOCK_BITS = BITS // BLOCKS


def _signs(h: np.ndarray) -> np.ndarray:
    """BITS signs, 1 or -1, of each shingle hash."""
    words = np.stack([mixed(h ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1))) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Packed 16-bit blocks of each row of sign sums; a tie is 1."""
    return np.packbits(sums >= 0, axis=1).view(np.uint16)


class Items:
    """Benchmark items: shingle weights, fingerprints and the tables of near block values."""

    def __init__(self, ids: list, texts: list) -> None:
        data, offsets = buffers(pa.array(texts, pa.string()))
        w = split(LOWER[data], offsets)
        doc, h = shingles(w, SHINGLE)
        size = np.diff(w.first)
        self.ids, self.words, self.weights, prints = [], [], [], []
        for k in range(len(ids)):
            if size[k]:
                own = h[doc == k]
                self.ids.append(ids[k])
                self.words.append(int(size[k]))
                self.weights.append(np.unique(own, return_counts=True))
                prints.append(_signs(own).sum(axis=0))
        self.words = np.array(self.words, np.int64)
        self.all = np.unique(np.concatenate([x for x, _ in self.weights])) if self.weights else np.zeros(0, np.uint64)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.all & np.uint64(len(self.low) - 1)] = True
        self.prints = _fingerprints(np.array(prints, np.int32).reshape(-1, BITS))
        self.lengths = np.unique(self.words)
        self._near: np.ndarray | None = None

    def near(self) -> np.ndarray:
        """near[block, value, :]: packed flags of the items whose block is within RADIUS // BLOCKS bits of the value."""
        if self._near is None:
            values = np.arange(1 << _BLOCK_BITS, dtype=np.uint16)
            flags = np.zeros((BLOCKS, len(values), (len(self.ids) + 7) // 8), np.uint8)
            for b in range(BLOCKS):
                for at in range(0, len(self.ids), 64):
                    close = np.bitwise_count(values[:, None] ^ self.prints[None, at : at + 64, b]) <= RADIUS // BLOCKS
                    flags[b, :, at // 8 : at // 8 + 8] = np.packbits(close, axis=1)
            self._near = flags
        return self._near


def _near_items(items: Items, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of the fingerprints and items of n words within RADIUS of each other, by the multi-index."""
    flags = np.zeros((len(prints), items.near().shape[2]), np.uint8)
    for k in range(BLOCKS):
        flags |= items.near()[k, prints[:, k]]
    row, item = np.nonzero(np.unpackbits(flags, axis=1)[:, : len(items.ids)] & (items.words == n))
    close = np.bitwise_count(prints[row] ^ items.prints[item]).sum(axis=1) <= RADIUS
    return row[close], item[close]


def find(items: Items, data: np.ndarray, offsets: np.ndarray, exact: bool = False) -> list[tuple[int, int, float, int, int]]:
    """(document, item, similarity, first word, words) of each document's best window for each item that it leaks."""
    if not len(items.all):
        return []
    w = split(data, offsets)
    at, h = windows(w, SHINGLE)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    hit = items.low[h & np.uint64(len(items.low) - 1)]
    some = np.flatnonzero(hit)
    hit[some] = items.all[np.minimum(np.searchsorted(items.all, h[some]), len(items.all) - 1)] == h[some]
    of_word = w.doc
    docs = np.unique(of_word[at[hit]])
    hit_at = at[hit]
    longest = int(items.lengths[-1])
    for d in docs:
        first, last = int(w.first[d]), int(w.first[d + 1])
        hits = hit_at[np.searchsorted(hit_at, first) : np.searchsorted(hit_at, last)]
        # Stretches of the document that hold hits, with an item's length on either side.
        cut = np.flatnonzero(np.diff(hits) > 2 * longest) + 1
        for group in np.split(hits, cut):
            a, b = max(first, int(group[0]) - longest), min(last, int(group[-1]) + longest + SHINGLE)
            lo, hi = np.searchsorted(at, a), np.searchsorted(at, b - SHINGLE + 1)
            own, own_hit = h[lo:hi], hit[lo:hi]
            sums = None if exact else np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(own), axis=0, dtype=np.int32)])
            hits_to = np.concatenate([[0], np.cumsum(own_hit)])
            for n in items.lengths:
                m = int(n) - SHINGLE + 1
                if m < 1:
                    continue
                # A stretch is shorter than the longest item only if it is the whole document.
                size = min(m, len(own))
                # At SIMILARITY or more, windows of size and m shingles share SIMILARITY / (1 + SIMILARITY) of their sum.
                starts = np.flatnonzero(hits_to[size:] - hits_to[: len(hits_to) - size] >= SIMILARITY / (1 + SIMILARITY) * (size + m) - 1e-9)
                if not len(starts):
                    continue
                if exact:
                    of_size = np.flatnonzero(items.words == n)
                    row, item = np.repeat(np.arange(len(starts)), len(of_size)), np.tile(of_size, len(starts))
                else:
                    row, item = _near_items(items, int(n), _fingerprints(sums[starts + size] - sums[starts]))
                for r, i in zip(row.tolist(), item.tolist(), strict=True):
                    found, times = np.unique(own[starts[r] : starts[r] + size], return_counts=True)
                    _, x, y = np.intersect1d(found, items.weights[i][0], assume_unique=True, return_indices=True)
                    least = int(np.minimum(times[x], items.weights[i][1][y]).sum())
                    similarity = least / (size + m - least)
                    if similarity >= SIMILARITY and similarity > best.get((int(d), i), (0.0, 0, 0))[0]:
                        best[int(d), i] = (similarity, a + int(starts[r]) - first, size + SHINGLE - 1)
    # Items shorter than a shingle are one shingle, their whole sequence.
    for n in items.lengths[items.lengths < SHINGLE]:
        starts, _ = windows(w, int(n))
        for i in np.flatnonzero(items.words == n):
            for s in starts[whole_hash(w, starts, int(n)) == items.weights[i][0][0]][::-1]:
                best[int(of_word[s]), int(i)] = (1.0, int(s - w.first[of_word[s]]), int(n))
    return [(d, i, similarity, start, size) for (d, i), (similarity, start, size) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", exact: bool = False) -> DataFrame:
    """One row for each document and item found in it: id, item, similarity, first_word, n_words of the best window.

    Words are lower-cased for A-Z. Null and empty texts and items match nothing; an item of fewer
    than SHINGLE words matches as a whole. Equal items are each reported. Repeated rows of docs
    are each reported, null ids too. Items are worked on ITEMS at a time, so that what a task
    holds is bounded whatever the benchmark's size; each block of items is one pass over docs.

    exact: compare every window that holds enough shingles of the benchmark with all items of its
    length, so that none is missed.
    """
    rows = benchmark.select(F.col(item_col).alias("i"), F.col("text").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator()
    small_batches(docs)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    key_type = base.schema["id"].dataType.simpleString()
    found, ids, texts = None, [], []

    def one(ids: list, texts: list) -> DataFrame:
        items = Items(ids, texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in pieces(batch.column(1), lower=True):
                    got = find(items, data, offsets, exact)
                    part = batch.column(0).slice(a, b - a).take(pa.array([x[0] for x in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array([items.ids[x[1]] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.float64()), pa.array([x[3] for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64())],
                        names=[id_col, item_col, "similarity", "first_word", "n_words"],
                    )

        return base.mapInArrow(run, f"`{id_col}` {key_type}, `{item_col}` long, similarity double, first_word long, n_words long")

    for row in rows:
        ids.append(row.i)
        texts.append(row.t)
        if len(ids) == ITEMS:
            found, ids, texts = one(ids, texts) if found is None else found.unionByName(one(ids, texts)), [], []
    if ids or found is None:
        found = one(ids, texts) if found is None else found.unionByName(one(ids, texts))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", exact: bool = False) -> DataFrame:
    """The rows of docs, columns unchanged, whose text leaks no item; a narrow pass for each ITEMS items. Null texts stay; exact as in leaks."""
    small_batches(docs)
    schema, column = docs.schema, docs.columns.index(text_col)
    items_of = benchmark.select(F.col(item_col).alias("i"), F.col("text").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator()
    out, block = docs, []

    def one(rows: DataFrame, block: list) -> DataFrame:
        items = Items(*map(list, zip(*block, strict=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in pieces(batch.column(column), lower=True):
                    for d, *_ in find(items, data, offsets, exact):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, schema)

    for row in items_of:
        block.append((row.i, row.t))
        if len(block) == ITEMS:
            out, block = one(out, block), []
    return one(out, block) if block else out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of every leak in documents; see leaks for nulls, ties and empty texts."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
