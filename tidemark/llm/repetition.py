"""Runs of periodically repeated words, by scale tiles.

A word i matches at period p if word i + p is the same. A run of smallest period q is a maximal
stretch of at least q such matches. Periods are taken by octave [2**k, 2**(k + 1)): boundaries
2**k words apart then hit every stretch of the octave, each of its matches at a boundary c is seen
by comparing the word at c with the block that follows, and the Z-function at c (the common
extension of the text from c and from c + p, to the right and to the left) gives the stretch as
far as the tile reaches. A tile holds the words around some boundaries. Tiles are solved each on
its own; fragments of one document and period that touch are one stretch, found by a shuffle on
(document, period). A stretch with several periods belongs to the smallest.

A text that fits in a tile is one tile for all octaves, solved and collapsed where it lies; a
longer one is dealt out, tile by tile. Equality of spans is that of two 31-bit modular sums over
64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table
from .words import buffers, in_document, pieces, small_batches, split

#: Runs shorter than this many words are no runs.
LEAST = 12
#: Words in a tile's core for the small periods, and boundaries in the core of a tile of larger ones.
TILE, CORE = 1 << 14, 16
#: Texts of at most so many bytes are one tile.
WHOLE = 1 << 16
_PRIMES = (2147483647, 2147483629)
_BASES = (1000003579, 715225741)
_powers = [np.ones(1, np.uint64) for _ in _PRIMES]


def _power(which: int, n: int) -> np.ndarray:
    """The base's first n powers modulo its prime; grown by doubling and kept."""
    prime = _PRIMES[which]
    while len(_powers[which]) < n:
        old = _powers[which]
        _powers[which] = np.concatenate([old, old * np.uint64(pow(_BASES[which], len(old), prime)) % np.uint64(prime)])
    return _powers[which][:n]


class Spans:
    """Equality of word spans of one tile."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.sums = []
        for which, prime in enumerate(_PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(x % np.uint64(prime) * _power(which, self.n + 1)[: self.n] % np.uint64(prime), out=sums[1:])
            self.sums.append(sums % np.uint64(prime))

    def same(self, at: np.ndarray, period: np.ndarray, length: int) -> np.ndarray:
        """Whether the spans of this length at `at` and at + period lie in the tile and are equal."""
        inside = (at >= 0) & (at + period + length <= self.n)
        i = np.where(inside, at, 0)
        j = np.where(inside, at + period, 0)
        width = np.where(inside, length, 0)
        for which, prime in enumerate(_PRIMES):
            s, p = self.sums[which], np.uint64(prime)
            left = (s[i + width] + p - s[i]) % p * _power(which, self.n + 1)[np.where(inside, period, 0)] % p
            inside &= left == (s[j + width] + p - s[j]) % p
        return inside

    def z(self, at: np.ndarray, period: np.ndarray, octave: int, forward: bool) -> np.ndarray:
        """The Z-function at a boundary: how far the text at `at` and at + period agrees, to the right or left, up to 2**(octave + 2) - 1 words."""
        far = np.zeros(len(at), np.int64)
        for bit in range(octave + 1, -1, -1):
            length = 1 << bit
            far += length * self.same(at + far if forward else at - far - length, period, length)
        return far


def joined(period: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [a, b) of one period that touch are one."""
    if not len(period):
        return period, a, b
    order = np.lexsort((a, period))
    period, a, b = period[order], a[order], b[order]
    high = np.int64(max(b.max(), 0) + 1)
    _, rank = np.unique(period, return_inverse=True)
    end = np.maximum.accumulate(b + rank * high) - rank * high
    opens = np.ones(len(a), bool)
    opens[1:] = (period[1:] != period[:-1]) | (a[1:] > end[:-1])
    first = np.flatnonzero(opens)
    return period[first], a[first], np.maximum.reduceat(b, first)


def fragments(x: np.ndarray, lo: int, hi: int, octaves: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first match, after the last) of the stretches seen from the boundaries in [lo, hi) of a tile x."""
    spans, n, found = Spans(x), len(x), []
    for k in octaves:
        step = 1 << k
        m = -(-(min(hi, n) - lo) // step)
        if lo + 2 * step > n or m <= 0:
            break
        blocks = np.zeros((m + 1) * step, x.dtype)
        part = x[lo : lo + len(blocks)]
        blocks[: len(part)] = part
        blocks = blocks.reshape(m + 1, step)
        hit = np.flatnonzero((blocks[1:] == blocks[:-1, :1]).ravel())
        c, p = lo + (hit >> k) * step, step + (hit & (step - 1))
        real = c + p < n
        c, p = c[real], p[real]
        if step > 1:  # of p matches around c, half a block lies on one side of it
            half = step // 2
            near = spans.same(c, p, half)
            near[~near] = spans.same(c[~near] - half, p[~near], half)
            c, p = c[near], p[near]
        left, right = spans.z(c, p, k, False), spans.z(c, p, k, True)
        enough = left + right >= p
        found.append((p[enough], (c - left)[enough], (c + right)[enough]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return joined(*(np.concatenate(part) for part in zip(*found, strict=True)))


def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of x, by start, then period."""
    period, a, b = fragments(x, 0, len(x), range(64))
    enough = (b - a >= period) & (b - a + period >= LEAST)
    period, start, end = period[enough], a[enough], (b + period)[enough]
    order = np.lexsort((period, end, start))
    period, start, end = period[order], start[order], end[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    period, start, end = period[first], start[first], end[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "id {id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _listed(offsets: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], fields=list(RUN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one tile: runs and collapsed texts."""
    for batch in batches:
        for at, to, data, offsets in pieces(batch.column("body")):
            w = split(data, offsets)
            start, length, period = whole(in_document(w.hash, w.doc))
            bounds = np.searchsorted(start, w.first)
            first, raw = w.first, data.tobytes()
            texts = []
            for d in range(to - at):
                own = slice(bounds[d], bounds[d + 1])
                texts.append(collapsed(raw[offsets[d] : offsets[d + 1]].split(), start[own] - first[d], length[own], period[own]))
            doc = np.repeat(np.arange(to - at), np.diff(bounds))
            columns = [batch.column("id").slice(at, to - at), pa.array(np.diff(first), pa.int64()), _listed(bounds, start - first[doc], length, period), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


TILES = "key string, start long, lo long, hi long, low int, high int, words binary"


def cut(n: int, tile: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first word, after the last, core from, core to, lowest octave, one above the highest) of a text's tiles; a tile reaches as far as its octaves' Z-functions."""
    low = 0
    while (2 << low) <= n:
        high = max(low + 1, (tile // 8).bit_length()) if low == 0 else low + 1
        core = max(tile if low == 0 else 0, CORE << low)
        side = 4 << (high - 1)
        for lo in range(0, n, core):
            yield max(0, lo - side), min(n, lo + core + 2 * side), lo, min(n, lo + core), low, high
        low = high


def _explode(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            data, offsets = buffers(batch.column("body"))
            for d in range(len(offsets) - 1):
                part = data[offsets[d] : offsets[d + 1]]
                x = split(part, np.array([0, len(part)])).hash
                for first, last, lo, hi, low, high in cut(len(x), tile):
                    row = [[keys[d].as_py()], [first], [lo - first], [hi - first], [low], [high], [x[first:last].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[c.split()[0] for c in TILES.split(", ")])

    return run


def _tiles_solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, start, lo, hi, low, high, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            period, a, b = fragments(np.frombuffer(words, np.uint64), lo, hi, range(low, high))
            if len(period):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(period), pa.string()), *(pa.array(v, pa.int64()) for v in (period, a + start, b + start))], names=["key", "period", "a", "b"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = (batch.column("body")[i].as_py() or "").encode().split()
            runs = batch.column("runs").slice(i, 1)
            found = runs.flatten()
            one = [found.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            order = np.lexsort((one[2], one[0]))
            one = [v[order] for v in one]
            columns = [batch.column("id").slice(i, 1), pa.array([len(words)], pa.int64()), _listed(np.array([0, len(order)]), *one), pa.array([collapsed(words, *one)], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def stitched(found: DataFrame) -> DataFrame:
    """(key, runs) from the fragments of all tiles: those of one key and period that touch are one stretch, of which the smallest period counts. Fragments given twice change nothing."""
    order = W.partitionBy("key", "period").orderBy("a", "b")
    opens = F.col("a") > F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = found.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("long")).withColumn("part", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    stretches = parts.groupBy("key", "period", "part").agg(F.min("a").alias("start"), (F.max("b") + F.first("period")).alias("end"))
    runs = stretches.where((F.col("end") - F.col("start") >= 2 * F.col("period")) & (F.col("end") - F.col("start") >= LEAST)).groupBy("key", "start", "end").agg(F.min("period").alias("period"))
    return runs.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")).alias("runs"))


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, whole_bytes: int = WHOLE) -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the text without the repeats inside runs.

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are judged one by
    one: repeated rows and null ids get rows of their own, other columns are not read. Texts of more
    than whole_bytes bytes are cut into tiles of about `tile` words (more for larger periods), which
    are solved in any order and on any executor; no tile is larger than a small multiple of its
    octave's periods.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("body"))
    small_batches(docs)
    size = F.octet_length("body")
    schema = FOUND.format(id=docs.schema[id_col].dataType.simpleString())
    short = rows.where(size <= whole_bytes).mapInArrow(_solved, schema)
    long = rows.where(size > whole_bytes).withColumn("key", F.sha2("body", 256))
    tiles = long.select("key", "body").mapInArrow(_explode(tile), TILES).repartition("key", "start", "low")
    found = stitched(tiles.mapInArrow(_tiles_solved, "key string, period long, a long, b long"))
    none = F.array().cast("array<struct<start: long, length: long, period: long>>")
    rest = long.join(found, "key", "left").select("id", "body", F.coalesce("runs", none).alias("runs")).mapInArrow(_finished, schema)
    return short.unionByName(rest).withColumnRenamed("id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: of ids whose crc32 ends in 0, the words from a place on repeat a stretch of them. Rows without an id keep theirs."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    # The words are bound once by a list of one, so that they are not found anew for each index.
    some = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))
    return F.when(h % 10 == 0, F.get(some, F.lit(0))).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the planted texts of documents: their number, the longest (nulls without one) and the digests of all runs and of the collapsed text. Null and empty texts have none."""
    docs = table(spark, sf_dir, "documents")
    found = runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "collapsed", best.alias("best"), F.sha2(lines, 256).alias("runs_sha256")
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
