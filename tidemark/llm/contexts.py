"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each of the 255 places inside a byte has a tree of its own over
the bytes before it, to DEPTH bytes back. A node holds how often its decision was 0 and 1 in the
training texts; its Krichevsky-Trofimov block probability and the product of its children's
weighted ones are mixed half and half, from the deepest nodes up. What a decision is given is the
mixture of the nodes on its path, each weighed by what it earned against its children; a context
that training never saw ends the mixture at the one before it. Texts are read with A-Z in lower
case and end in a byte that no text holds, so the sum over all texts is one and a text's score is
its code length.

Everything follows from counts of grams (the DEPTH bytes before a byte, and the byte), exact
64-bit keys. Texts are dealt out to buckets by content. A bucket asks for the grams it holds, with
its training counts; requests meet by the last three bytes of context, where the trees of these
contexts are whole; only nodes of at most two bytes, 65,536 x 255 at the very most, are summed over
groups and sent to all. Answers return to the buckets, which read their texts once more. A bucket's
memory is that of its different grams. Counts of words for the base score go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import saved, table
from .words import pieces, small_batches, split

DEPTH = 6
#: Bytes of text for a bucket, and for a group of contexts; groups beyond MOST_GROUPS grow instead.
BUCKET, GROUP, MOST_GROUPS = 1 << 27, 1 << 21, 1 << 16
#: Ends each text and stands before it: no byte of UTF-8.
EDGE = 255
GRAM, WORD, TEXT = 0, 1, 2
_SLOTS = 256
_PART = 1 << 21
_CUT = 3  # contexts of so many bytes are whole in one group
_TOP = _CUT - 1
_LN_HALF = float(np.log(0.5))
_TABLE = 1 << 16
_LOG_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, _TABLE)))])
_LOG_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    out = _LOG_FACT[np.minimum(n, _TABLE - 1)]
    big = n >= _TABLE
    if big.any():
        z = n[big] + 1.0
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z)
    return out


def log_halves(n: np.ndarray) -> np.ndarray:
    """The logarithm of 1/2 x 3/2 x ... x (n - 1/2)."""
    out = _LOG_HALF[np.minimum(n, _TABLE - 1)]
    big = n >= _TABLE
    if big.any():
        z = n[big] + 0.5
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 0.5 * np.log(np.pi)
    return out


# Sorted keys and counts as bytes


def packed(values: np.ndarray, ordered: bool) -> bytes:
    """64-bit numbers as compressed byte planes, of their differences if they are ordered."""
    values = values.astype(np.uint64)
    if ordered and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, ordered: bool) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if ordered else values


class Tally:
    """Counts by key in bounded memory: what comes is merged whenever it outgrows what is there."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.more, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((keys, counts))
        self.size += len(keys)
        if self.size > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.more:
            keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
            counts = np.concatenate([self.counts, *(c for _, c in self.more)])
            order = np.argsort(keys, kind="stable")  # runs that are sorted already: a merge
            keys, counts = keys[order], counts[order]
            first = firsts(keys)
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
            self.more, self.size = [], 0
        return self.keys, self.counts


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


# Grams of texts


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, slot of each gram's text from there, keys) for at most _SLOTS texts and about _PART grams at once; a text of n bytes has n + 1 grams."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(docs) * (depth + 1)  # of each text's leading edge in what follows
    room = np.full(len(data) + docs * (depth + 1) + 8, EDGE, np.uint8)
    room[np.arange(len(data)) + np.repeat(np.arange(docs) * (depth + 1) + depth, size)] = data
    wide = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
    mask = np.uint64((1 << (8 * depth)) - 1)
    for at in range(0, docs, _SLOTS):
        to = min(docs, at + _SLOTS)
        ends = np.cumsum(size[at:to] + 1)
        for p in range(0, int(ends[-1]), _PART):
            i = np.arange(p, min(p + _PART, int(ends[-1])))
            slot = np.searchsorted(ends, i, "right")
            place = i - (ends[slot] - size[at:to][slot] - 1) + begin[at:to][slot]
            yield at, slot, (wide[place] & mask) << np.uint64(8) | room[place + depth]


def group_of(kind: int, keys: np.ndarray, groups: int, depth: int) -> np.ndarray:
    """Grams go by the last bytes of their context, words by their hash."""
    if kind == WORD:
        return ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    context = keys >> np.uint64(8 * (depth + 1 - _CUT))
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


ASKED = "bucket int, kind int, grp int, n long, keys binary, counts binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _asking(depth: int, groups: int):
    """A bucket's texts: its different grams and words with their training counts, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, tuple[Tally, Tally]] = {}
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for bucket in np.unique(buckets):
                own = np.flatnonzero(buckets == bucket)
                of_grams, of_words = tallies.setdefault(int(bucket), (Tally(), Tally()))
                kept = held[own]
                for at, to, data, offsets in pieces(batch.column("body").take(pa.array(own)), lower=True):
                    learnt = ~kept[at:to]
                    for first, slot, keys in grams(data, offsets, depth):
                        known = learnt[first + slot]
                        of_grams.add(*counted(keys[known]))
                        if not known.all():
                            none = np.unique(keys[~known])
                            of_grams.add(none, np.zeros(len(none), np.int64))
                    w = split(data, offsets)
                    known = learnt[w.doc]
                    of_words.add(*counted(w.hash[known]))
                    none = np.unique(w.hash[~known])
                    of_words.add(none, np.zeros(len(none), np.int64))
        for bucket, both in tallies.items():
            for kind, tally in zip((GRAM, WORD), both, strict=True):
                keys, counts = tally.merge()
                group = group_of(kind, keys, groups, depth)
                order = np.argsort(group, kind="stable")
                group = group[order]
                cuts = np.append(firsts(group), len(group))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = order[a:b]
                    yield _batch([(bucket, kind, int(group[a]), b - a, packed(keys[part], True), packed(counts[part], False))], ASKED)

    return run


MODEL = "kind int, grp int, n long, known long, total long, keys binary, counts binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests sorted by kind and group: one row of keys and counts for each group."""
    now, tally = None, Tally()

    def row() -> pa.RecordBatch:
        keys, counts = tally.merge()
        return _batch([(*now, len(keys), int((counts > 0).sum()), int(counts.sum()), packed(keys, True), packed(counts, False))], MODEL)

    for batch in batches:
        for kind, group, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "grp", "n", "keys", "counts")), strict=True):
            if now not in (None, (kind, group)):
                yield row()
                tally = Tally()
            now = (kind, group)
            tally.add(unpacked(keys, n, True), unpacked(counts, n, False).astype(np.int64))
    if now:
        yield row()


# Trees


class Level:
    """All contexts of one depth: rows (context, byte) and, for each of the byte's first bits, their nodes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.first, self.node, self.n = [], [], []  # by number of bits: first row of a node, node of a row, its count
        for bits in range(9):
            first = firsts(keys >> np.uint64(8 - bits))
            mark = np.zeros(len(keys), np.int64)
            mark[first] = 1
            self.first.append(first)
            self.node.append(np.cumsum(mark) - 1)
            self.n.append(np.add.reduceat(counts, first) if len(first) else counts)

    def blocks(self, bits: int) -> np.ndarray:
        """Logarithms of the nodes' block probabilities."""
        halves = np.bincount(self.node[bits][self.first[bits + 1]], log_halves(self.n[bits + 1]), len(self.n[bits]))
        return halves - log_factorial(self.n[bits])

    def estimate(self, bits: int) -> np.ndarray:
        """What a row's node gives the row's next bit."""
        return (self.n[bits + 1][self.node[bits + 1]] + 0.5) / (self.n[bits][self.node[bits]] + 1.0)


def shallower(level: Level) -> tuple[Level, np.ndarray]:
    """The contexts without their farthest byte, and each row's row there."""
    keys, up = np.unique((level.keys >> np.uint64(16)) << np.uint64(8) | level.keys & np.uint64(255), return_inverse=True)
    return Level(keys, np.bincount(up, level.n[8], len(keys)).astype(np.int64)), up


def weighted(deepest: Level, down_to: int, depth: int) -> tuple[list[Level], list[np.ndarray], list[list[np.ndarray]], list[np.ndarray]]:
    """(levels from down_to on, rows' rows one level up, share of a node's own estimate, weighted logarithms at down_to)."""
    levels, ups = [deepest], []
    for _ in range(depth - down_to):
        level, up = shallower(levels[0])
        levels.insert(0, level)
        ups.insert(0, up)
    shares: list[list[np.ndarray]] = []
    below: list[np.ndarray] = []
    for k in range(len(levels) - 1, -1, -1):
        own, now = [], []
        for bits in range(8):
            block = levels[k].blocks(bits)
            if not below:
                now.append(block)
                own.append(np.ones(len(block)))
            else:
                nodes = levels[k].node[bits][ups[k][levels[k + 1].first[bits]]]
                kids = np.bincount(nodes, below[bits], len(block))
                total = np.logaddexp(block, kids) + _LN_HALF
                now.append(total)
                own.append(np.exp(block + _LN_HALF - total))
        shares.insert(0, own)
        below = now
    return levels, ups, shares, below


def chunks(keys: np.ndarray, depth: int, rows: int = 1 << 18) -> Iterator[slice]:
    """Runs of about so many keys that hold whole contexts of _CUT bytes."""
    cuts = firsts(keys >> np.uint64(8 * (depth + 1 - _CUT)))
    at = 0
    while at < len(keys):
        to = int(np.searchsorted(cuts, at + rows, "left"))
        to = int(cuts[to]) if to < len(cuts) else len(keys)
        yield slice(at, to)
        at = to


TOP = "context int, place int, zeros long, ones long, kids double"


def _tops(depth: int):
    """Groups' sums for the nodes of _TOP bytes: counts and the product of the children they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "counts")), strict=True):
                keys, counts = unpacked(keys, n, True), unpacked(counts, n, False).astype(np.int64)
                for part in chunks(keys, depth):
                    levels, _, _, logs = weighted(Level(keys[part], counts[part]), _CUT, depth)
                    level, up = shallower(levels[0])
                    for bits in range(8):
                        nodes = level.node[bits][up[levels[0].first[bits]]]
                        kids = np.bincount(nodes, logs[bits], len(level.n[bits]))
                        side = level.first[bits + 1]
                        one = (level.keys[side] >> np.uint64(7 - bits)) & np.uint64(1) == 1
                        of = level.node[bits][side]
                        ones = np.bincount(of[one], level.n[bits + 1][one], len(kids)).astype(np.int64)
                        first = level.keys[level.first[bits]]
                        place = (1 << bits) + ((first & np.uint64(255)) >> np.uint64(8 - bits)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array((first >> np.uint64(8)).astype(np.int32)), pa.array(place, pa.int32()), pa.array(level.n[bits] - ones), pa.array(ones), pa.array(kids)], names=[f.split()[0] for f in TOP.split(", ")])

    return run


def crown(tops: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
    """By depth 0 to _TOP: sorted node keys (context and place), counts of zeros and ones, share of the own estimate."""
    out = []
    key = tops["context"].astype(np.int64) << 8 | tops["place"]
    zeros, ones, kids = tops["zeros"], tops["ones"], tops["kids"]
    for _ in range(_TOP + 1):
        key, up = np.unique(key, return_inverse=True)
        zeros, ones, kids = (np.bincount(up, v, len(key)) for v in (zeros, ones, kids))
        block = log_halves(zeros.astype(np.int64)) + log_halves(ones.astype(np.int64)) - log_factorial((zeros + ones).astype(np.int64))
        total = np.logaddexp(block, kids) + _LN_HALF
        out.insert(0, {"key": key, "zeros": zeros, "ones": ones, "share": np.exp(block + _LN_HALF - total)})
        key, kids = (key >> 16) << 8 | key & 255, total
    return out


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: list[dict[str, np.ndarray]], depth: int) -> np.ndarray:
    """The base-10 logarithm of the probability of each gram's last byte."""
    out = np.zeros(len(keys), np.float32)
    for part in chunks(keys, depth):
        levels, ups, shares, _ = weighted(Level(keys[part], counts[part]), _CUT, depth)
        level, up = shallower(levels[0])
        byte = (level.keys & np.uint64(255)).astype(np.int64)
        context = (level.keys >> np.uint64(8)).astype(np.int64)
        logs = np.zeros(len(keys[part]))
        for bits in range(8):
            given, left, last = np.zeros(len(byte)), np.ones(len(byte)), np.full(len(byte), 0.5)
            open_ = np.ones(len(byte), bool)
            one = (byte >> (7 - bits)) & 1
            for d, nodes in enumerate(top):
                want = (context >> (8 * (_TOP - d))) << 8 | (1 << bits) + (byte >> (8 - bits))
                i = np.minimum(np.searchsorted(nodes["key"], want), len(nodes["key"]) - 1)
                n = nodes["zeros"][i] + nodes["ones"][i]
                seen = open_ & (n > 0)
                given, left, last, open_ = _mixed(given, left, last, open_, seen, (np.where(one == 1, nodes["ones"][i], nodes["zeros"][i]) + 0.5) / (n + 1.0), nodes["share"][i])
            state = tuple(v[up] for v in (given, left, last, open_))
            for k, (deeper, share) in enumerate(zip(levels, shares, strict=True)):
                if k:
                    state = tuple(v[ups[k - 1]] for v in state)
                node = deeper.node[bits]
                state = _mixed(*state, state[3] & (deeper.n[bits][node] > 0), deeper.estimate(bits), share[bits][node])
            given, left, last, _ = state
            logs += np.log10(given + left * last)
        out[part] = logs
    return out


def _mixed(given, left, last, open_, seen, estimate, share):
    """One node further on the path: what the mixture has given, what is left for deeper nodes, the last estimate seen, whether the path goes on. The last node of a path gets all that is left."""
    return np.where(seen, given + left * share * estimate, given), np.where(seen, left * (1 - share), left), np.where(seen, estimate, last), seen


ANSWERS = "bucket int, kind int, grp int, n long, keys binary, counts binary"


def _answering(depth: int, top):
    """Sorted by kind and group, each group's model first: requests with log-probabilities or counts for their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = known = values = None
        for batch in batches:
            for bucket, kind, group, n, raw, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "grp", "n", "keys", "counts")), strict=True):
                keys = unpacked(raw, n, True)
                if bucket < 0:
                    now, known, values = (kind, group), keys, unpacked(counts, n, False).astype(np.int64)
                    if kind == GRAM:
                        values = log_probabilities(known, values, top.value, depth)
                    continue
                if now != (kind, group):
                    raise ValueError("a group of requests came without its model")
                found = values[np.searchsorted(known, keys)]
                yield _batch([(bucket, kind, group, n, raw, found.tobytes() if kind == GRAM else packed(found, False))], ANSWERS)

    return run


class Answers:
    """What one bucket has been told."""

    def __init__(self):
        self.parts: dict[int, list] = {GRAM: [], WORD: []}
        self.tables = None

    def ready(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        if self.tables is None:
            self.tables = {}
            for kind, kept in ((GRAM, np.float32), (WORD, np.int64)):
                keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.parts[kind])])
                values = np.concatenate([np.zeros(0, kept), *(v for _, v in self.parts[kind])])
                order = np.argsort(keys, kind="stable")
                self.tables[kind] = keys[order], values[order]
            self.parts.clear()
        return self.tables

    def look(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys, all of which are there."""
        known, values = self.ready()[kind]
        i = np.searchsorted(known, keys)
        if len(keys) and (i[-1] >= len(known) or not np.array_equal(known[i], keys)):
            raise ValueError("a text holds a key that its bucket did not ask for")
        return values[i]


def _scoring(depth: int, ends: int, names: list[str]):
    """Sorted by bucket and kind: answers, then texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, Answers()
        for batch in batches:
            buckets, kinds = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.append(firsts(buckets.astype(np.int64) * 4 + kinds), len(buckets))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now != buckets[a]:
                    now, told = buckets[a], Answers()
                part = batch.slice(a, b - a)
                if kinds[a] != TEXT:
                    for kind, n, keys, values in zip(*(part.column(c).to_pylist() for c in ("kind", "n", "keys", "counts")), strict=True):
                        told.parts[kind].append((unpacked(keys, n, True), np.frombuffer(values, np.float32) if kind == GRAM else unpacked(values, n, False).astype(np.int64)))
                    continue
                for at, to, data, offsets in pieces(part.column("body"), lower=True):
                    docs = to - at
                    score = np.zeros(docs)
                    for first, slot, keys in grams(data, offsets, depth):
                        both = np.sort(keys << np.uint64(8) | slot.astype(np.uint64))
                        keys = both >> np.uint64(8)
                        runs = firsts(keys)
                        logs = np.repeat(told.look(GRAM, keys[runs]), np.diff(np.append(runs, len(keys))))
                        score[first : first + _SLOTS] += np.bincount((both & np.uint64(255)).astype(np.int64), logs, min(_SLOTS, docs - first))
                    w = split(data, offsets)
                    order = np.argsort(w.hash)
                    counts, doc = told.look(WORD, w.hash[order]), w.doc[order]
                    n_tokens = np.diff(w.first) + 1
                    n_known = np.bincount(doc[counts > 0], minlength=docs) + (ends > 0)
                    base = np.bincount(doc, np.log10(counts + 1.0), docs) + np.log10(ends + 1.0)
                    own = [part.column(c).slice(at, docs) for c in ("id", "held_out")]
                    new = [pa.array(v, t) for v, t in ((n_tokens, pa.int64()), (n_known, pa.int64()), (np.diff(offsets), pa.int64()), (base, pa.float64()), (score, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*own, *new], names=names)

    return run


def scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, n_bytes, score.

    Counts come from the rows for which held_out, a condition on docs' columns, is false or null.
    score is the base-10 logarithm of the text's probability, its end included; -score / (n_bytes
    + 1) is the code length per byte. Null texts are empty: they have their end alone. Repeated rows
    are learnt and scored one by one; other columns are not read. With nothing to learn from every
    bit costs one bit. depth is 3 to 6. Equal words are those of equal 64-bit hashes.
    """
    if not _CUT <= depth <= 6:
        raise ValueError(f"depth is from {_CUT} to 6")
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("body"))
    size, learnt = rows.agg(F.sum(F.octet_length("body").cast("long") + 1), F.count_if(~F.col("held_out"))).first()
    buckets, groups = -(-(size or 1) // bucket), min(MOST_GROUPS, max(16, -(-(size or 1) // group)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "body"), F.lit(buckets)).cast("int"))
    asked = saved(rows.repartitionById(buckets, "bucket").mapInArrow(_asking(depth, groups), ASKED), "grams")
    model = saved(asked.repartition("kind", "grp").sortWithinPartitions("kind", "grp").mapInArrow(_merged, MODEL), "counts")
    found = model.where(F.col("kind") == WORD).agg(F.sum("total"), F.sum("known")).first()
    tokens, kinds = (found[0] or 0) + learnt, (found[1] or 0) + (learnt > 0)
    tops = model.where(F.col("kind") == GRAM).mapInArrow(_tops(depth), TOP).groupBy("context", "place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("kids").alias("kids")).toArrow()
    top = spark.sparkContext.broadcast(crown({c: tops.column(c).to_numpy() for c in tops.column_names}))
    models = model.select(F.lit(-1).alias("bucket"), "kind", "grp", "n", "keys", "counts")
    answers = models.unionByName(asked).repartition("kind", "grp").sortWithinPartitions("kind", "grp", "bucket").mapInArrow(_answering(depth, top), ANSWERS)
    kind = docs.schema[id_col].dataType
    both = answers.unionByName(rows.withColumn("kind", F.lit(TEXT)), allowMissingColumns=True).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    schema = StructType([StructField("id", kind), *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double").fields])
    out = both.mapInArrow(_scoring(depth, learnt, schema.names), schema)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"), "n_bytes", F.round("score", 6).alias("score"),
    )


def op12_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32 leaves another remainder than 2 by 7; rows without an id are learnt from, null texts are empty."""
    return scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
