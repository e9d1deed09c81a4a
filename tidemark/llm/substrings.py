"""Suffix-array removal of repeated substrings by a prefix-aware distributed merge sort.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere. Suffixes are not
sorted at every byte, but at anchors: positions whose GRAM-byte hash is the least of some window
of WINDOW positions. A string of LENGTH bytes is just one such window, so two equal strings hold
the same anchor at the same offset, and no repeat is missed.

1. Anchors of all texts are found in one pass; those whose gram occurs once are dropped.
2. The suffixes at the others, with the bytes before them, are sorted in each task into runs and
   dealt out by ranges of their first GRAM bytes. Runs travel front-coded: a suffix is the
   length of the prefix it shares with the one before it, and the rest.
3. Each range merges its runs with a loser tree that carries shared prefix lengths: of two
   suffixes the one that shares more with the last winner comes first, and bytes are compared
   only from the shared length on. The merge gives a suffix array with its LCP array.
4. For each offset d of an anchor in a string, the string is an LCP interval of LENGTH - d bytes
   with d equal bytes before; one that is met twice is a repeat, and its bytes are a span.
5. Spans of a document are united and cut out of its bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .words import mixed, pieces, powers, small_batches

LENGTH, GRAM = 200, 40
WINDOW = LENGTH - GRAM + 1
#: Distinct contexts of a run, and those aimed at for a range.
RUN, RANGE = 50_000, 20_000
#: Range bounds come from the first bytes of one anchor in DRAWN, of SAMPLE anchors at most.
DRAWN, SAMPLE = 256, 40_000
_MOST = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, w: int, reduce: np.ufunc, fill: np.uint64) -> np.ndarray:
    """reduce over x[i:i + w] for every i with a full window: block prefixes and suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, fill, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = reduce.accumulate(blocks, axis=1).reshape(-1)
    behind = np.ascontiguousarray(reduce.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return reduce(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in data, gram hashes, index of each document's first) of all anchors."""
    n = len(data)
    size = np.diff(offsets)
    if n < LENGTH or size.max(initial=0) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = _sliding(h, WINDOW, np.minimum, _MOST)
    # Windows that reach over a document's end select nothing.
    valid = np.zeros(len(least) + 1, np.int8)
    long = np.flatnonzero(size >= LENGTH)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, np.minimum(offsets[long] + size[long] - LENGTH + 1, len(least)), -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    # A position is selected if it equals the least of a window that holds it.
    edge = np.zeros(WINDOW - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum, np.uint64(0))
    at = np.flatnonzero(most[: len(h)] == h)
    return at, h[at], np.searchsorted(at, offsets)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column("body")):
            at, h, first = anchors(data, offsets)
            first = first.astype(np.int32)
            own = at - np.repeat(offsets[:-1], np.diff(first))
            few = np.flatnonzero(h % np.uint64(DRAWN) == 0)
            raw = bytes(data)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ("id", "print")), pa.ListArray.from_arrays(first, pa.array(own.astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(np.searchsorted(few, first).astype(np.int32), pa.array([raw[x : x + GRAM] for x in at[few].tolist()], pa.binary()))],
                names=["id", "print", "at", "gram", "drawn"],
            )


def _shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, known to be start at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while a[start : start + 16] == b[start : start + 16]:
        start += 16
    while a[start] == b[start]:
        start += 1
    return start


def front_code(texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, lengths of the rests, rests) of sorted byte strings."""
    shared, rests, last = [], [], b""
    for text in texts:
        k = _shared(last, text)
        shared.append(k)
        rests.append(text[k:])
        last = text
    return np.array(shared, "<u2").tobytes(), np.array([len(r) for r in rests], "<u2").tobytes(), b"".join(rests)


def merge(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, index in it, string, length shared with the string before) in sorted order of all front-coded runs.

    A tree of losers: each node keeps the loser of its match and the length that it shares with
    the winner. Against a later winner that length still holds, so known prefixes are not read again.
    """
    decoded = [(np.frombuffer(s, "<u2").tolist(), np.frombuffer(n, "<u2").tolist(), r) for s, n, r in runs]
    width = 1
    while width < len(runs):
        width *= 2
    text: list[bytes | None] = [None] * width
    know, index, place = [0] * width, [-1] * width, [0] * width

    def advance(k: int) -> None:
        shared, lengths, rests = decoded[k]
        index[k] += 1
        i = index[k]
        if i == len(shared):
            text[k] = None
            return
        know[k] = shared[i]
        text[k] = (text[k] or b"")[: shared[i]] + rests[place[k] : place[k] + lengths[i]]
        place[k] += lengths[i]

    for k in range(len(runs)):
        advance(k)
        know[k] = 0

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's know becomes what it shares with the winner."""
        x, y = text[a], text[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = know[a], know[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        p = _shared(x, y, p)
        if x[p:] <= y[p:]:
            know[b] = p
            return a, b
        know[a] = p
        return b, a

    tree = [0] * (2 * width)
    winners = [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winners[node], tree[node] = match(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if width > 1 else 0
    while text[top] is not None:
        yield top, index[top], text[top], know[top]
        advance(top)
        node = (top + width) // 2
        while node:
            top, tree[node] = match(top, tree[node])
            node //= 2


def _context(text: bytes, at: int) -> tuple[bytes, bytes]:
    """LENGTH bytes from an anchor on, and those before it, nearest first."""
    return text[at : at + LENGTH], text[max(0, at - WINDOW + 1) : at][::-1]


def _key(context: tuple[bytes, bytes]) -> bytes:
    """128 bits by which a context is known."""
    return xxhash.xxh3_128_digest(len(context[0]).to_bytes(2, "little") + context[0] + context[1])


_RUN = pa.schema([("part", pa.int32()), ("shared", pa.binary()), ("lengths", pa.binary()), ("rests", pa.binary()), ("before", pa.binary()), ("keys", pa.binary()), ("times", pa.binary())])


def _runs(bounds: list[bytes]):
    """Texts with anchor positions -> sorted front-coded runs of their distinct contexts, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], int] = {}
        pack = zstandard.ZstdCompressor(level=3).compress

        def flush() -> pa.RecordBatch:
            rows, order = [], sorted(known)
            cuts = [0, *(bisect_right(order, (b, b"")) for b in bounds), len(order)]
            for part in range(len(cuts) - 1):
                own = order[cuts[part] : cuts[part + 1]]
                if own:
                    shared, lengths, rests = front_code([x for x, _ in own])
                    left = b"".join(len(y).to_bytes(2, "little") + y for _, y in own)
                    rows.append({"part": part, "shared": pack(shared), "lengths": pack(lengths), "rests": pack(rests), "before": pack(left), "keys": b"".join(map(_key, own)), "times": np.array([known[x] for x in own], "<u4").tobytes()})
            known.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_RUN)

        for batch in batches:
            for ats, text in zip(batch.column("at").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist(), strict=True):
                for at in ats:
                    context = _context(text, at)
                    known[context] = known.get(context, 0) + 1
                if len(known) >= RUN:
                    yield flush()
        yield flush()

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with anchor positions -> the key of each anchor's context."""
    for batch in batches:
        keys = [[_key(_context(text, at)) for at in ats] for ats, text in zip(batch.column("at").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "print", "at")), pa.array(keys, pa.list_(pa.binary()))], names=["id", "print", "at", "key"])


def repeats(shared: np.ndarray, size: np.ndarray, before: np.ndarray, depth: np.ndarray, times: np.ndarray) -> np.ndarray:
    """[n, WINDOW] flags: is the string of LENGTH bytes that starts d bytes before the suffix met twice?

    shared: the LCP array of the sorted suffixes; size: their lengths; before: the bytes before
    them, nearest first; depth: how many there are; times: how often each context occurs.
    """
    n = len(shared)
    out = np.zeros((n, WINDOW), bool)
    left = np.zeros(n, np.uint64)
    for d in range(WINDOW):
        if d:
            left = mixed(left + before[:, d - 1].astype(np.uint64) + np.uint64(1))
        need = LENGTH - d
        able = np.flatnonzero((size >= need) & (depth >= d))
        if not len(able):
            continue
        interval = np.cumsum(shared < need)[able].astype(np.uint64)
        _, back = np.unique(mixed(interval * np.uint64(0x9E3779B97F4A7C15) ^ left[able]), return_inverse=True)
        out[able, d] = np.bincount(back, times[able])[back] >= 2
    return out


def _merge_range(rows: pa.Table) -> pa.Table:
    """The runs of a range -> key and spans (first byte, byte after the last, relative to the anchor) of each context with a repeat."""
    unpack = zstandard.ZstdDecompressor().decompress
    columns = {c: [unpack(x) if x else b"" for x in rows[c].to_pylist()] for c in ("shared", "lengths", "rests", "before")} | {c: rows[c].to_pylist() for c in ("keys", "times")}
    lefts, times = [], [np.frombuffer(t, "<u4") for t in columns["times"]]
    for raw in columns["before"]:
        own, at = [], 0
        while at < len(raw):
            size = int.from_bytes(raw[at : at + 2], "little")
            own.append(raw[at + 2 : at + 2 + size])
            at += 2 + size
        lefts.append(own)
    merged = [(k, i, len(text), know) for k, i, text, know in merge(list(zip(columns["shared"], columns["lengths"], columns["rests"], strict=True)))]
    shared, size = np.array([m[3] for m in merged], np.int64), np.array([m[2] for m in merged], np.int64)
    before = np.zeros((len(merged), WINDOW), np.uint8)
    depth = np.zeros(len(merged), np.int64)
    for row, (k, i, _, _) in enumerate(merged):
        text = lefts[k][i]
        depth[row] = len(text)
        before[row, : len(text)] = np.frombuffer(text, np.uint8)
    flags = repeats(shared, size, before, depth, np.array([times[k][i] for k, i, _, _ in merged], np.int64))
    padded = np.zeros((len(merged), WINDOW + 2), np.int8)
    padded[:, 1:-1] = flags
    turn = np.diff(padded, axis=1)
    row, lo = np.nonzero(turn == 1)
    _, hi = np.nonzero(turn == -1)
    keys: dict[int, list] = {}
    for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
        keys.setdefault(r, []).append((-(b - 1), LENGTH - a))
    # A context that several runs hold is reported once.
    by_key = {columns["keys"][merged[r][0]][16 * merged[r][1] : 16 * merged[r][1] + 16]: spans for r, spans in keys.items()}
    return pa.table({"key": pa.array(list(by_key), pa.binary()), "starts": pa.array([[s for s, _ in x] for x in by_key.values()], pa.list_(pa.int32())), "ends": pa.array([[e for _, e in x] for x in by_key.values()], pa.list_(pa.int32()))})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their spans -> counts, the bytes that are left and their SHA-256."""
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, starts, ends in zip(batch.column("body").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            text = text or b""
            kept, at, reach, spans = [], 0, 0, 0
            for s, e in sorted(zip(starts or [], ends or [], strict=True)):
                if s > reach or not spans:
                    kept.append(text[reach:s])
                    spans += 1
                reach = max(reach, e)
            kept.append(text[reach:])
            rest = b"".join(kept)
            for name, value in zip(out, (len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=["id", *out])


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, which may split a character).

    Null texts are empty. Repeated rows repeat each other, so all their bytes go if they are
    LENGTH long. Ids may be null or shared: a row is known by its id and a hash of its text.
    Empty table: no rows. Shorter texts than LENGTH stay whole.
    """
    small_batches(docs, 500)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("body")).withColumn("print", F.xxhash64("id", "body"))
    long = rows.where(F.octet_length("body") >= LENGTH)
    found = saved(long.mapInArrow(_find, "id long, print long, at array<int>, gram array<bigint>, drawn array<binary>"), "anchors")
    each = found.select("id", "print", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("id", "print", "x.at", "x.gram")
    # Written first: a join of two plain tables is one whose hot grams are split at run time.
    twice = saved(found.select(F.explode("gram").alias("gram")).groupBy("gram").count().where("count > 1").select("gram"), "repeating-grams")
    wanted = saved(each.join(twice, "gram").groupBy("print", "id").agg(F.array_sort(F.collect_set("at")).alias("at")).withColumnRenamed("id", "same"), "repeating-anchors")
    total = wanted.select(F.sum(F.size("at"))).first()[0] or 0

    # Any bounds are right; these make ranges of like size.
    count = found.select(F.sum(F.size("drawn"))).first()[0] or 0
    share = min(1.0, SAMPLE / max(count, 1))
    drawn = found.select("print", F.posexplode("drawn").alias("k", "b")).where(F.pmod(F.xxhash64("print", "k"), F.lit(1_000_000)) < share * 1_000_000).select("b").limit(2 * SAMPLE)
    drawn = sorted({bytes(r.b) for r in drawn.collect()})
    parts = max(1, -(-total // RANGE))
    bounds = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []

    # All three joins with texts have the same keys and columns, so the bodies are shuffled once and read three times.
    def with_bodies(other: DataFrame, how: str) -> DataFrame:
        return rows.join(other, (rows["print"] == other["print"]) & rows["id"].eqNullSafe(other["same"]), how).select("id", rows["print"], "body", *[c for c in other.columns if c not in ("print", "same")])

    texts = with_bodies(wanted, "inner")
    runs = texts.mapInArrow(_runs(bounds), "part int, shared binary, lengths binary, rests binary, before binary, keys binary, times binary")
    spans = runs.groupBy("part").applyInArrow(_merge_range, "key binary, starts array<int>, ends array<int>")
    placed = texts.mapInArrow(_place, "id long, print long, at array<int>, key array<binary>").select("id", "print", F.explode(F.arrays_zip("at", "key")).alias("x")).select("id", "print", "x.at", "x.key")
    cut = placed.join(spans, "key").select("id", "print", "at", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select(F.col("id").alias("same"), "print", (F.col("at") + F.col("x.starts")).alias("s"), (F.col("at") + F.col("x.ends")).alias("e"))
    of_row = cut.groupBy("print", "same").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select("print", "same", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"))
    joined = with_bodies(of_row, "left").select("id", "body", "starts", "ends")
    return joined.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of documents; see deduplicate for nulls and repeats."""
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
