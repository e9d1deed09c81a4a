"""Token ids in seekable zstandard files.

Documents in ascending id order are encoded and written as little-endian unsigned 32-bit ids.
A file is a row of independent zstandard frames, each with zstandard's own content checksum,
followed by two skippable frames: the document index (id, ids, of every document) and, last,
the seek table of the public zstandard seekable format with each frame's sizes and the low 32
bits of the xxh64 of its content. A reader finds a document's frame from the end of the file
and decompresses nothing else.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratch, table
from .words import small_batches

# Magic numbers of the zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
END_ID = 2
#: Bytes of ids in a frame and in a file at which the next one begins; a document is never split.
FRAME_BYTES, FILE_BYTES = 1 << 18, 1 << 26
#: Known pieces of text that a Python worker keeps, about 200 MB; it starts over beyond that.
MOST_KNOWN = 1_000_000
#: Tasks of the same read of files at most; below that, one a file.
MOST_READERS = 10_000
LEVEL = 3


class Encoder:
    """Ids of whole texts from the tokenizers library, each distinct piece of text encoded once.

    A byte-level BPE with the usual pattern never forms a token across a single space that
    follows or precedes a character other than white space, so texts are cut before such spaces.
    Pieces not met before go to the library in one joined text, and its ids are parted again
    where a token opens with a space. Texts with white space on both sides of a space, or that
    may hold a special token or a NUL, are encoded whole.
    """

    def __init__(self, tokenizer_json: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.risky = regex.compile(r"\s \s|<\||\0").search
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # pieces after which a text is looked at more closely

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        odd = {x for x in new if len(x) < 2 or x[-1].isspace() or x[1].isspace() or "<|" in x}
        alone = [x for x in new if x[:1] != " " or x in odd]
        joined = list(new.difference(alone))
        self.odd |= odd
        self.known.update(zip(alone, self._ids(alone), strict=True))
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4).tolist()
            raw = ids.tobytes()
            self.known.update(zip(joined, [raw[a:b] for a, b in pairwise(cuts)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
            self.odd.clear()
        known, new = self.known, set()
        cut = [text.replace(" ", "\0 ").split("\0") for text in texts]
        found = [list(map(known.get, pieces)) for pieces in cut]
        unknown = [k for k, ids in enumerate(found) if None in ids]
        for k in unknown:
            new.update(piece for piece, ids in zip(cut[k], found[k], strict=True) if ids is None)
        self._learn(new)
        for k in unknown:
            found[k] = [known[piece] if ids is None else ids for piece, ids in zip(cut[k], found[k], strict=True)]
        odd = self.odd
        return [b"".join(ids) if "\0" not in text and (odd.isdisjoint(pieces) or not self.risky(text)) else self._ids([text])[0] for pieces, ids, text in zip(cut, found, texts, strict=True)]


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker: pieces that one task has learnt serve the next."""
    return Encoder(tokenizer_json)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark itself would write it to: one without a scheme is on the cluster's default file system, not on each executor's disk."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.toString() if "://" in path else at.getFileSystem(conf).makeQualified(at).toString()


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified path and the path in it. Hadoop's names of S3 are known; a scheme that Arrow has no file system for is refused."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)


class Writer:
    """One file; add() documents, then close() for its row of the manifest."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.ids.zst"
        fs, at = _filesystem(self.path)
        self.out = fs.open_output_stream(at, compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.open: list[bytes] = []
        self.size = self.written = 0
        self.seek: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.open.append(ids)
        self.size += len(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.seek.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.written += len(raw)
            self.open, self.size = [], 0

    def close(self) -> dict:
        self.flush()
        index = pa.record_batch({"id": pa.array(self.ids, pa.int64()), "n": pa.array(self.counts, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        packed = self.pack.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        table_bytes = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table_bytes)) + table_bytes)
        self.out.close()
        return {"path": self.path, "docs": len(self.ids), "ids": sum(self.counts)}


class Reader:
    """Random access to one file: index from its end, then frames on demand, each checked."""

    def __init__(self, path: str) -> None:
        fs, at = _filesystem(path)
        self.path, self.file = path, fs.open_input_file(at)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        begins = size - 9 - 12 * frames - 8
        rows = np.frombuffer(self.file.read_at(12 * frames, begins + 8), "<u4").reshape(frames, 3)
        self.checks = rows[:, 2]
        self.at = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])
        self.raw = np.concatenate([[0], np.cumsum(rows[:, 1], dtype=np.int64)])
        magic, length = struct.unpack("<II", self.file.read_at(8, int(self.at[-1])))
        self.unpack = zstandard.ZstdDecompressor()
        packed = self.file.read_at(length, int(self.at[-1]) + 8)
        index = pa.ipc.open_stream(self.unpack.decompress(packed)).read_all()
        self.ids = index["id"].to_pylist()
        self.starts = np.concatenate([[0], np.cumsum(index["n"].to_numpy())]).astype(np.int64)

    def frame(self, k: int) -> bytes:
        raw = self.unpack.decompress(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterator[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(position in the file, ids as bytes) of the wanted positions, ascending; each frame is read once, others not at all."""
        held, raw = -1, b""
        for i in range(len(self.ids)) if wanted is None else wanted:
            k = int(np.searchsorted(self.raw, 4 * self.starts[i], "right")) - 1
            if k != held:
                held, raw = k, self.frame(k)
            at = int(4 * self.starts[i] - self.raw[k])
            yield i, raw[at : at + int(4 * (self.starts[i + 1] - self.starts[i]))]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes docs under folder; returns the manifest: path, docs, ids, start (ids in all files before).

    tokenizer: path of a byte-level BPE in the tokenizers library's format. Null text is encoded
    as empty, so each document has one id at least. Null ids come first. Equal ids are ordered by
    a hash of the text. No documents: no files. A file that a lost or repeated task attempt left
    is in no manifest, so it is never read.
    """
    with open(tokenizer) as f:
        spec = f.read()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, part, k, rows = _encoder(spec), None, TaskContext.get().partitionId(), 0, []
        for batch in batches:
            ids, column = batch.column("id").to_pylist(), batch.column("body").fill_null("")
            sizes = np.asarray(pa.compute.binary_length(column))
            at = 0
            while at < len(ids):
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 20)))
                for doc_id, got in zip(ids[at:to], encode(column.slice(at, to - at).to_pylist()), strict=True):
                    writer = writer or Writer(folder)
                    writer.add(doc_id, got + end)
                at = to
                if writer.written >= FILE_BYTES:
                    rows.append(writer.close() | {"part": part, "k": k})
                    writer, k = None, k + 1
        if writer:
            rows.append(writer.close() | {"part": part, "k": k})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("part", pa.int32()), ("k", pa.int32())]))

    folder = qualified(docs.sparkSession, folder)
    if folder.startswith("file:"):
        fs, at = _filesystem(folder)
        fs.create_dir(at, recursive=True)
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    ordered = rows.withColumn("tie", F.xxhash64("body")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    files = saved(ordered.mapInArrow(run, "path string, docs long, ids long, part int, k int"), "token-files")
    # One row for each file of FILE_BYTES, so this order by file stays small.
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32; each frame's checksum is verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = Reader(path)
                crcs = np.array([zlib.crc32(ids) for _, ids in file.documents()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(file.ids, pa.int64()), pa.array(start + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # An explicit number: rows are a file each and would be coalesced by their own small size.
    readers = min(max(1, manifest.count()), MOST_READERS)
    return manifest.select("path", "start").repartition(readers).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of documents, read back from the files; see write_ids for nulls and ties."""
    import public_tokenizers

    return read_ids(write_ids(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))
