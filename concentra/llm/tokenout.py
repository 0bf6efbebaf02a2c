"""Token ids in seekable zstandard files (op 10).

One file per range of document ids, documents ascending. A file is

    frame 0 | frame 1 | ... | document index | seek table

* a frame is an independent zstandard frame (with its content checksum) over
  the little-endian unsigned 32-bit ids of whole documents, each document
  followed by the end id. A frame is closed once it holds ``FRAME_IDS`` ids, so
  a very long document makes one long frame of its own;
* the document index is a skippable frame (magic 0x184D2A50) whose content is
  one zstandard frame over: count n, n ids (int64), n flags (1: the id is not
  null), n token counts (uint32), n frame numbers (uint32);
* the seek table is the skippable frame of the public seekable format (magic
  0x184D2A5E): per frame compressed size, decompressed size and the low 32 bits
  of the content's XXH64, all uint32; then the number of frames (the index
  included), a descriptor byte (0x80) and the magic 0x8F92EAB1.

A reader takes the seek table from the end of the file, then the index, and
decompresses only the frames of the documents it is asked for.

Documents are range-partitioned by id (the texts move once). A task writes its
file under a fresh name and reports it in a manifest table; only attempts that
succeed are in the manifest, so retried or lost tasks leave no wrong file in
the result. The place of a document in the whole sequence comes from a running
sum over the manifest (one row per file).

Defined cases: a null or empty text has the end id only; a null id sorts first
and comes back null; rows with the same id are ordered by text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .folders import stored
from .registry import read_table, register
from .words import NOT_ALNUM, Piece, hash_spans, pieces

FRAME_IDS = 1 << 16
END_ID = 0
LEVEL = 3
VOCABULARY = "byte_bpe_50k.json"

INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Texts are cut only where the vocabulary's pattern always ends a piece:
#: before a single blank or line feed between other characters, after such a
#: line feed, and between a letter or digit and the punctuation after it. The
#: cuts are found in the bytes; doubtful bytes (blanks beyond ASCII) get none.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEADS_WHITE = np.zeros(256, bool)
_LEADS_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BEFORE_WHITE_END = np.zeros(256, bool)
_BEFORE_WHITE_END[[0xC2, 0x9A, 0x80, 0x81]] = True
_ALNUM = ~NOT_ALNUM
_ALNUM[0x80:] = False
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SPECIAL = b"<|endoftext|>"


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the runs that may be encoded one by one, ascending."""
    n = len(data)
    white = _WHITE[data]
    before = np.zeros(n + 1, bool)  # a character other than white space ends just before
    before[1:] = ~white
    before[2:] &= ~((data[1:] >= 0x80) & _BEFORE_WHITE_END[data[:-1]])
    after = np.zeros(n, bool)
    after[:-1] = ~white[1:] & ~_LEADS_WHITE[data[1:]]
    before[offsets] = False
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    lone = before[:n] & after
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[:n] |= lone & ((data == 0x20) | (data == 0x0A))
    cut[1:] |= lone & (data == 0x0A)
    word = np.zeros(n, bool)  # a letter or digit ends just before
    word[1:] = _ALNUM[data[:-1]]
    latin = (data[:-1] >= 0x80) & (data[:-1] < 0xC0) & (data[:-1] != 0x97) & (data[:-1] != 0xB7)
    word[2:] |= latin[1:] & (data[:-2] == 0xC3)
    cut[:n] |= word & _PUNCTUATION[data]
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of the documents of a piece. Each distinct run between two cuts is
    encoded by the library once and kept, by its 64-bit hash, in sorted arrays
    (``KEEP`` runs at most, then the store starts anew)."""

    KEEP = 1_500_000

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # first id of each run in ``ids``
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, runs: list[str]) -> None:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(runs, add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *found])
        keys, at, size = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, size)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece, and the n + 1 offsets of its documents in them."""
        data, offsets = piece.data, piece.offsets
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        starts = cuts(data, offsets)
        if _SPECIAL in (raw := data.tobytes()):  # documents with the special token's text are left whole
            whole = np.zeros(n, bool)
            at = raw.find(_SPECIAL)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(_SPECIAL, at + 1)
            doc = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~whole[doc] | np.isin(starts, offsets)]
        ends = np.append(starts[1:], len(data))
        keys, first, run = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.KEEP:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = first[~known]
            self._learn(keys[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        size = self.size[at][run]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[at][run] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Writer:
    """Writes one file; ``sink`` needs ``write`` only."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        import zstandard

        self.sink, self.frame_ids = sink, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids, self.counts, self.frames = [], [], []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.open.append(ids)
        self.open_bytes += len(ids)
        self.n_ids += len(ids) // 4
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.frames.append(len(self.table))
        if self.open_bytes >= 4 * self.frame_ids:
            self._close_frame()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def _close_frame(self) -> None:
        import xxhash

        content = b"".join(self.open)
        self.open, self.open_bytes = [], 0
        frame = self.zstd.compress(content)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._put(frame)

    def close(self) -> None:
        if self.open:
            self._close_frame()
        index = struct.pack("<Q", len(self.ids)) + b"".join(
            np.array(x, t).tobytes()
            for x, t in (
                ([i or 0 for i in self.ids], "<i8"), ([i is not None for i in self.ids], "u1"),
                (self.counts, "<u4"), (self.frames, "<u4"),
            )
        )
        index = self.zstd.compress(index)
        self.table.append((len(index) + 8, 0, 0))
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads one file through ``source`` (``seek``, ``read``) of ``size`` bytes."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if (kind, magic) != (0x80, SEEKABLE_MAGIC):
            raise ValueError("no seek table at the end of the file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        head = int(self.offsets[n - 1])
        magic, length = struct.unpack("<II", self._at(head, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        index = self.zstd.decompress(self._at(head + 8, length))
        (m,) = struct.unpack_from("<Q", index)
        self.ids = np.frombuffer(index, "<i8", m, 8)
        self.has_id = np.frombuffer(index, "u1", m, 8 + 8 * m).astype(bool)
        self.counts = np.frombuffer(index, "<u4", m, 8 + 9 * m).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", m, 8 + 13 * m).astype(np.int64)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the file is cut short")
        return data

    def frame(self, i: int) -> bytes:
        import xxhash

        data = self.zstd.decompress(self._at(int(self.offsets[i]), int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
        if len(data) != self.table[i, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} does not match its checksum")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(position in the file, ids as bytes) of all or the wanted positions;
        a frame is read once for consecutive positions, and only if needed."""
        ends = 4 * np.cumsum(self.counts)
        open_frame, data = -1, b""
        for p in range(len(self.ids)) if wanted is None else sorted(wanted):
            f = int(self.frames[p])
            if f != open_frame:
                open_frame, data = f, self.frame(f)
                base = int(ends[int(np.searchsorted(self.frames, f)) - 1]) if f else 0
            yield p, data[int(ends[p]) - 4 * int(self.counts[p]) - base : int(ends[p]) - base]


def _file_system(path: str):
    """File system and path of a shared folder, by its URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def write_ids(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write the files under ``folder`` and return their manifest (stored)."""
    end = struct.pack("<I", end_id)

    def run(batches):
        encode, file_system, out, sink, path = encoder(tokenizer).encode, None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                file_system, base = _file_system(folder)
                file_system.create_dir(base, recursive=True)
                path = f"{base}/ids-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zst"
                sink = file_system.open_output_stream(path, compression=None)
                out = Writer(sink, frame_ids)
            keys = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                ids, offsets = encode(piece)
                ids = ids.astype("<u4", copy=False).tobytes()
                for k, a, b in zip(keys[piece.lo : piece.hi], (4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True):
                    out.add(k, ids[a:b] + end)
        if out is not None:
            out.close()
            sink.close()
            yield pa.record_batch([[TaskContext.get().partitionId()], [path], [len(out.ids)], [out.n_ids], [out.bytes]], schema=_schema())

    def _schema():
        return pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file_system, path = _file_system(path)
                with file_system.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    crc = np.fromiter((zlib.crc32(ids) for _, ids in reader.documents()), np.int64, len(reader.ids))
                before = start + np.concatenate([[0], np.cumsum(reader.counts)[:-1]]).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(reader.ids, mask=~reader.has_id), pa.array(before), pa.array(reader.counts), pa.array(crc)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = max(1, manifest.count())
    spread = files.select("path", "start").repartition(shards, "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    return read_ids(write_ids(docs, scratch_path(spark, "token-ids")))


@register("op10_token_output")
def op10_token_output(spark, sf_dir):
    return digest(spark, read_table(spark, sf_dir, "documents"))
