"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file holds, in this order, frames of packed ids (unsigned 32-bit,
little-endian; each frame some whole documents), one skippable frame with the
document index (a zstandard-compressed Arrow stream: doc_id, n_tokens, frame),
and the seek table of the zstandard seekable format, a skippable frame whose
last nine bytes tell the number of entries.  Any zstandard tool reads the ids; a
reader that wants some documents fetches the table, the index and their frames."""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root
from .common import read_table, shared_table, text_of
from .vocab import word_bpe

# The seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER, SKIPPABLE_HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 256 * 1024
FILE_BYTES = 256 * 1024 * 1024


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes one file; documents come in order."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self._out, self._limit = out, frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._open: list[bytes] = []
        self._entries: list[tuple[int, int, int]] = []
        self._ids, self._counts, self._frames = [], [], []
        self.bytes, self._held = 0, 0

    def add(self, doc_id, ids: bytes) -> None:
        if self._held and self._held + len(ids) > self._limit:
            self._flush()
        self._open.append(ids)
        self._held += len(ids)
        self._ids.append(doc_id)
        self._counts.append(len(ids) // 4)
        self._frames.append(len(self._entries))

    def _write(self, packed: bytes, size: int, checksum: int) -> None:
        self._out.write(packed)
        self._entries.append((len(packed), size, checksum))
        self.bytes += len(packed)

    def _flush(self) -> None:
        raw = b"".join(self._open)
        self._write(self._zstd.compress(raw), len(raw), _checksum(raw))
        self._open, self._held = [], 0

    def close(self, id_type: pa.DataType) -> None:
        if self._open:
            self._flush()
        index = pa.table({"doc_id": pa.array(self._ids, id_type), "n_tokens": pa.array(self._counts, pa.uint32()),
                          "frame": pa.array(self._frames, pa.uint32())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        packed = self._zstd.compress(sink.getvalue())
        packed = SKIPPABLE_HEAD.pack(SKIPPABLE_INDEX, len(packed)) + packed
        self._write(packed, 0, _checksum(packed))
        table = b"".join(ENTRY.pack(*e) for e in self._entries)
        table += FOOTER.pack(len(self._entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._out.write(SKIPPABLE_HEAD.pack(SKIPPABLE_TABLE, len(table)) + table)


class TokenFileReader:
    """Reads documents of one file by their place; only their frames are fetched."""

    def __init__(self, file, size: int):
        self._file = file
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table = self._at(size - FOOTER.size - count * ENTRY.size, count * ENTRY.size)
        self._entries = list(ENTRY.iter_unpack(table))
        self._starts = np.concatenate([[0], np.cumsum([e[0] for e in self._entries])])
        packed = self._checked(self._at(int(self._starts[count - 1]), self._entries[-1][0]), count - 1)
        index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed[SKIPPABLE_HEAD.size:])).read_all()
        self.doc_ids, self.n_tokens, self.frames = index["doc_id"], index["n_tokens"].to_numpy(), index["frame"].to_numpy()
        before = np.concatenate([[0], np.cumsum(self.n_tokens, dtype=np.int64)])
        self.starts = before[:-1]
        first = np.searchsorted(self.frames, np.arange(count - 1))
        self._frame_starts = before[first]
        self._frame: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self._file.seek(start)
        return self._file.read(size)

    def _checked(self, raw: bytes, frame: int) -> bytes:
        if _checksum(raw) != self._entries[frame][2]:
            raise ValueError(f"checksum of frame {frame} differs")
        return raw

    def __len__(self) -> int:
        return len(self.n_tokens)

    def ids(self, place: int) -> bytes:
        """Packed ids of the document at ``place`` in the file."""
        frame = int(self.frames[place])
        if self._frame[0] != frame:
            size, raw_size, _ = self._entries[frame]
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self._starts[frame]), size), max_output_size=raw_size)
            self._frame = (frame, self._checked(raw, frame))
        a = 4 * int(self.starts[place] - self._frame_starts[frame])
        return self._frame[1][a:a + 4 * int(self.n_tokens[place])]


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, root: str, path: str, end_id: int = 1, id_col: str = "doc_id",
                      text_col: str = "text", frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode each whole text with the tokenizer file at ``path``, append
    ``end_id``, and write the ids in ascending doc_id order under ``root`` (any
    store that pyarrow opens).  Returns the manifest: part, seq, file, n_docs,
    n_tokens, start (ids in all files before).

    Rows are dealt by ranges of (doc_id, hash of the text), so rows that repeat
    an id, null included (first), are split as well.  A task streams one range
    into files of about ``file_bytes``; a file gets its name when it is whole, and
    a task that runs again writes the same bytes under the same name.  Null is
    the empty text (only the end id).  An empty table gives an empty manifest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        bpe, end = word_bpe(path), struct.pack("<I", end_id)
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        found, seq, out, writer, n_docs, n_tokens, id_type = [], 0, None, None, 0, 0, None

        def finish() -> None:
            nonlocal out, writer, seq, n_docs, n_tokens
            writer.close(id_type)
            out.close()
            name = f"{base}/tokens-{part:06d}-{seq:04d}.zst"
            fs.move(f"{base}/.{attempt}-{seq}", name)
            found.append((part, seq, os.path.basename(name), n_docs, n_tokens))
            out, writer, seq, n_docs, n_tokens = None, None, seq + 1, 0, 0

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is None:
                    out = fs.open_output_stream(f"{base}/.{attempt}-{seq}")
                    writer = TokenFileWriter(out, frame_bytes)
                ids = bpe.encode_bytes(text.as_py()) + end
                writer.add(doc_id, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4
                if writer.bytes >= file_bytes:
                    finish()
        if writer is not None:
            finish()
        names = ["part", "seq", "file", "n_docs", "n_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

    manifest = shared_table(ordered.mapInArrow(
        run, "part bigint, seq bigint, file string, n_docs bigint, n_tokens bigint"), "token-manifest")
    # one row per file of up to file_bytes: parts first, then the files of a part
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").select(
        *manifest.columns, (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def read_token_files(manifest: DataFrame, root: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files:
    one task per file, frames decompressed one at a time and checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{base}/{name}"
                with fs.open_input_file(at) as f:
                    reader = TokenFileReader(f, f.size())
                    crcs = [zlib.crc32(reader.ids(i)) for i in range(len(reader))]
                ids = reader.doc_ids
                ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(reader.starts + start, pa.int64()), pa.array(reader.n_tokens, pa.int64()),
                     pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(
        run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    root = f"{checkpoint_root(spark)}/fieldpulse-tokens-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
    manifest = shared_table(write_token_files(
        read_table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json")), "token-files")
    return read_token_files(manifest, root)
