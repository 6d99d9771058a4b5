"""Token ids as seekable zstandard files.

A file is a run of independent zstandard frames of token ids (little-endian uint16, or uint32 for large vocabularies).
Every document begins a frame of its own, and one of more than FRAME_TOKENS ids has several, so a reader decompresses
the frames of the documents that it wants and nothing else, and no frame grows with the longest document. Then comes one frame
that holds the document index (doc ids, null marks, token counts), then a skippable frame with the seek table in
the public zstd seekable layout: compressed size, decompressed size and the low 32 bits of XXH64 of each frame, and the
footer with the number of frames. A reader fetches the table from the file's end.

Files are written by one range-partitioned pass in ascending order of doc_id, then of the text's hash; the number of
partitions follows the bytes of the texts, and a partition writes a file for each MOST_BYTES or MOST_DOCUMENTS, so files
and their indexes stay bounded. Each task attempt writes files of its own names and returns a manifest row for each;
only files in the manifest count, so retries and lost executors leave no duplicate. The files go to the shared folder
through pyarrow's filesystems.

Defined results: null and empty text is the end id alone. Rows that share a doc_id are each written; null doc_ids
come first. An empty table makes no file and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import shared_dir, texts_of
from mnemospark.llm.tokens import byte_words

#: Fixed values of the public zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_TOKENS = 65_536
MOST_BYTES, MOST_DOCUMENTS = 64 << 20, 65_536  # of a file
PART_BYTES = 256 << 20  # of text in a partition
MANIFEST = "part int, file int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, part int, file int, position long, start long, n_tokens long, ids_crc32 long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _join(folder: str, name: str) -> str:
    return f"{folder.replace('file:///', '/').replace('file:/', '/')}/{name}" if folder.startswith("file:") else f"{folder}/{name}"


class Writer:
    """Builds one file in memory: frames are compressed as they fill."""

    def __init__(self, width: int = 2, level: int = 3):
        import zstandard

        self.dtype = {2: "<u2", 4: "<u4"}[width]
        self.width, self.zstd = width, zstandard.ZstdCompressor(level=level)
        self.out, self.table = bytearray(), []
        self.ids, self.null, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // self.width)
        size = FRAME_TOKENS * self.width
        for at in range(0, len(ids), size):
            self._frame(ids[at : at + size])

    def is_full(self) -> bool:
        return len(self.out) >= MOST_BYTES or len(self.ids) >= MOST_DOCUMENTS

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.out += packed
        self.table.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> bytes:
        index = struct.pack("<BQ", self.width, len(self.ids))
        index += np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.counts, "<u4").tobytes()
        self._frame(index)
        table = b"".join(self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out += struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer
        return bytes(self.out)


class Reader:
    """Random access to one file: reads the seek table and the index, then only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._read(size - 9, 9)
        n, flags, magic = struct.unpack("<IBI", tail)
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of this file")
        table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.raw, self.sums = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self.frame(n - 1)
        self.width, count = struct.unpack_from("<BQ", index)
        self.ids = np.frombuffer(index, "<i8", count, 9)
        self.null = np.frombuffer(index, "u1", count, 9 + 8 * count).astype(bool)
        self.counts = np.frombuffer(index, "<u4", count, 9 + 9 * count).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first = np.concatenate([[0], np.cumsum(-(-self.counts // FRAME_TOKENS))])  # frame of each document
        self.dtype = {2: "<u2", 4: "<u4"}[self.width]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(self.sizes[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.sums[k]):
            raise ValueError(f"frame {k} fails its checksum")
        return data

    def tokens(self, position: int) -> np.ndarray:
        """Ids of the document at a position in the file, as uint32."""
        frames = range(int(self.first[position]), int(self.first[position + 1]))
        return np.frombuffer(b"".join(map(self.frame, frames)), self.dtype).astype("<u4")

    def scan(self):
        """(position, crc32 of the ids as uint32) of every document, one frame in memory at a time."""
        for k in range(len(self.ids)):
            crc = 0
            for f in range(int(self.first[k]), int(self.first[k + 1])):
                crc = zlib.crc32(np.frombuffer(self.frame(f), self.dtype).astype("<u4").tobytes(), crc)
            yield k, crc


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes the files and returns the manifest (read from a written table)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, root = _fs(folder)
    fs.create_dir(root)
    rows = texts_of(docs)
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    end = np.array([end_id], "<u2").tobytes()

    def saved(part: int, number: int, writer: Writer) -> pa.RecordBatch:
        name, data, counts = _join(folder, f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.zst"), writer.close(), writer.counts
        fs, at = _fs(name)
        with fs.open_output_stream(at, compression=None) as f:
            f.write(data)
        row = [[part], [number], [name], [len(counts)], [sum(counts)], [len(data)]]
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    def write(batches):
        encoder, writer, number = byte_words(tokenizer), Writer(), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                writer.add(doc_id, encoder.encode(text.as_py()) + end)
                if writer.is_full():
                    yield saved(part, number, writer)
                    writer, number = Writer(), number + 1
        if writer.ids:
            yield saved(part, number, writer)

    order = ("doc_id", "tie")
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: its place, in its file and among all ids, and the checksum of its ids."""

    def read(batches):
        for b in batches:
            for part, file, path, size, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = _fs(path)
                with fs.open_input_file(at) as f:
                    r = Reader(f, size)
                    crc = np.array([c for _, c in r.scan()], np.int64)
                n = len(crc)
                cols = [pa.array(r.ids, mask=r.null), *[pa.array(np.full(n, x, np.int32)) for x in (part, file)], pa.array(np.arange(n)), pa.array(base + r.starts[:-1]), pa.array(r.counts), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ROWS.split(", ")])

    files = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file of MOST_BYTES or less
    placed = manifest.select("part", "file", "path", "n_bytes", F.coalesce(F.sum("n_tokens").over(files), F.lit(0)).alias("base"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, ROWS)


def token_output(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) and reads the files back: doc_id, start, n_tokens, ids_crc32 of every document."""
    return read_tokens(write_tokens(docs, tokenizer, end_id, folder, parts)).select("doc_id", "start", "n_tokens", "ids_crc32")
