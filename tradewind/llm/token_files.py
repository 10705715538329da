"""Token ids in seekable zstandard files, one independent frame per document.

A file holds, in this order: a zstandard frame per document (its ids as little-endian unsigned 32-bit integers), a
skippable frame with the documents' ids, and a skippable frame with the seek table of the public seekable format:
per frame the compressed size, the size of its content and the low 32 bits of its XXH64 checksum. A reader takes the
table from the end of the file and decompresses only the frames it needs; each is checked before it is used.
Files are in ascending order of doc_id, and so are the documents in them.

Null or empty text: only the end id. Null doc_id: comes first, like other nulls in ascending order. Repeated doc_ids:
a frame each, in order of their text. No documents: no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.shared import file_system, new_file, one_file_each, stored
from tradewind.llm.tokenizing import encoder

# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
ENTRY = np.dtype([("compressed", "<u4"), ("content", "<u4"), ("checksum", "<u4")])
FOOTER = struct.Struct("<IBI")

NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, path string, documents long, n_tokens long, bytes long"
READ_IDS = 2_000_000


class FileWriter:
    """Writes one file, a document at a time."""

    def __init__(self, folder: str, name: str, level: int = 3):
        self.path = new_file(folder, name) + ".zst"
        self.fs, self.place = file_system(self.path)
        self.fs.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.place, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int, content: bytes) -> None:
        frame = self.packer.compress(content)
        self.out.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.tokens += len(content) // 4

    def close(self) -> int:
        index = np.array(self.doc_ids, "<i8").tobytes()
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        size = self.out.tell()
        self.out.close()
        return size


class FileReader:
    """Reads the documents asked for, or all, from one file."""

    def __init__(self, path: str):
        fs, place = file_system(path)
        self.file = fs.open_input_file(place)
        end = self.file.size()
        n, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        at = end - FOOTER.size - n * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n, at - 8 - 8 * n), "<i8")
        self.ends = np.cumsum(self.entries["compressed"].astype(np.int64))
        self.unpacker = zstandard.ZstdDecompressor()

    def _checked(self, i: int, frame: bytes) -> bytes:
        content = self.unpacker.decompress(frame, max_output_size=int(self.entries["content"][i]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries["checksum"][i]:
            raise ValueError(f"checksum of frame {i} differs")
        return content

    def one(self, i: int) -> bytes:
        size = int(self.entries["compressed"][i])
        return self._checked(i, self.file.read_at(size, int(self.ends[i]) - size))

    def find(self, doc_id: int) -> list[bytes]:
        lo, hi = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.one(i) for i in range(lo, hi)]

    def all(self) -> Iterator[bytes]:
        """Every document in order, read in stretches of a few megabytes."""
        at = 0
        while at < len(self.ends):
            start = int(self.ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(self.ends, start + (4 << 20), "right")))
            raw = self.file.read_at(int(self.ends[to - 1]) - start, start)
            for i in range(at, to):
                yield self._checked(i, raw[int(self.ends[i] - self.entries["compressed"][i]) - start : int(self.ends[i]) - start])
            at = to


def write(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encodes (doc_id, text) and writes the files; the manifest has one row per file, ``part`` ascending with doc_id.

    Texts are dealt out by ranges of doc_id, so each task writes the file of one range; nothing else is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, end = TaskContext.get().partitionId(), None, int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).tolist()
            for at, tokens, sizes in encoder(vocabulary).encode(batch.column("text")):
                raw, stop = tokens.tobytes(), 0
                for doc_id, n in zip(ids[at:], sizes.tolist()):
                    out = out or FileWriter(f"{folder}/files", f"part-{part:06d}")
                    out.add(doc_id, raw[4 * stop : 4 * (stop + n)] + end)
                    stop += n
        if out:
            size = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [out.path], "documents": [len(out.doc_ids)], "n_tokens": [out.tokens], "bytes": [size]})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds the number of ids in all earlier files. One row per file is summed, not one per document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) per document, from the files: ids as little-endian unsigned 32-bit integers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start in zip(part["path"], part["start"].tolist()):
                reader, rows, held = FileReader(path), [], 0
                for doc_id, content in zip(reader.doc_ids.tolist(), reader.all()):
                    rows.append((None if doc_id == NO_ID else doc_id, start, content))
                    start, held = start + len(content) // 4, held + len(content) // 4
                    if held > READ_IDS:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    return one_file_each(with_starts(manifest), "part").mapInPandas(run, "doc_id long, start long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    doc_id, start, ids = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({"doc_id": pd.array(doc_id, "Int64"), "start": np.array(start, np.int64), "ids": list(ids)})


def digest(documents: DataFrame) -> DataFrame:
    """What a reader can compare without moving the ids."""
    return documents.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
