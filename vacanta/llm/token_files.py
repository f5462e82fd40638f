"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file, all numbers little-endian:

    one zstandard frame per document    its ids as unsigned 32-bit numbers
    one skippable frame 0x184D2A5D      id, whether it is not NULL, and number of ids, per document
    one skippable frame 0x184D2A5E      the seek table of the public seekable format: compressed size, size and
                                        checksum (low 32 bits of XXH64 of the ids) per frame, then the number
                                        of frames, a flag byte (checksums present) and the magic 0x8F92EAB1

Any zstandard reader can decompress a whole file; a reader of one document reads the tail, then one frame.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.common import written
from vacanta.llm.prefix import in_order
from vacanta.llm.tokens import worker_tokenizer

# Fixed values of the public formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
_INDEX = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_FOOTER = "<IBI"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
_TAIL = 64 << 10
#: A frame holds at most this many bytes of ids, as the seek table's sizes are 32 bits wide; longer documents
#: take several frames.
FRAME_BYTES = 1 << 30


def store(path: str):
    """File system and path, for local folders and any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class TokenFile:
    """Writes one file."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        files, self.at = store(path)
        files.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(self.at, compression=None)  # else the name decides
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.index: list[tuple] = []
        self.seek: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        for begin in range(0, max(len(ids), 1), FRAME_BYTES):
            part = ids[begin:begin + FRAME_BYTES]
            frame = self.pack.compress(part)
            self.out.write(frame)
            self.seek.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.index.append((doc_id or 0, doc_id is not None, len(ids) // 4))

    def close(self) -> None:
        index = np.array(self.index, _INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # The index and the table describe frames of ids only; both are skippable frames themselves.
        table = np.array(self.seek, _SEEK).tobytes() + struct.pack(_FOOTER, len(self.seek), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class TokenFileReader:
    """Reads chosen documents of one file: its tail first, then only their frames."""

    def __init__(self, path: str):
        import zstandard

        files, at = store(path)
        self.file = files.open_input_file(at)
        self.unpack = zstandard.ZstdDecompressor()
        size = self.file.size()
        tail = self._read(size - min(size, _TAIL), min(size, _TAIL))
        frames, flags, magic = struct.unpack(_FOOTER, tail[-_FOOTER_BYTES:])
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        table_bytes = frames * _SEEK.itemsize
        table_at = size - _FOOTER_BYTES - table_bytes
        self.seek = np.frombuffer(self._read(table_at, table_bytes), _SEEK)
        self.begins = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype="i8")])
        head, length = struct.unpack("<II", self._read(int(self.begins[-1]), 8))
        if head != SKIPPABLE_INDEX:
            raise ValueError(f"{path} has no index of documents")
        self.index = np.frombuffer(self._read(int(self.begins[-1]) + 8, length), _INDEX)
        frames_of = np.maximum(1, -(-4 * self.index["n"].astype("i8") // FRAME_BYTES))
        self.frame_of = np.concatenate([[0], np.cumsum(frames_of)])

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, row: int) -> bytes:
        """Ids of the document at this place in the index, with their checksums tested."""
        import xxhash

        out = []
        for frame in range(int(self.frame_of[row]), int(self.frame_of[row + 1])):
            raw = self._read(int(self.begins[frame]), int(self.seek["packed"][frame]))
            part = self.unpack.decompress(raw, max_output_size=int(self.seek["size"][frame]))
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.seek["checksum"][frame]:
                raise ValueError(f"frame {frame} is damaged")
            out.append(part)
        return b"".join(out)

    def rows_of(self, doc_ids: set[int]) -> list[int]:
        wanted = np.isin(self.index["id"], np.array(sorted(doc_ids), "i8")) & (self.index["known"] == 1)
        return np.flatnonzero(wanted).tolist()

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the ids of all documents below `path`, in ascending order of their id; returns the manifest.

    Each partition of a range of ids becomes one file. A try of a task writes under a name of its own, and only
    the manifest of the tries that Spark counts says which files belong to the data set, so a lost executor or a
    second try leaves at most a file that nothing names. The manifest has `path`, `part`, `docs`, `ids`,
    `start` (the ids in the files before) and `first_id` to `last_id`.

    A NULL or empty text has its end id alone; NULL ids come first, rows with one id are ordered by a hash of
    their text, equal rows are all written. No rows give no files. Other columns are left out.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    order = [F.col("__id"), F.xxhash64("__text"), F.monotonically_increasing_id()]
    end = int(end_id).to_bytes(4, "little")
    names = ["part", "path", "docs", "ids", "first_id", "last_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(kind, tokenizer).encode
        part, out, total, known = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column("__id").to_pylist(), batch.column("__text")):
                if out is None:
                    name = f"{path}/part-{part:05d}-{uuid.uuid4().hex}.ids.zst"
                    out = TokenFile(name)
                ids = encode(text.as_py() or "") + end
                out.add(doc_id, ids)
                total += len(ids) // 4
                if doc_id is not None:
                    known = [*known[:1], doc_id]
        if out is not None:
            out.close()
            row = [part, name, len(out.index), total, *(known[:1] or [None]), *(known[-1:] or [None])]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    schema = "part int, path string, docs long, ids long, first_id long, last_id long"
    files = written(in_order(slim, order).mapInArrow(run, schema), "manifest")
    # One row per file.
    start, rows = 0, []
    for r in files.orderBy("part").collect():
        rows.append((*r, start))
        start += r["ids"]
    return docs.sparkSession.createDataFrame(rows, f"{schema}, start long")


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents from the files of a manifest: `doc_id`, `start`, `n_tokens` and `ids` as little-endian uint32.

    With `doc_ids`, a short list, only files whose range holds one are opened and only their frames are read.
    `start` counts the ids of all documents before.
    """
    if doc_ids is not None:
        within = [F.lit(i).between(F.col("first_id"), F.col("last_id")) for i in doc_ids]
        manifest = manifest.filter(F.array_contains(F.array(F.lit(False), *within), True))
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                reader = TokenFileReader(path)
                n = reader.index["n"].astype("i8")
                starts = start + np.cumsum(n) - n
                rows = range(len(n)) if wanted is None else reader.rows_of(wanted)
                held, size = [], 0
                for row in rows:
                    doc = int(reader.index["id"][row]) if reader.index["known"][row] else None
                    held.append((doc, int(starts[row]), int(n[row]), reader.ids(row)))
                    size += len(held[-1][3])
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)
                reader.close()

    # One row per file. A number of its own, as else the few bytes of the manifest would all be read by one task.
    files = manifest.select("path", "start").repartition(max(manifest.count(), 1), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(v, t) for v, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
