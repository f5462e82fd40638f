"""Concatenate and cut: documents laid end to end as token ids and cut into fixed windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from vacanta.llm.common import in_slices, written
from vacanta.llm.prefix import add_offsets, in_order, numbered, numbered_schema
from vacanta.llm.tokens import forget_tokenizers, worker_tokenizer

PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FLUSH = 4 << 20


def tokenized(docs: DataFrame, kind: str, path: str, end_id: int, text_col: str) -> DataFrame:
    """Replace the text by `ids` (little-endian uint32, the end id last) and `n`, their number; number the rows.

    One function does both, so a task needs one Python worker.
    """
    names = [c for c in docs.columns if c != text_col]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(kind, path).encode
        for batch in batches:
            texts, at = batch.column(text_col), 0
            while at < batch.num_rows:
                ids, begin, size = [], at, 0
                while at < batch.num_rows and size < _FLUSH:
                    ids.append(encode(texts[at].as_py() or "") + end)
                    size += len(ids[-1])
                    at += 1
                held = batch.slice(begin, at - begin)
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                columns = [*[held.column(n) for n in names], pa.array(ids, pa.binary()), counts]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "n"])

    fields = [docs.schema[c] for c in names]
    schema = StructType([*fields, StructField("ids", BinaryType()), StructField("n", LongType())])
    number = numbered(["n"])
    return docs.mapInArrow(lambda batches: number(run(batches)), numbered_schema(schema, ["n"]))


def _laid(docs: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The first pass: `__id`, `ids`, `n` and `__before_n`, the ids of all documents before."""
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    order = [F.col("__id"), F.xxhash64("__text"), F.monotonically_increasing_id()]
    ids = tokenized(in_order(slim, order), kind, tokenizer, end_id, "__text")
    laid, _ = add_offsets(written(ids, "packing"), {"__before_n": F.col("n")})
    return laid.select("__id", "ids", "n", "__before_n")


def _cut(length: int) -> Callable:
    """Pieces of the documents that a batch of the first pass holds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()  # this worker may have tokenized before
        for batch in in_slices(batches, "ids"):
            raw = batch.column("ids")
            n, at = (batch.column(c).to_numpy().astype("i8") for c in ("n", "__before_n"))
            count = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), count)
            window = at[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(window * length, at[row])
            size = np.minimum((window + 1) * length, at[row] + n[row]) - begin
            start = begin - at[row]
            values, where, known = [], -1, b""
            for r, s, k in zip(row.tolist(), start.tolist(), size.tolist()):
                if r != where:
                    where, known = r, raw[r].as_py()
                values.append(known[4 * s:4 * (s + k)])
            out = [start, size, pa.array(values, pa.binary()), n[row], window, begin - window * length]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(row)), *map(pa.array, out)],
                names=["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return cut


def pack_documents(
    docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, length: int = 2048,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into windows of `length` tokens; one row per piece of a document in a window.

    Documents are tokenized in ascending order of their id, each followed by `end_id`, and laid end to end. A first
    pass writes ids and per-partition sums; totals per partition turn these into global offsets; the second pass
    cuts at every multiple of `length`. Returns the id, `start` (the document's ids before the piece), `length`,
    `ids`, `doc_tokens`, `sequence_id` and `offset` in that window. Only the last window can be short.

    A NULL or empty text is its end id alone; NULL ids come first, rows with one id are ordered by a hash of their
    text, and equal rows are packed as often as they occur. No rows give no rows. Other columns are left out.
    """
    laid = _laid(docs, tokenizer, kind, end_id, id_col, text_col)
    kind_of_id = laid.schema["__id"].dataType.simpleString()
    return laid.mapInArrow(_cut(length), f"__id {kind_of_id}, {PIECE}").withColumnRenamed("__id", id_col)


def pack_sequences(
    docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, length: int = 2048, pad_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`packed_sequences` of `pack_documents`, cut and put together by one function, so that a task needs one Python
    worker and pieces never leave it."""
    laid = _laid(docs, tokenizer, kind, end_id, id_col, text_col)
    cut, assemble = _cut(length), _assemble(length)
    parts = laid.mapInArrow(lambda batches: assemble(cut(batches)), _part_schema(laid.schema["__id"].dataType))
    return _joined_windows(written(parts, "windows"), length, pad_id)


def _part_schema(id_type) -> str:
    return f"sequence_id long, offset long, doc_ids array<{id_type.simpleString()}>, lengths array<long>, ids binary"


def packed_sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Windows put together from the pieces of `pack_documents`: one row per sequence.

    Returns `sequence_id`, `doc_ids` and `lengths` of the pieces in order, `n_tokens`, and `ids`, padded to `length`.
    A task emits each window that it holds completely; what it has of others are boundary records, which are
    grouped by window. Only these are shuffled. Needs pieces in the order `pack_documents` gives them; another
    order only makes more boundary records. Ids may be NULL; no pieces give no rows.
    """
    slim = packed.select(F.col(id_col).alias("__id"), "length", "ids", "sequence_id", "offset")
    parts = slim.mapInArrow(_assemble(length), _part_schema(packed.schema[id_col].dataType))
    return _joined_windows(written(parts, "windows"), length, pad_id)


def _assemble(length: int) -> Callable:
    """Whole windows, and boundary records of the others, from pieces in order."""
    names = ["sequence_id", "offset", "doc_ids", "lengths", "ids"]
    columns = ["__id", "length", "ids", "sequence_id", "offset"]

    def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_windows: dict[int, list] = {}
        id_type = None
        for batch in batches:
            id_type = batch.column("__id").type
            done = []
            for doc, size, ids, window, offset in zip(*[batch.column(c).to_pylist() for c in columns]):
                held = open_windows.setdefault(window, [])
                held.append((offset, doc, size, ids))
                if offset + size == length and sum(h[2] for h in held) == length:
                    done.append(joined(window, open_windows.pop(window)))
            if done:
                yield batch_of(done, id_type)
        if open_windows:
            # A window whose pieces do not follow one another gives a record for each run of pieces.
            yield batch_of([joined(w, run) for w, held in open_windows.items() for run in runs(held)], id_type)

    def runs(held: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for piece in sorted(held, key=lambda h: h[0]):
            if out and out[-1][-1][0] + out[-1][-1][2] == piece[0]:
                out[-1].append(piece)
            else:
                out.append([piece])
        return out

    def joined(window: int, held: list[tuple]) -> tuple:
        held = sorted(held, key=lambda h: h[0])
        return window, held[0][0], [h[1] for h in held], [h[2] for h in held], b"".join(h[3] for h in held)

    return assemble


def _joined_windows(parts: DataFrame, length: int, pad_id: int) -> DataFrame:
    """All windows, those of several records put together."""
    whole = F.octet_length("ids") == 4 * length
    fields = F.sort_array(F.collect_list(F.struct("offset", "doc_ids", "lengths", "ids")))
    edges = parts.filter(~whole).groupBy("sequence_id").agg(fields.alias("f")).select(
        "sequence_id", F.flatten("f.doc_ids").alias("doc_ids"), F.flatten("f.lengths").alias("lengths"),
        F.aggregate("f.ids", F.lit(b""), lambda joined_ids, x: F.concat(joined_ids, x)).alias("ids"),
    )
    windows = parts.filter(whole).select("sequence_id", "doc_ids", "lengths", "ids").unionByName(edges)
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit(length) - F.col("n_tokens").cast("int")))
    return windows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).select(
        "sequence_id", "doc_ids", "lengths", "n_tokens", F.concat("ids", pad).alias("ids")
    )
