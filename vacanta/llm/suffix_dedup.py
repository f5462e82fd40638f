"""Repeated byte strings by a radix sort of all suffixes, no deeper than the length that counts.

A suffix is sorted by digits, the most significant first, and only as long as its group holds suffixes of several
texts. Its first digit is no fixed number of leading bytes, which would put all suffixes that begin with a common word
into one group, but its seed: of all strings of `SEED` bytes in its first `length` bytes the one with the smallest hash.
Equal windows have equal seeds, and neighbouring suffixes mostly share theirs, so that they travel as one run.

    1. seeds of all texts, counted: runs whose seed stands in one text only are done
    2. the whole run as a digit: a run that stands in an earlier text, too, is repeated in all its windows
    3. what is left, dealt by seed, is sorted by digits of eight bytes up to `length`; equal groups are the repeated
       windows. Groups of very many runs are cut further by the window itself and reduced before they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.common import dropped, in_slices, without, written
from vacanta.llm.jaccard_join import shared_postings

#: Bytes of a seed, and the least length of strings.
SEED, LEAST = 24, 20
#: Bytes that are hashed at once, and suffixes that are sorted at once (more where one seed has more).
CHUNK, SORTED = 1 << 18, 1 << 19
#: Runs of one seed that are sorted in one task; further digits deal out seeds of more.
HOT = 16384
#: Parts, by seed, that runs are sorted in one after the other, so that their shuffles do not lie on disk together.
PARTS = 2
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(29)
    return h


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes, from hashes of halves, down to words of eight bytes or to bytes."""
    width = 1 if size % 8 else 8
    part = _mixed((data.astype("u8") if width == 1 else _eights(data)) + _U(0x9E3779B97F4A7C15))
    size //= width
    out, done = None, 0
    while size:
        if size & 1:
            out, done = (part, width) if out is None else (_joined(out, done, part, width, len(data)), done + width)
        size >>= 1
        if size:
            part, width = _joined(part, width, part, width, len(data)), 2 * width
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """Each eight neighbouring bytes as one number."""
    out = np.empty(max(len(data) - 7, 0), "u8")
    for k in range(min(8, len(out))):
        out[k::8] = data[k:k + (len(data) - k) // 8 * 8].view("<u8")
    return out


def _joined(x: np.ndarray, nx: int, y: np.ndarray, ny: int, total: int) -> np.ndarray:
    n = max(total - nx - ny + 1, 0)
    return _mixed(x[:n] * _U(0xFF51AFD7ED558CCD) + y[nx:nx + n])


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` neighbours."""
    step = 1
    while 2 * step <= span:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = span - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of_windows(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one seed in texts laid end to end: seed, first window and number of windows.

    `ends` has the end of each text. Runs are cut at the number of windows that a seed fits in, and at chunks.
    """
    size = min(SEED, length)
    span = length - size + 1
    for begin in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[begin:begin + CHUNK + length - 1]
        seed = smallest(rolled(part, size), span)
        place = np.arange(begin, begin + len(seed))
        text = np.searchsorted(ends, place, "right")
        inside = place + length <= ends[text]
        place, seed, text = place[inside], seed[inside], text[inside]
        if not len(place):
            continue
        new = np.r_[True, (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])]
        first = np.flatnonzero(new)
        within = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
        first = np.flatnonzero(within % span == 0)
        yield seed[first].view("i8"), place[first], np.diff(np.r_[first, len(place)])


def _laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, and the end of each value."""
    values = [v.as_py() for v in column]
    return np.frombuffer(b"".join(values), "u1"), np.cumsum([len(v) for v in values], dtype="i8")


def seeds_of(texts: DataFrame, length: int) -> DataFrame:
    """`seed` and `u` for each text: its seeds, each once in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "bytes"):
            data, ends = _laid(batch.column("bytes"))
            u = batch.column("u").to_numpy()
            for seed, place, _ in runs_of_windows(data, ends, length):
                owner = u[np.searchsorted(ends, place, "right")]
                order = np.lexsort((seed, owner))
                seed, owner = seed[order], owner[order]
                new = np.r_[True, (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(seed[new]), pa.array(owner[new])], names=["seed", "u"])

    return texts.select("u", "bytes").mapInArrow(run, "seed long, u long")


def runs_with(texts: DataFrame, length: int) -> DataFrame:
    """Runs of the texts whose seed is in their list `seeds`: `u`, `first`, `seed`, `start`, `bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "bytes"):
            data, ends = _laid(batch.column("bytes"))
            raw, begins = data.tobytes(), np.r_[0, ends[:-1]]
            wanted = batch.column("seeds")
            known = wanted.flatten().to_numpy()
            # Seeds and their texts as one sorted list of pairs.
            owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            order = np.lexsort((known, owner))
            known, owner = known[order], owner[order]
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for seed, place, n in runs_of_windows(data, ends, length):
                text = np.searchsorted(ends, place, "right")
                cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
                keep = np.zeros(len(seed), bool)
                for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    own = known[bounds[text[begin]]:bounds[text[begin] + 1]]
                    if len(own):
                        found = np.searchsorted(own, seed[begin:end]).clip(max=len(own) - 1)
                        keep[begin:end] = own[found] == seed[begin:end]
                seed, place, n, text = seed[keep], place[keep], n[keep], text[keep]
                row = pa.array(text)
                pieces = [raw[p:p + k + length - 1] for p, k in zip(place.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u").take(row), batch.column("first").take(row), pa.array(seed),
                     pa.array(place - begins[text]), pa.array(pieces, pa.binary())],
                    names=["u", "first", "seed", "start", "bytes"],
                )

    return texts.mapInArrow(run, "u long, first long, seed long, start long, bytes binary")


def equal_groups(windows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The group of equal rows each row of bytes is in, or -1 where it equals no other.

    A radix sort by digits of eight bytes, the most significant first. Rows that are alone in their group after a
    digit are sorted no further. `group` has a first digit already.
    """
    size = windows.shape[1]
    padded = np.zeros((len(windows), -(-size // 8) * 8), "u1")
    padded[:, :size] = windows
    digits = padded.view(">u8")
    out = np.full(len(windows), -1)
    row = np.arange(len(windows))
    for at in range(digits.shape[1]):
        digit = digits[row, at].astype("u8")
        order = np.lexsort((digit, group))
        row, group, digit = row[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(row) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1 if len(row) else new
        row, group = row[several], number[several]
    out[row] = group
    return out


def spans_of(rows: DataFrame, length: int) -> DataFrame:
    """Windows of the runs (`u`, `first`, `seed`, `start`, `bytes`) that stand in a run of an earlier text:
    `u`, `start` and `stop`. All runs of a seed have to be in one partition, one after the other."""

    def sort(held: list[tuple]) -> pa.RecordBatch | None:
        u, first, seed, start, pieces = (np.concatenate(c) for c in zip(*held))
        sizes = np.array([len(p) for p in pieces], "i8")
        n = sizes - length + 1
        data = np.frombuffer(b"".join(pieces), "u1")
        piece = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        place = (np.cumsum(sizes) - sizes)[piece] + offset
        windows = np.lib.stride_tricks.sliding_window_view(data, length)[place]
        group = equal_groups(windows, np.unique(seed, return_inverse=True)[1][piece])
        row = np.flatnonzero(group >= 0)
        if not len(row):
            return None
        least = np.full(group.max() + 1, np.iinfo("i8").max)
        np.minimum.at(least, group[row], first[piece[row]])
        row = row[least[group[row]] < first[piece[row]]]
        if not len(row):
            return None
        # Neighbouring windows of a run as one span.
        new = np.r_[True, (np.diff(row) != 1) | (np.diff(piece[row]) != 0)]
        begin = row[new]
        last = row[np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1]]
        own = piece[begin]
        columns = [pa.array(u[own]), pa.array(start[own] + offset[begin]), pa.array(start[own] + offset[last] + length)]
        return pa.RecordBatch.from_arrays(columns, names=["u", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "first", "seed", "start", "bytes")]
            seed, at = columns[2], 0
            new = np.flatnonzero(np.r_[not held or held[-1][2][-1] != seed[0], seed[1:] != seed[:-1]])
            many = np.cumsum(np.fromiter(map(len, columns[4]), "i8", len(seed)) - length + 1)
            # Cut between seeds whenever enough is held.
            for cut in new.tolist():
                size = int(many[cut - 1]) if cut else 0
                if windows + size - (int(many[at - 1]) if at else 0) >= SORTED:
                    held.append([c[at:cut] for c in columns])
                    if (found := sort(held)) is not None:
                        yield found
                    held, windows, at = [], 0, cut
            held.append([c[at:] for c in columns])
            windows += int(many[-1]) - (int(many[at - 1]) if at else 0)
        if held and (found := sort(held)) is not None:
            yield found

    return rows.select("u", "first", "seed", "start", "bytes").mapInArrow(run, "u long, start long, stop long")


def windows_of(rows: DataFrame, length: int) -> DataFrame:
    """One row per window of the runs: `u`, `first`, `start` and `window`."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("__at")
    each = rows.select("u", "first", "start", "bytes", at)
    window = F.substring("bytes", F.col("__at") + 1, F.lit(length))
    return each.select("u", "first", (F.col("start") + F.col("__at")).alias("start"), window.alias("window"))


def merged_spans(spans: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Of each row's spans those that overlap or touch as one: row, start and stop, in order."""
    row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    start, stop = (flat.field(n).to_numpy() for n in ("start", "stop"))
    apart = int(stop.max(initial=0)) + 1  # rows laid so far apart that no span reaches into the next
    order = np.argsort(start + row * apart, kind="stable")
    row, start, stop = row[order], (start + row * apart)[order], (stop + row * apart)[order]
    upto = np.maximum.accumulate(stop) if len(stop) else stop
    new = np.r_[True, start[1:] > upto[:-1]] if len(row) else np.zeros(0, bool)
    ends = upto[np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1]] if len(row) else upto
    return row[new], start[new] - row[new] * apart, ends - row[new] * apart


def removed(texts: DataFrame) -> DataFrame:
    """Texts (`key`, `first`, `bytes`, `spans`) with what stands outside their spans: `key`, `first`, `n_removed`,
    `n_spans`, `kept`. A text without spans is kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "bytes"):
            row, start, stop = merged_spans(batch.column("spans"))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            start, stop, kept = start.tolist(), stop.tolist(), []
            for text, begin, end in zip(batch.column("bytes"), bounds, bounds[1:]):
                raw = text.as_py()
                edges = zip([0, *stop[begin:end]], [*start[begin:end], len(raw)])
                kept.append(b"".join([raw[i:j] for i, j in edges]))
            sizes = pc.binary_length(batch.column("bytes")).to_numpy().astype("i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("first"), pa.array(sizes - np.array([len(k) for k in kept], "i8")),
                 pa.array(np.diff(bounds)), pa.array(kept, pa.binary())],
                names=["key", "first", "n_removed", "n_spans", "kept"],
            )

    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans")
    return texts.select("key", "first", "bytes", spans).mapInArrow(
        run, "key binary, first long, n_removed long, n_spans long, kept binary"
    )


def _repeated(runs: DataFrame, length: int, hot: int) -> DataFrame:
    """`u`, `start` and `stop` of the windows of runs that stand in an earlier text. All runs of a seed must be there."""
    # Runs that stand in one text only, or in texts of one id, are new there: they need no partner in the join.
    least = runs.groupBy("bytes").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    least = written(least.filter("least < most").select("bytes", "least"), "least")
    new = F.col("least").isNull() | (F.col("first") == F.col("least"))
    judged = runs.join(least, "bytes", "left").select(
        "u", "first", "seed", "start", (F.col("start") + F.octet_length("bytes")).alias("stop"), F.when(new, F.col("bytes")).alias("bytes")
    )
    judged = written(judged, "judged")
    dropped(least)
    left = judged.filter("bytes is not null")
    common = written(left.groupBy("seed").count().filter(F.col("count") > hot).select("seed"), "common")
    dealt = left.join(common, "seed", "left_anti").repartition("seed").sortWithinPartitions("seed")
    each = windows_of(left.join(common, "seed", "left_semi"), length)
    earlier = each.groupBy("window").agg(F.min("first").alias("least"))
    repeated = each.join(earlier, "window").filter(F.col("least") < F.col("first"))
    spans = (
        judged.filter("bytes is null").select("u", "start", "stop")
        .unionByName(spans_of(dealt, length))
        .unionByName(repeated.select("u", "start", (F.col("start") + length).alias("stop")))
    )
    out = written(spans, "repeated")
    dropped(judged, common)
    return out


def remove_repeated_windows(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", kept=lambda c: c, hot: int = HOT,
) -> DataFrame:
    """Every document without the bytes of `length`-byte strings that also start in a document of a smaller id.

    Adds `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and `kept`: the remaining UTF-8 bytes, or what the
    column function `kept` makes of them. Strings are judged on the input; they may overlap. Equal texts are sorted
    once, as the smallest of their ids. All comparisons are on the bytes themselves, hashes only deal them out.

    NULL and empty texts are empty; texts shorter than `length` are kept. A NULL id is smaller than all others; rows of
    one id remove nothing from each other. `length` has to be at least 20 (`LEAST`). Input columns called like an
    added one are replaced, all others but the text are kept. No rows give no rows.
    """
    if length < LEAST:
        raise ValueError(f"length must be at least {LEAST}")
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rest = without(docs, *added, text_col).columns
    rows = without(docs, *[a for a in added if a != text_col]).withColumns({
        "__rank": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")), "__bytes": raw,
        "__size": F.octet_length(raw).cast("long"), "__key": F.unhex(F.sha2(raw, 256)),
    })
    long = F.col("__size") >= length
    texts = rows.filter(long).groupBy(F.col("__key").alias("key")).agg(
        F.min("__rank").alias("first"), F.first("__bytes").alias("bytes")
    )
    texts = written(texts.withColumn("u", F.monotonically_increasing_id()), "texts")

    # Few seeds of one text only may stay: their runs have no partner later on.
    seeds = written(seeds_of(texts, length).select(F.col("seed").alias("token"), F.col("u").alias("rid")), "seeds")
    wanted = shared_postings(seeds).groupBy(F.col("rid").alias("u")).agg(F.collect_list("token").alias("seeds"))
    wanted = written(wanted, "wanted")
    dropped(seeds)
    runs = written(runs_with(texts.join(wanted, "u"), length), "runs")
    dropped(wanted)

    spans = None
    for part in range(PARTS):
        found = _repeated(runs.filter(F.pmod("seed", F.lit(PARTS)) == part), length, hot)
        spans = found if spans is None else spans.unionByName(found)
    dropped(runs)
    # A text's own spans: no more than it has bytes.
    listed = spans.groupBy("u").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # All texts at once: two joins would hold the texts on disk twice, and what is kept of them as well.
    cut = removed(texts.select("u", "key", "first", "bytes").join(listed, "u", "left"))
    found = cut.select("key", "first", "n_removed", "n_spans", kept(F.col("kept")).alias("__kept"))
    found = written(found.withColumnsRenamed({"key": "__key", "first": "__first", "n_removed": "__removed", "n_spans": "__spans"}), "kept")
    dropped(texts)
    narrow = rows.withColumn("__own", F.when(~long, kept(F.col("__bytes")))).select(
        *[F.col(f"`{c}`") for c in rest], "__rank", "__size", "__own", F.when(long, F.col("__key")).alias("__key")
    )
    copy = F.col("__rank") > F.col("__first")
    none = F.lit(0).cast("long")
    return narrow.join(found, "__key", "left").select(
        *[F.col(f"`{c}`") for c in rest], F.col("__size").alias("n_bytes"),
        F.when(copy, F.col("__size")).otherwise(F.coalesce("__removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("__spans", none)).alias("n_spans"),
        F.when(copy, kept(F.lit(b""))).otherwise(F.coalesce("__kept", "__own")).alias("kept"),
    )
