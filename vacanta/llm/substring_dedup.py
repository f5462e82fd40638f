"""Passages that stand in several documents, also with small changes, by chaining shared word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.common import dropped, runs_of, written
from vacanta.llm.wordhash import mixed, word_hashes

#: Words of a block in which passages' words travel to their alignment.
BLOCK = 64
#: Types of ids that Arrow orders as Spark does.
_ORDERED = ("tinyint", "smallint", "int", "bigint", "string", "binary", "date")
_FACTOR = 0x9E3779B97F4A7C15


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` words, from runs of half the length."""
    if len(h) < n:
        return np.empty(0, "u8")
    total, size = h, 1
    for bit in bin(n)[3:]:
        total = total[:len(total) - size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + total[size:]
        size *= 2
        if bit == "1":
            total = total[:len(total) - 1] * np.uint64(_FACTOR) + h[size:]
            size += 1
    return mixed(total)


def first_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The place of the first least value in each `wide` successive ones."""
    at, size = np.arange(len(values)), 1
    while size < wide:
        step = min(size, wide - size)
        one, other = at[:len(at) - step], at[step:]
        at = np.where(values[one] <= values[other], one, other)
        size += step
    return at


def seeds_of(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of minimizers: the least hash of k words in each `window` successive ones.

    Texts that share k + window - 1 words share one. Of equal hashes nearer than `window` the first is taken.
    """
    count = len(h) - k + 1
    if count < 1:
        return np.empty(0, "i8"), np.empty(0, "u8")
    total = run_hashes(h, k)
    least = first_least(total, min(window, count))
    at = least[np.concatenate([[True], least[1:] != least[:-1]])]
    values = total[at]
    if len(np.unique(values)) < len(values):
        last, keep = {}, np.ones(len(at), bool)
        for i, (p, v) in enumerate(zip(at.tolist(), values.tolist())):
            keep[i] = p - last.get(v, -window) >= window
            if keep[i]:
                last[v] = p
        at, values = at[keep], values[keep]
    return at, values


def seeds_of_all(texts: list[np.ndarray], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts, places and hashes of what `seeds_of` gives for each, from the texts laid end to end."""
    size = np.array([len(h) for h in texts])
    begin, whole = np.cumsum(size) - size, np.concatenate(texts)
    text = np.repeat(np.arange(len(texts)), size)
    total = run_hashes(whole, k)
    alone = (size >= k) & (size < k + window - 1)
    row, at, value = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u8")
    if len(total) >= window:
        least = first_least(total, window)
        inside = text[:len(least)] == text[window + k - 2:]
        least = least[inside]
        at = least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
        row, value = text[at], total[at]
        at = at - begin[row]
        by = np.lexsort((value, row))
        again = (row[by][1:] == row[by][:-1]) & (value[by][1:] == value[by][:-1])
        alone[row[by][1:][again]] = True
        rest = ~alone[row]
        row, at, value = row[rest], at[rest], value[rest]
    own = np.flatnonzero(alone)
    found = [seeds_of(texts[i], k, window) for i in own.tolist()]
    return (
        np.concatenate([row, np.repeat(own, [len(f[0]) for f in found])]) if found else row,
        np.concatenate([at, *[f[0] for f in found]]), np.concatenate([value, *[f[1] for f in found]]),
    )


def all_seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                row, at, value = seeds_of_all(list(word_hashes(part.column("__text"))), k, window)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view("i8")), part.column("__doc").take(row), part.column("__rid").take(row),
                     pa.array(at.astype("i4"))], names=["seed", "doc", "rid", "pos"],
                )

    kind = docs.schema["__doc"].dataType.simpleString()
    return docs.select("__doc", "__rid", "__text").mapInArrow(run, f"seed long, doc {kind}, rid long, pos int")


def repeated_in_order(batches: Iterator[pa.RecordBatch], keys: list[str], sort: bool) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by the first key, sorted by all, in batches of whole runs of the first key.

    Runs of one row are left out, but for the first and the last run. Without `sort`, rows are sorted by all keys before.
    """
    held: list[pa.RecordBatch] = []  # rows of the open run
    started = False

    def ready(rows: list[pa.RecordBatch], last: bool) -> pa.RecordBatch:
        nonlocal started
        out = pa.concat_batches(rows)
        seed = out.column(keys[0]).to_numpy()
        same = seed[1:] == seed[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | last
        if not started:
            keep |= seed == seed[0]
        started = True
        out = out.filter(pa.array(keep))
        if not sort:
            return out
        return out.take(pc.sort_indices(out, [(k, "ascending") for k in keys], null_placement="at_start"))

    for batch in batches:
        if not batch.num_rows:
            continue
        seed = batch.column(keys[0]).to_numpy()
        cut = int(np.searchsorted(seed, seed[-1]))
        if held and (cut or seed[0] != held[0].column(keys[0])[0].as_py()):
            yield ready([*held, batch.slice(0, cut)], False)
            held = []
        elif cut:
            yield ready([batch.slice(0, cut)], False)
        held.append(batch.slice(cut))
    if held:
        yield ready(held, True)


def anchors(seeds: DataFrame, lasts: bool = True) -> DataFrame:
    """Each place of a seed joined to the seed's first place: `rid`, `pos`, `src_rid`, `src_pos`; and to the place just
    before it, with `lasts`, `last_rid` and `last_pos` (NULL for the first row of a range, which has the one of another).

    Seeds are written, then sorted by ranges of hash, document and place, so the first place of a seed is the first row
    of its run, and a seed of any count is split over ranges. Within a range Spark sorts by the hash, one number, and
    rows of one hash are sorted here. The first rows of the runs at a range's ends are boundary records: a second, small
    step replaces the first place of such a part by the first of all. Only they keep the hash and the document.
    """
    keys = ["seed", "doc", "rid", "pos"]
    names = [*keys, "src_rid", "src_pos", "last_rid", "last_pos", "edge"]
    kind = seeds.schema["doc"].dataType.simpleString()
    here = kind in _ORDERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, row, started = None, None, False  # of the open run: seed, rid and pos of its first row
        last = None  # rid and pos of the row before
        for batch in repeated_in_order(batches, keys, here):
            if not batch.num_rows:
                continue
            seed, rid, pos = (batch.column(c).to_numpy() for c in ("seed", "rid", "pos"))
            opens = np.concatenate([[first is None or seed[0] != first[0]], seed[1:] != seed[:-1]])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(seed)), -1))
            src_rid = np.where(at < 0, first[1] if first else 0, rid[at])
            src_pos = np.where(at < 0, first[2] if first else 0, pos[at]).astype("i4")
            edge = np.zeros(len(seed), bool)
            edge[0], started = not started, True
            known = np.ones(len(seed), bool)
            known[0] = last is not None
            last_rid = np.concatenate([[last[0] if last else 0], rid[:-1]])
            last_pos = np.concatenate([[last[1] if last else 0], pos[:-1]]).astype("i4")
            last = int(rid[-1]), int(pos[-1])
            whole = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keys], pa.array(src_rid), pa.array(src_pos),
                 pa.array(last_rid, mask=~known), pa.array(last_pos, mask=~known), pa.array(edge)], names=names
            )
            if at[-1] >= 0:
                open_at = int(at[-1])
                first, row = (int(seed[open_at]), int(rid[open_at]), int(pos[open_at])), whole.slice(open_at, 1)
            out = whole.filter(pa.array(~opens | edge))
            for i, c in enumerate(keys[:2]):  # only boundary records need them
                column = out.column(c)
                out = out.set_column(i, c, pc.if_else(out.column("edge"), column, pa.scalar(None, column.type)))
            yield out
        if row is not None:
            yield row.set_column(len(names) - 1, "edge", pa.array([True]))

    schema = f"seed long, doc {kind}, rid long, pos int, src_rid long, src_pos int, last_rid long, last_pos int, edge boolean"
    seeds = written(seeds, "seeds")
    dealt = seeds.repartitionByRange(*keys).sortWithinPartitions(*(keys[:1] if here else keys))
    found = written(dealt.mapInArrow(run, schema).select(*[n for n in names if lasts or not n.startswith("last_")]), "anchors")
    dropped(seeds)
    # At most two rows per range.
    edges = found.filter("edge").select(*keys).distinct()
    heads = edges.groupBy("seed").agg(F.min(F.struct("doc", "rid", "pos")).alias("f"))
    moved = written(edges.join(heads, "seed").select(
        F.col("rid").alias("src_rid"), F.col("pos").alias("src_pos"), F.col("f.rid").alias("head_rid"),
        F.col("f.pos").alias("head_pos"),
    ).distinct(), "heads")
    linked = found.join(F.broadcast(moved), ["src_rid", "src_pos"], "left")
    return linked.select(
        "rid", "pos", F.coalesce("head_rid", "src_rid").alias("src_rid"), F.coalesce("head_pos", "src_pos").alias("src_pos"),
        *(["last_rid", "last_pos"] if lasts else []),
    ).filter("rid <> src_rid or pos <> src_pos")


class Fenwick:
    """Prefix maxima over ranks, with the item that holds each."""

    def __init__(self, n: int):
        self.best, self.item = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def raise_to(self, rank: int, value: float, item: int) -> None:
        i = rank + 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.item[i] = value, item
            i += i & -i

    def below(self, rank: int) -> tuple[float, int]:
        best, item, i = float("-inf"), -1, rank
        while i > 0:
            if self.best[i] > best:
                best, item = self.best[i], self.item[i]
            i -= i & -i
        return best, item


def chains_of(x: np.ndarray, y: np.ndarray, k: int, gap_cost: float, max_gap: int) -> list[np.ndarray]:
    """Chains of anchors that rise in both texts, as rows of the anchors, best chains first.

    A chain scores k per anchor less gap_cost for each word between anchors in either text. As this cost is linear,
    the best anchor before one is a prefix maximum over y. Chains are cut at gaps over `max_gap`.
    """
    order = np.lexsort((y, x))
    xs, ys = x[order].tolist(), y[order].tolist()
    score, before = [float(k)] * len(xs), [-1] * len(xs)
    if (np.diff(x[order]) > 0).all() and (np.diff(y[order]) > 0).all():
        for j in range(1, len(xs)):  # the best anchor before one is the last: its chain gains k by going there
            gained = score[j - 1] - gap_cost * (xs[j] - xs[j - 1] + ys[j] - ys[j - 1])
            if gained > 0:
                score[j], before[j] = k + gained, j - 1
    else:
        ranks = np.unique(y[order], return_inverse=True)[1].tolist()
        tree = Fenwick(len(set(ranks)))
        i = 0
        while i < len(xs):
            j = i
            while j < len(xs) and xs[j] == xs[i]:  # anchors of one place do not follow one another
                best, item = tree.below(ranks[j])
                gained = best - gap_cost * (xs[j] + ys[j])
                score[j] = k + max(gained, 0.0)
                before[j] = item if gained > 0 else -1
                j += 1
            for m in range(i, j):
                tree.raise_to(ranks[m], score[m] + gap_cost * (xs[m] + ys[m]), m)
            i = j
    used, whole = [False] * len(xs), []
    for end in sorted(range(len(xs)), key=lambda m: -score[m]):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = before[end]
        if chain:
            whole.append(order[chain[::-1]])
    out = []
    for chain in whole:
        wide = (np.diff(x[chain]) > max_gap) | (np.diff(y[chain]) > max_gap)
        out += np.split(chain, np.flatnonzero(wide) + 1)
    return out


def followed(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray, max_gap: int) -> list[np.ndarray]:
    """Chains put one behind another where a chain goes on in both texts at most `max_gap` words after one's end.

    Gap costs part what belongs together as well: a tail that costs more than it gains may still be alike enough.
    `stretches` judges all parts of the joined chains.
    """
    done: list[list[np.ndarray]] = []
    ends: list[list[np.ndarray]] = []  # those that a later chain can still follow
    for part in sorted(parts, key=lambda c: (x[c[0]], y[c[0]])):
        bx, by = x[part[0]], y[part[0]]
        ends = [e for e in ends if x[e[-1][-1]] + max_gap >= bx]
        near = [(by - y[e[-1][-1]] + bx - x[e[-1][-1]], n) for n, e in enumerate(ends)
                if x[e[-1][-1]] < bx and 0 < by - y[e[-1][-1]] <= max_gap]
        if near:
            ends[min(near)[1]].append(part)
        else:
            done.append([part])
            ends.append(done[-1])
    return [np.concatenate(c) for c in done]


def chains(found: DataFrame, k: int, gap_cost: float, max_gap: int) -> DataFrame:
    """Chains of each document and source, down to single anchors, without places of one document that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (rid, src), (x, y) in runs_of(batches, ["rid", "src_rid"], ["pos", "src_pos"]):
            once = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])  # boundary records may come twice
            x, y = x[once], y[once]
            x, y = x.astype("i8"), y.astype("i8")
            dx, dy = np.diff(x), np.diff(y)
            if (dx > 0).all() and (dy > 0).all():  # what gap costs part is put together again, but for wide gaps
                found = np.split(np.arange(len(x)), np.flatnonzero((dx > max_gap) | (dy > max_gap)) + 1)
            else:
                found = followed(chains_of(x, y, k, gap_cost, max_gap), x, y, max_gap)
            for chain in found:
                cx, cy = x[chain], y[chain]
                if rid != src or cy[-1] + k <= cx[0]:
                    out.append((int(rid), int(src), cx, cy))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        rid, src, x, y = zip(*rows)
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(src, pa.int64()), pa.array(x, ints), pa.array(y, ints)],
            names=["rid", "src_rid", "x", "y"],
        )

    dealt = found.select("rid", "src_rid", "pos", "src_pos").repartition("rid", "src_rid").sortWithinPartitions("rid", "src_rid", "pos", "src_pos")
    return dealt.mapInArrow(run, "rid long, src_rid long, x array<int>, y array<int>")


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest common subsequence of two short runs."""
    a, b = list(a), list(b)
    if a == b:
        return len(a)
    places: dict = {}
    for i, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << i
    # One bit per word of b; a bit that is off is a place where the subsequence's length rises.
    full = (1 << len(b)) - 1
    rises = full
    for word in a:
        met = rises & places.get(word, 0)
        rises = (rises + met | rises - met) & full
    return len(b) - rises.bit_count()


def aligned(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int, int, int]:
    """Align two texts' words along a chain: ends in both, and the number of matched words.

    Anchors are extended by equal words at the chain's ends; what lies between two anchors is matched word by word.
    """
    room = min(x[0], y[0])
    other = np.flatnonzero(a[x[0] - room:x[0]] != b[y[0] - room:y[0]])
    left = room - 1 - int(other[-1]) if len(other) else int(room)
    px, py, total = int(x[0]) - left, int(y[0]) - left, 0
    begin = px, py
    ex, ey = int(x[-1]) + k, int(y[-1]) + k
    if ex - px == ey - py and (x - y == px - py).all() and (a[px:ex] == b[py:ey]).all():
        room = min(len(a) - ex, len(b) - ey)
        other = np.flatnonzero(a[ex:ex + room] != b[ey:ey + room])
        right = int(other[0]) if len(other) else room
        return px, ex + right, py, ey + right, ex + right - px
    a, b = a.tolist(), b.tolist()
    for ax, ay in zip(x.tolist(), y.tolist()):
        if ax >= px and ay >= py:
            total += matched(a[px:ax], b[py:ay]) + k
        else:  # the anchor overlaps the one before it
            total += max(0, min(ax + k - px, ay + k - py))
        px, py = max(px, ax + k), max(py, ay + k)
    while px < len(a) and py < len(b) and a[px] == b[py]:
        px, py, total = px + 1, py + 1, total + 1
    return begin[0], px, begin[1], py, total


def stretches(
    x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, min_words: int, identity: float
) -> list[tuple[int, int, int, int, int]]:
    """Parts of a chain that are long and alike enough, aligned; together they cover every such part.

    Of all runs of anchors that fit, those within another are left out, and of the rest as many as cover all.
    """
    whole = aligned(x, y, a, b, k)
    if whole[1] - whole[0] < min_words:
        return []
    if whole[4] >= identity * max(whole[1] - whole[0], whole[3] - whole[2]):
        return [whole]
    count = len(x)
    step, left, right = [0] * count, [0] * count, [0] * count
    xs, ys, a, b, x, y = x, y, a.tolist(), b.tolist(), x.tolist(), y.tolist()
    for i in range(count):
        px, py = (x[i - 1] + k, y[i - 1] + k) if i else (0, 0)
        if i:
            ax, ay = x[i], y[i]
            step[i] = matched(a[px:ax], b[py:ay]) + k if ax >= px and ay >= py else max(0, min(ax + k - px, ay + k - py))
        straight = i > 0 and x[i] - y[i] == px - py
        room = x[i] - px if straight else min(x[i], y[i], BLOCK if i else x[i])
        while left[i] < room and a[x[i] - left[i] - 1] == b[y[i] - left[i] - 1]:
            left[i] += 1
        if straight and left[i] >= room:  # equal all the way to the anchor before
            left[i] = left[i - 1] + x[i] - x[i - 1]
    for i in range(count - 1, -1, -1):
        ex, ey = x[i] + k, y[i] + k
        straight = i + 1 < count and x[i + 1] - y[i + 1] == ex - ey
        room = x[i + 1] - ex if straight else min(len(a) - ex, len(b) - ey, BLOCK if i + 1 < count else len(a))
        while right[i] < room and a[ex + right[i]] == b[ey + right[i]]:
            right[i] += 1
        if straight and right[i] >= room:  # equal all the way to the anchor after
            right[i] = right[i + 1] + x[i + 1] - x[i]
    left, right, x, y = np.array(left, "i8"), np.array(right, "i8"), xs, ys
    total = np.cumsum(step)
    n0, x0, y0 = total - left, x - left, y - left
    n1, x1, y1 = total + k + right, x + k + right, y + k + right
    # n >= identity * length on both sides, as sums of one term of either end.
    ux, uy, vx, vy = n1 - identity * x1, n1 - identity * y1, n0 - identity * x0, n0 - identity * y0
    most_x, most_y = (np.maximum.accumulate(u[::-1])[::-1] for u in (ux, uy))
    fit, upto = [], -1
    for i in range(count):
        low = max(i, upto + 1)
        if low >= count:
            break
        if most_x[low] < vx[i] - 1e-9 or most_y[low] < vy[i] - 1e-9:
            continue
        ok = (ux[low:] >= vx[i] - 1e-9) & (uy[low:] >= vy[i] - 1e-9) & (x1[low:] - x0[i] >= min_words)
        if ok.any():
            upto = low + int(np.flatnonzero(ok)[-1])
            fit.append((i, upto))
    out, at = [], 0
    while at < len(fit):
        out.append(fit[at])
        after = at + 1  # the last that still meets what is covered, else the next
        while after + 1 < len(fit) and fit[after + 1][0] <= out[-1][1]:
            after += 1
        at = after
    return [(int(x0[i]), int(x1[j]), int(y0[i]), int(y1[j]), int(n1[j] - n0[i])) for i, j in out]


def wanted_blocks(chained: DataFrame, k: int) -> DataFrame:
    """The blocks of words, on both sides, that the alignment of each chain looks at: up to BLOCK words beyond it.

    Less would do if all seeds of a passage had one source, as an equal run goes on for less than a window beyond
    its outer anchors. But some may stand first in a third document that has only a part of the passage.
    """

    def blocks(rid: str, at: str, side: int):
        low = F.greatest(F.element_at(at, 1) - BLOCK, F.lit(0))
        high = F.element_at(at, -1) + k + BLOCK
        span = F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))
        return chained.select("chain", F.lit(side).alias("side"), F.col(rid).alias("rid"), F.explode(span).alias("block"))

    return blocks("rid", "x", 0).unionByName(blocks("src_rid", "y", 1))


def block_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rid`, `block` and `words` (four bytes each) of the wanted blocks, cut from their texts."""
    rids = written(wanted.select("rid", "block").distinct(), "wanted").groupBy("rid").agg(
        F.sort_array(F.collect_list("block")).alias("blocks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                out: list[tuple] = []
                for rid, h, blocks in zip(part.column("rid").to_pylist(), word_hashes(part.column("__text")),
                                          part.column("blocks").to_pylist()):
                    h = (h & np.uint64(0xFFFFFFFF)).astype("u4").view("i4")
                    out += [(rid, b, h[b * BLOCK:(b + 1) * BLOCK].tobytes()) for b in blocks if b * BLOCK < len(h)]
                if out:
                    rid, block, words = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid, pa.int64()), pa.array(block, pa.int64()), pa.array(words, pa.binary())],
                        names=["rid", "block", "words"],
                    )

    texts = docs.select(F.col("__rid").alias("rid"), "__text").join(rids.hint("merge"), "rid")
    return written(texts.mapInArrow(run, "rid long, block long, words binary"), "blocks")


def flat(column: pa.Array) -> tuple:
    """The values of a list or of a binary column (as 32-bit integers) laid end to end, and where each row's begin and end."""
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset:column.offset + len(column) + 1]
    if not pa.types.is_binary(column.type):
        return column.values, offsets
    data = column.buffers()[2]
    return np.frombuffer(data, "i4", len(data) // 4) if data is not None else np.empty(0, "i4"), offsets // 4


def passages(chained: DataFrame, words: DataFrame, wanted: DataFrame, k: int, min_words: int, identity: float) -> DataFrame:
    """Align every chain on its words and keep its parts that are long and alike enough."""
    gathered = wanted.join(words, ["rid", "block"]).groupBy("chain").agg(
        F.sort_array(F.collect_list(F.struct("side", "block", "words"))).alias("parts")
    )
    rows = chained.join(gathered, "chain")
    names = ["rid", "src_rid", "begin", "end", "src_begin", "src_end", "n_matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            (x, cuts), (y, _), (parts, upto) = (flat(batch.column(c)) for c in ("x", "y", "parts"))
            x, y = (v.to_numpy().astype("i8") for v in (x, y))
            side, block = (parts.field(c).to_numpy() for c in ("side", "block"))
            words, begins = flat(parts.field("words"))
            sides = np.concatenate([[0], np.cumsum(side)])
            rids, sources = (batch.column(c).to_pylist() for c in ("rid", "src_rid"))
            for i, (rid, src) in enumerate(zip(rids, sources)):
                lo, hi = upto[i], upto[i + 1]
                mid = hi - (sides[hi] - sides[lo])
                low = int(block[lo]) * BLOCK, int(block[mid]) * BLOCK
                a, b = words[begins[lo]:begins[mid]], words[begins[mid]:begins[hi]]
                cx, cy = x[cuts[i]:cuts[i + 1]] - low[0], y[cuts[i]:cuts[i + 1]] - low[1]
                for b0, e0, b1, e1, n in stretches(cx, cy, a, b, k, min_words, identity):
                    out.append((rid, src, b0 + low[0], e0 + low[0], b1 + low[1], e1 + low[1], n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in map(list, zip(*out))], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    return rows.select("rid", "src_rid", "x", "y", "parts").mapInArrow(run, schema).distinct()


def regions(found: DataFrame, window: int, k: int, min_words: int) -> DataFrame:
    """Per `rid` the stretches of its text, first and last word, where all seeds stand elsewhere as well.

    Seeds within a shared passage are repeated, at most `window` apart (twice that among equal hashes), and less than
    `window` from its ends. Only stretches that can hold `min_words` are left.
    """
    places = found.select("rid", "pos").unionByName(
        found.select(F.col("src_rid").alias("rid"), F.col("src_pos").alias("pos"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, at in zip(batch.column("rid").to_pylist(), batch.column("at")):
                at = at.values.to_numpy()
                cuts = np.flatnonzero(np.diff(at) > 2 * window) + 1
                low = np.maximum(at[np.concatenate([[0], cuts])] - 2 * window, 0)
                high = at[np.concatenate([cuts - 1, [len(at) - 1]])] + k + 2 * window
                wide = high - low >= min_words
                if wide.any():
                    out.append((rid, low[wide], high[wide]))
            if out:
                rid, low, high = zip(*out)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), pa.array(low, ints), pa.array(high, ints)], names=["rid", "low", "high"]
                )

    held = places.groupBy("rid").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return held.mapInArrow(run, "rid long, low array<int>, high array<int>")


def unexplained(found: DataFrame, wide: DataFrame, spans: DataFrame) -> DataFrame:
    """Anchors to the place just before, of seeds in regions but in no passage; that may be the first place."""
    later = found.withColumn("src", F.when(F.col("last_rid").isNull(), F.struct(F.col("src_rid"), F.col("src_pos")))
                             .otherwise(F.struct(F.col("last_rid").alias("src_rid"), F.col("last_pos").alias("src_pos"))))
    held = spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # a text's own passages
    placed = later.join(wide, "rid").join(held, "rid", "left")
    inside = F.exists(F.arrays_zip("low", "high"), lambda r: F.col("pos").between(r["low"], r["high"]))
    told = F.coalesce(F.exists("spans", lambda p: (p["begin"] <= F.col("pos")) & (F.col("pos") < p["end"])), F.lit(False))
    return placed.filter(inside & ~told).select(
        "rid", "pos", "src.src_rid", "src.src_pos"
    )


def run_seeds(docs: DataFrame, wide: DataFrame, min_words: int) -> DataFrame:
    """Places and hashes of all runs of `min_words` words within the regions, as `all_seeds` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                at, value = [], []
                for h, low, high in zip(word_hashes(part.column("__text")), part.column("low").to_pylist(),
                                        part.column("high").to_pylist()):
                    ends = [max(h_ - min_words + 1, l) for l, h_ in zip(low, np.minimum(high, len(h)))]
                    at.append(np.unique(np.concatenate([np.arange(l, e) for l, e in zip(low, ends)])))
                    value.append(run_hashes(h, min_words)[at[-1]])
                row = pa.array(np.repeat(np.arange(len(at)), [len(a) for a in at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(value).view("i8")), part.column("__doc").take(row),
                     part.column("__rid").take(row), pa.array(np.concatenate(at).astype("i4"))],
                    names=["seed", "doc", "rid", "pos"],
                )

    kind = docs.schema["__doc"].dataType.simpleString()
    near = docs.select("__doc", "__rid", "__text").join(wide.withColumnRenamed("rid", "__rid").hint("merge"), "__rid")
    return near.select("__doc", "__rid", "__text", "low", "high").mapInArrow(
        run, f"seed long, doc {kind}, rid long, pos int"
    )


def exact_passages(found: DataFrame, min_words: int) -> DataFrame:
    """Equal runs, as `passages` gives them, from runs of `min_words` words joined to their first place."""
    names = ["rid", "src_rid", "begin", "end", "src_begin", "src_end", "n_matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last document so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("rid", "src_rid", "shift", "pos")])
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if held and (cut or rows[0, 0] != held[0][0, 0]):
                yield batch_of(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif cut:
                yield batch_of(rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield batch_of(np.concatenate(held, axis=1))

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[:, np.lexsort(rows[::-1])]
        cut = (np.diff(rows[:3]) != 0).any(axis=0) | (np.diff(rows[3]) > 1)
        first = np.flatnonzero(np.concatenate([[True], cut]))
        last = np.concatenate([first[1:] - 1, [rows.shape[1] - 1]])
        rid, src, shift, low = rows[:, first]
        end = rows[3, last] + min_words
        columns = [rid, src, low, end, low - shift, end - shift, end - low]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    apart = F.col("shift") >= min_words
    shifted = found.select("rid", "src_rid", (F.col("pos").cast("long") - F.col("src_pos")).alias("shift"), F.col("pos").cast("long"))
    near = shifted.filter((F.col("rid") != F.col("src_rid")) | apart)
    dealt = near.repartition("rid", "src_rid").sortWithinPartitions("rid")  # by one number, which Spark does without comparing rows
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def uncovered(exact: DataFrame, spans: DataFrame) -> DataFrame:
    """The equal runs that no passage of the same document covers, without those within another one."""
    both = spans.withColumn("kind", F.lit(0)).unionByName(exact.withColumn("kind", F.lit(1)))
    before = Window.partitionBy("rid").orderBy("begin", F.desc("end"), "kind", "src_rid", "src_begin")
    upto = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("upto", upto).filter("kind = 1 and (upto is null or upto < end)").select(*spans.columns)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, identity: float = 0.8,
    k: int = 8, window: int = 12, gap_cost: float = 0.25, max_gap: int = 40,
) -> DataFrame:
    """Passages of `min_words` or more that a document has in common with an earlier place.

    Returns the id, `begin` and `end` (words, the end excluded), `source_id`, `source_begin` and `source_end`,
    `n_matched` and `identity` (matched words by the longer side). Words are compared with A to Z in lower case.

    Each text gives minimizers of `k` words as seeds; texts that share `k` + `window` - 1 words share one. A seed's
    places are joined to its first place, by id, so a passage in many documents costs a row each and no pairs; its
    first holder shows as the source. Where all seeds of a stretch are repeated and no passage is found, they are also
    joined to the place before theirs: parts of a passage may stand first in documents that each hold too little. Anchors of a document and a source are chained in order, with linear gap
    costs, and aligned on the words of both sides, beyond the chain's ends as long as words are equal, up to BLOCK
    words or more. A chain that is not alike enough as a whole gives its parts that are. A change in a source's text,
    or another source that holds only a part, can end one passage and start another.

    The first places of a passage's seeds may lie in several documents that each hold too small a part. So where all
    seeds are repeated, every run of `min_words` words is joined to its own first place too, and equal runs that no
    passage covers yet are added: each word of an equal run of `min_words` that stands earlier is in some passage. A
    passage with changes less than `min_words` from one another is missed where both the first and the last places of its
    seeds lie in several documents that each hold too little.

    NULL and empty texts have no passages; NULL ids come first and are given back as NULL; rows with one id and equal
    rows are different documents; places of one document are compared as well, unless they overlap; no rows give no
    rows; other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).withColumn(
        "__rid", F.monotonically_increasing_id()
    )
    slim = written(slim, "texts")
    found = anchors(all_seeds(slim, k, window))
    wide = written(regions(found, window, k, min_words), "regions")
    exact = exact_passages(anchors(run_seeds(slim, wide, min_words), lasts=False), min_words)

    def aligned_passages(joined: DataFrame, label: str) -> DataFrame:
        chained = written(
            chains(joined, k, gap_cost, max_gap).withColumn("chain", F.monotonically_increasing_id()), "chains"
        )
        wanted = wanted_blocks(chained, k)
        words = block_words(slim, wanted)
        out = written(passages(chained, words, wanted, k, min_words, identity), label)
        dropped(chained, words)
        return out

    spans = aligned_passages(found, "passages")
    more = aligned_passages(unexplained(found, wide, spans), "more")
    spans = spans.unionByName(more)
    spans = spans.unionByName(written(uncovered(exact, spans), "exact"))
    ids = slim.select(F.col("__rid").alias("rid"), F.col("__doc").alias(id_col))
    sources = slim.select(F.col("__rid").alias("src_rid"), F.col("__doc").alias("source_id"))
    longer = F.greatest(F.col("end") - F.col("begin"), F.col("src_end") - F.col("src_begin"))
    return spans.join(ids, "rid").join(sources, "src_rid").select(
        id_col, "begin", "end", "source_id", F.col("src_begin").alias("source_begin"),
        F.col("src_end").alias("source_end"), "n_matched", (F.col("n_matched") / longer).alias("identity"),
    )
