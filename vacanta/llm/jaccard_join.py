"""Near duplicates by the Jaccard similarity of word shingles, found with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.common import dropped, runs_of, written
from vacanta.llm.components import components
from vacanta.llm.wordhash import mixed, word_hashes

WORDS = 5
# Sets link at 100 * intersection >= 80 * union, which is 9 * intersection >= 4 * (sum of sizes).
#: A bitmap has the least power of two of bits, from 512, that is this many times its set's size.
BITS_EACH = 8
SLOTS = 1 << 17
LEAF, FANOUT = 16, 8
#: Bitmaps travel to the first round, whose pairs are fewer than members, folded so many times; what they let pass
#: meets the whole bitmaps. Later rounds take whole ones, as folded ones would let squares of a group pass.
FOLDS = 2
_KEPT = 200_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                         0x85EBCA77C2B2AE63], "u8")


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; of all its words if there are fewer."""
    if not len(h):
        return h
    width = min(WORDS, len(h))
    count = len(h) - width + 1
    total = np.full(count, width, "u8")
    for k in range(width):
        total += h[k:k + count] * _MULTIPLIERS[k]
    return np.unique(mixed(total))


def slot_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SLOTS - 1)).astype("i8")


def commonness(docs: DataFrame, text_col: str) -> np.ndarray:
    """A rank of each of SLOTS slots by how many shingles of all documents fall in it: a sketch of fixed size.

    It only orders shingles, rare ones first, so that few documents meet at a common one. Any order finds all links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, "i8")
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                slots = [slot_of(shingles(h)) for h in word_hashes(batch.column(0).slice(begin, 500))]
                counts += np.bincount(np.concatenate(slots), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    counted = docs.select(text_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # at most SLOTS
    counts = np.zeros(SLOTS, "i8")
    counts[[r[0] for r in rows]] = [r[1] for r in rows]
    return np.unique(counts, return_inverse=True)[1].astype("u4")


def signatures(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Per row its set's size `n`, digest (`d1`, `d2`), bitmap, that bitmap folded (`coarse`), and the shingles of its
    `prefix`.

    Two sets that link share a shingle among the first n - ceil(0.8 n) + 1 of either in any common order. A task
    gives the prefix of a set it has met before only once.
    """
    names = ["__rid", "__doc", "__text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for batch in batches:
            out: dict[str, list] = {"n": [], "d1": [], "d2": [], "bitmap": [], "coarse": [], "prefix": []}
            for h in word_hashes(batch.column("__text")):
                s = shingles(h)
                name = digest(s)
                out["n"].append(len(s))
                out["d1"].append(name[0])
                out["d2"].append(name[1])
                if name in met or not len(s):
                    out["bitmap"].append(None)
                    out["coarse"].append(None)
                    out["prefix"].append(None)
                    continue
                if len(met) < _KEPT:
                    met.add(name)
                out["bitmap"].append(bitmap_of(s))
                out["coarse"].append(shorter(out["bitmap"][-1], len(out["bitmap"][-1]) >> FOLDS))
                first = len(s) - (4 * len(s) + 4) // 5 + 1
                out["prefix"].append(s[np.lexsort((s, rank[slot_of(s)]))[:first]].view("i8"))
            kinds = {"n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "bitmap": pa.binary(),
                     "coarse": pa.binary(), "prefix": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(out[c], k) for c, k in kinds.items()]],
                names=[*names, *kinds],
            )

    kind = docs.schema["__doc"].dataType.simpleString()
    schema = f"__rid long, __doc {kind}, __text_hash long, n long, d1 long, d2 long, bitmap binary, coarse binary, "
    schema += "prefix array<long>"
    return docs.select(*names, "__text").mapInArrow(run, schema)


def shared_postings(postings: DataFrame) -> DataFrame:
    """(token, rid) rows whose token occurs more than once.

    Ranges are of both columns, so a token of any count is split; the tokens at a range's ends stay. Within a range rows
    are sorted by one number, which Spark does without comparing rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start = None, True
        for batch in batches:
            t, r = (batch.column(c).to_numpy() for c in ("token", "rid"))
            if held is not None:
                t, r = np.concatenate([held[0], t]), np.concatenate([held[1], r])
            if not len(t):
                continue
            again = np.concatenate([[False], t[1:] == t[:-1]])
            keep = again | np.concatenate([t[1:] == t[:-1], [False]])
            if start:
                keep |= t == t[0]
            elif len(held[0]):
                keep[0] |= held[2]
            start = False
            yield pa.RecordBatch.from_arrays([pa.array(t[:-1][keep[:-1]]), pa.array(r[:-1][keep[:-1]])], names=["token", "rid"])
            held = t[-1:], r[-1:], bool(keep[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["token", "rid"])

    return postings.repartitionByRange("token", "rid").sortWithinPartitions("token").mapInArrow(
        run, "token long, rid long"
    )


def bitmap_of(s: np.ndarray) -> bytes:
    bits = np.zeros(max(512, 1 << (BITS_EACH * len(s) - 1).bit_length()), bool)
    bits[(s >> np.uint64(24)).astype("i8") & (len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def folded(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the length: a shingle's bit there is its bit here less the highest bit of its number."""
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] | bitmaps[:, half:]


def shorter(bitmap: bytes, size: int) -> bytes:
    """A bitmap folded to `size` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, "u1").reshape(-1, size), axis=0).tobytes()


class Tree:
    """Members ordered by size; nodes hold the OR of bitmaps, the range of sizes, and the most hidden shingles.

    A bitmap hides n - popcount shingles at most, so two sets share at most popcount(a AND b) + the lesser number
    of hidden ones; with ORs and greatest values the bound holds for all below two nodes.
    """

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, self.sizes, self.bitmaps = members[order], sizes[order], bitmaps[order]
        self.hidden = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1)
        begins = range(0, len(sizes), LEAF)
        self.nodes = [self._node(b, min(b + LEAF, len(sizes)), []) for b in begins]
        ids = list(range(len(self.nodes)))
        while len(ids) > 1:
            groups = [ids[i:i + FANOUT] for i in range(0, len(ids), FANOUT)]
            ids = []
            for g in groups:
                self.nodes.append(self._node(self.nodes[g[0]][0], self.nodes[g[-1]][1], g))
                ids.append(len(self.nodes) - 1)
        self.root = ids[0]

    def _node(self, begin: int, end: int, children: list[int]) -> tuple:
        own = self.bitmaps[begin:end] if not children else np.stack([self.nodes[c][3] for c in children])
        return (begin, end, children, np.bitwise_or.reduce(own, axis=0), int(self.sizes[begin]),
                int(self.sizes[end - 1]), int(self.hidden[begin:end].max()))


def may_link(x: tuple, y: tuple) -> bool:
    """Whether any pair below two nodes can reach the threshold."""
    low, high = (x, y) if x[5] <= y[5] else (y, x)
    if 5 * low[5] < 4 * high[4]:
        return False
    shared = int(np.bitwise_count(x[3] & y[3]).sum()) + min(x[6], y[6])
    return 9 * min(shared, low[5]) >= 4 * (x[4] + y[4])


def traverse(one: Tree, other: Tree, labels: np.ndarray, spanning: bool) -> list[tuple[int, int]]:
    """Pairs of members of two trees (or of one) with different labels that their bitmaps allow to link.

    With `spanning`, members that a pair joins share a label from then on, so there are fewer pairs than members.
    """
    pairs, stack = [], [(one.root, other.root)]
    while stack:
        i, j = stack.pop()
        x, y = one.nodes[i], other.nodes[j]
        rows, columns = one.members[x[0]:x[1]], other.members[y[0]:y[1]]
        mine, theirs = labels[rows], labels[columns]
        if (mine == mine[0]).all() and (theirs == mine[0]).all() or not may_link(x, y):
            continue
        if x[2] or y[2]:
            below = [(a, b) for a in x[2] or [i] for b in y[2] or [j] if one is not other or i != j or a <= b]
            stack.extend(reversed(below))
            continue
        shared = np.bitwise_count(one.bitmaps[x[0]:x[1], None] & other.bitmaps[None, y[0]:y[1]]).sum(axis=2)
        shared = shared + np.minimum(one.hidden[x[0]:x[1], None], other.hidden[None, y[0]:y[1]])
        a, b = one.sizes[x[0]:x[1], None], other.sizes[None, y[0]:y[1]]
        fits = (9 * np.minimum(shared, np.minimum(a, b)) >= 4 * (a + b)) & (mine[:, None] != theirs[None])
        for p, q in np.argwhere(fits).tolist():
            p, q = int(rows[p]), int(columns[q])
            if (p < q or one is not other or i != j) and labels[p] != labels[q]:
                pairs.append((p, q))
                if spanning:
                    labels[labels == labels[q]] = labels[p]
    return pairs


def candidate_pairs(sizes: np.ndarray, bitmaps: list[bytes], labels: np.ndarray, spanning: bool) -> list[tuple[int, int]]:
    """All pairs that `traverse` finds among members with bitmaps of different lengths.

    Sets that link differ in size by a quarter at most, so their bitmaps are of one length or of successive ones;
    the longer are folded to meet the shorter.
    """
    labels, by_length = labels.copy(), {}
    lengths = np.array([len(b) for b in bitmaps])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        by_length[length] = at, np.frombuffer(b"".join([bitmaps[i] for i in at]), "u8").reshape(len(at), length // 8)
    pairs = []
    for length, (at, maps) in by_length.items():
        tree = Tree(at, sizes[at], maps)
        pairs += traverse(tree, tree, labels, spanning)
        if 2 * length in by_length:
            more, longer = by_length[2 * length]
            pairs += traverse(tree, Tree(more, sizes[more], folded(longer)), labels, spanning)
    return pairs


def star_pairs(sizes: np.ndarray, bitmaps: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the member of the greatest weight with all others that may link to it."""
    centre = int(np.lexsort((-np.arange(len(weight)), weight))[-1])
    marked = np.where(np.arange(len(sizes)) == centre, 0, 1)
    near = np.flatnonzero((5 * sizes >= 4 * sizes[centre]) & (4 * sizes <= 5 * sizes[centre]))
    found = candidate_pairs(sizes[near], [bitmaps[i] for i in near], marked[near], False)
    return [(int(near[p]), int(near[q])) for p, q in found]


def block_pairs(blocks: DataFrame, how: str) -> DataFrame:
    """Distinct candidate pairs `a` < `b` of all blocks, rows of `block`, `cid`, `n`, `bitmap`, `label`, `weight`.

    `how` is `star`, `spanning` or `all`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, out = set(), []
        for _, (cid, n, bits, label, weight) in runs_of(batches, ["block"], ["cid", "n", "bitmap", "label", "weight"]):
            if len(cid) < 2:
                continue
            bits = bits.tolist()
            found = star_pairs(n, bits, label, weight) if how == "star" else candidate_pairs(n, bits, label, how == "spanning")
            for i, j in found:
                pair = min(cid[i], cid[j]), max(cid[i], cid[j])
                if pair not in met:
                    if len(met) < _KEPT:
                        met.add(pair)
                    out.append(pair)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    columns = ["block", "cid", "n", "bitmap", "label", "weight"]
    dealt = blocks.select(*columns).repartition("block").sortWithinPartitions("block", "cid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def fitting(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """The pairs that their whole bitmaps allow to link as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (n, m, x, y) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("n", "m", "x", "y")])):
                size = min(len(x), len(y))
                x, y = (np.frombuffer(shorter(b, size), "u8") for b in (x, y))
                hidden = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum()))
                keep[i] = 9 * min(int(np.bitwise_count(x & y).sum()) + hidden, n, m) >= 4 * (n + m)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    ends = written(ends_of(pairs), "ends")
    maps = written(meta.join(ends, "cid", "left_semi").select("cid", "n", "bitmap"), "maps")
    one = maps.select(F.col("cid").alias("a"), "n", F.col("bitmap").alias("x"))
    other = maps.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "n", "m", "x", "y")
    out = written(both.mapInArrow(run, "a long, b long"), "pairs")
    dropped(ends, maps)
    return out


def in_blocks(rows: DataFrame, meta: DataFrame, most: int, across: bool) -> DataFrame:
    """Blocks from (token, cid, members) rows. Tokens with more than `most` members are cut in parts.

    A part is a block; with `across`, every two parts are one, so that all pairs of the token meet somewhere;
    without, the least member of each part meets those of the others.
    """
    parts = F.ceil(F.col("members") / F.lit(most))
    part = F.pmod(F.xxhash64("cid"), parts)
    cut = rows.withColumns({"parts": parts, "part": part})
    if across:
        met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        keyed = met.withColumn("block", F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")))
    else:
        keyed = cut.withColumn("block", F.xxhash64("token", "part"))
        heads = cut.filter("parts > 1").groupBy("token", "part").agg(F.min("cid").alias("cid")).withColumn(
            "block", F.xxhash64("token", F.lit(-1))
        )
        keyed = keyed.select("block", "cid").unionByName(heads.select("block", "cid"))
    return keyed.select("block", "cid").join(meta, "cid")


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set."""
    other = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))
    return int(tokens.sum(dtype="u8").view("i8")), int(other.sum(dtype="u8").view("i8"))


def sets_of(docs: DataFrame, wanted: DataFrame, members: DataFrame, many: bool) -> DataFrame:
    """`cid` and `tokens` of the wanted classes, made again from the texts of their first documents.

    With `many`, as many as grow with the documents, they are not broadcast, whatever their files' size.
    """
    named = written(
        members.join(wanted.withColumnRenamed("cid", "__rid"), "__rid", "left_semi")
        .select("cid", "__doc", "__text_hash", "d1", "d2"), "wanted",
    )
    # By the text's hash too, so that rows without an id, or of one id, meet only their own text.
    same = F.col("t.__doc").eqNullSafe(F.col("i.__doc")) & F.col("t.__text_hash").eqNullSafe(F.col("i.__text_hash"))
    texts = docs.select("__doc", "__text_hash", "__text").alias("t").join((named.hint("merge") if many else named).alias("i"), same).select(
        "cid", "d1", "d2", "__text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                names = zip(*[part.column(c).to_pylist() for c in ("cid", "d1", "d2")])
                # Rows with one id may differ, so the digest decides.
                found = [(cid, s.view("i8")) for (cid, *name), s in zip(names, map(shingles, word_hashes(part.column("__text"))))
                         if tuple(name) == digest(s)]
                if found:
                    cids, sets = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "tokens"]
                    )

    once = texts.withColumn("__h", F.xxhash64("__text")).dropDuplicates(["cid", "__h"]).select("cid", "d1", "d2", "__text")
    out = written(once.mapInArrow(run, "cid long, tokens array<long>"), "sets")
    dropped(named)
    return out


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("left"))
    other = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("right"))
    both = pairs.join(one, "a").join(other, "b")
    enough = 9 * F.size(F.array_intersect("left", "right")) >= 4 * (F.size("left") + F.size("right"))
    return written(both.filter(enough).select("a", "b"), "links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 8192,
) -> DataFrame:
    """Per document `n_shingles`, `component_id` and `is_first`; also `text_hash`, which tells rows of one id apart.

    Documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; components are
    the documents reachable by links, named by their smallest id, and one of each, with that id, is the first. A
    text with fewer words is one shingle; a NULL text or one without words links with nothing.

    Equal sets are one class. Classes that can link meet at a rare shingle of their prefixes. Where they meet, a
    signature tree prunes pairs by sizes and bitmaps; what is left is checked on the whole sets. The first round
    joins members of a place to the one whose shingles most others share, the second keeps a spanning forest, so
    a group of copies of any size costs a pair or two per member; the third takes all remaining pairs between
    different components, so no link is lost. Places with more than `most` members are cut in parts.

    Ids may be NULL or repeated; equal rows are one class; no rows give no rows; other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).withColumns({
        "__rid": F.monotonically_increasing_id(), "__text_hash": F.xxhash64("__text"),
    })
    found = written(signatures(slim, commonness(slim, "__text")), "signatures")
    worded = found.filter("n > 0")
    classes = written(worded.groupBy("d1", "d2").agg(F.min("__rid").alias("cid")), "classes")
    members = written(
        worded.select("__rid", "__doc", "__text_hash", "n", "d1", "d2").join(classes, ["d1", "d2"]), "members"
    )
    dropped(classes)
    postings = found.select(F.explode("prefix").alias("token"), F.col("__rid").alias("rid"))
    shared = written(shared_postings(postings), "postings")
    by_class = written(
        shared.join(members.select(F.col("__rid").alias("rid"), "cid", "n"), "rid").select("token", "cid", "n").distinct(), "meet"
    )
    dropped(shared)
    # Shingles where the same classes meet are one place. Where two meet whose sizes are too far apart, there is no link.
    places = by_class.groupBy("token").agg(
        F.min("n").alias("low"), F.max("n").alias("high"),
        F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64("cid", F.lit(7)).cast("decimal(38,0)")).alias("s2"),
    ).filter("members > 2 or (members = 2 and 5 * low >= 4 * high)").groupBy("members", "s1", "s2").agg(F.min("token").alias("token"))
    places = written(places.select("token", "members"), "places")
    rows = written(by_class.drop("n").join(places, "token"), "rows")
    dropped(by_class, places)
    label = F.coalesce("root", "cid")
    # A text that others were made from shares more of its shingles than they do among themselves.
    weights = rows.groupBy("cid").agg(F.sum("members").alias("weight"))
    meta = written(
        found.filter("bitmap is not null").select(F.col("__rid").alias("cid"), "n", "bitmap", "coarse").join(weights, "cid"), "meta"
    )
    wordless = written(found.filter("n = 0").select("__doc", "n", "__text_hash"), "wordless")
    dropped(found)
    sets, tested, links, open_rows, used = None, None, None, rows, []
    narrow = meta.select("cid", "n", F.col("coarse").alias("bitmap"), "weight")
    labelled = narrow.withColumn("label", F.col("cid"))
    for how in ("star", "spanning", "all"):
        pairs = block_pairs(in_blocks(open_rows, labelled, most, how == "all"), how)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        met = written(pairs, "met")
        pairs = fitting(met, meta) if how == "star" else met
        missing = ends_of(pairs) if sets is None else ends_of(pairs).join(sets, "cid", "left_anti")
        missing = written(missing, "missing")
        if sets is None or not missing.isEmpty():
            more = sets_of(slim, missing, members, sets is None)
            used.append(more)
            sets = more if sets is None else sets.unionByName(more)
        dropped(missing)
        found_links = linked(pairs, sets)
        if pairs is not met:
            dropped(pairs)
        used.append(met)
        tested = met if tested is None else tested.unionByName(met)
        links = found_links if links is None else links.unionByName(found_links)
        if how == "all":
            break
        roots = components(links)
        # A place of two members is done after one round, linked or not.
        more_pairs = open_rows.filter(F.col("members") > (2 if most > 1 else 1))
        known = more_pairs.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", label).drop("root")
        known = written(known, "labelled")
        last_open, last_labels = open_rows, labelled
        divided = known.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
        open_known = written(known.join(divided.select("token"), "token", "left_semi"), "open")
        open_rows = open_known.drop("label")
        labelled = written(meta.drop("coarse").join(open_known.select("cid", "label").distinct(), "cid"), "labels")
        dropped(known, *[t for t in (last_open, last_labels) if t in used])
        used += [open_known, labelled]
    dropped(*used, rows, meta)
    roots = written(components(links), "roots")
    rooted = written(
        members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", label), "rooted"
    )
    smallest = written(rooted.groupBy("root").agg(
        F.min("__doc").alias("component_id"), F.min(F.struct(F.col("__doc").isNull(), "__doc", "__rid"))["__rid"].alias("first")
    ), "smallest")
    grouped = rooted.join(smallest, "root").select(
        F.col("__doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        (F.col("__rid") == F.col("first")).alias("is_first"), F.col("__text_hash").alias("text_hash"),
    )
    alone = wordless.select(
        F.col("__doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("__doc").alias("component_id"),
        F.lit(True).alias("is_first"), F.col("__text_hash").alias("text_hash"),
    )
    return grouped.unionByName(alone)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the near duplicates of one of each group; rows alike in id and text count once."""
    keys = near_duplicates(docs, id_col, text_col).filter("is_first").select(
        F.col(id_col).alias("__doc"), F.col("text_hash").alias("__text_hash")
    ).distinct()
    marked = docs.withColumn("__h", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__text_hash"))
    kept = marked.join(keys, same, "left_semi")
    return kept.dropDuplicates([id_col, "__h"]).drop("__h")
