"""Ranked lexical search: documents scanned by an automaton of all item terms, scored and cut to the best per item."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.common import per_worker, written

#: Pairs of item and term in one automaton. More items are dealt to several, each with a scan of its own.
PAIRS = 2_000_000
#: Found pairs of item and document that a task holds before it cuts them to the best.
HELD = 200_000
#: Parts that the best of an item are cut in before they meet.
PARTS = 16


def _table() -> bytes:
    """ASCII letters and digits are part of terms, A to Z lower-cased; other ASCII separates; all else is kept."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


TABLE = _table()


def plain(text: bytes | None) -> bytes:
    """The text with a blank for each separator, and one at both ends."""
    return b" " + (text or b"").translate(TABLE) + b" "


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """`item` and `term`, each pair once; the rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                terms = sorted(set(plain(text.as_py()).split()))
                if terms:
                    item = batch.column("item").take(pa.array([at] * len(terms)))
                    yield pa.RecordBatch.from_arrays([item, pa.array(terms, pa.binary())], names=["item", "term"])

    slim = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema["item"].dataType.simpleString()
    return slim.mapInArrow(run, f"item {kind}, term binary").distinct()


class Scanner:
    """Counts of all terms in a text. A term's pattern has a blank at both ends, so only whole terms match; the blank
    between two neighbours belongs to both, as matches may overlap."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.any = bool(terms)
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode(errors='surrogateescape')} ", i)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """`text` is what `plain` returns: numbers of the terms in it, and how often each occurs."""
        found = list(map(itemgetter(1), self.automaton.iter(text.decode(errors="surrogateescape")))) if self.any else []
        return np.unique(np.array(found, "i8"), return_counts=True)


def scanner_of(label: str, terms: list[bytes]) -> Scanner:
    """The worker's automaton of these terms; only the last one is kept."""
    kept = per_worker("lexical_scanner", dict)
    if label not in kept:
        kept.clear()
        kept[label] = Scanner(terms)
    return kept[label]


class Best:
    """The best `top` documents of each item among those a task has seen: highest score, then lowest id, NULL last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, "i8")
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, score: np.ndarray, doc_id: int | None) -> None:
        item = np.flatnonzero(score >= self.floor)
        if len(item):
            n = len(item)
            self.held.append((item, score[item], np.full(n, doc_id or 0), np.full(n, doc_id is None)))
            self.size += n
            if self.size > HELD + self.top * len(self.floor):
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, t) for t in ("i8", "i8", "i8", "?"))
        item, score, doc, null = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.r_[0, np.flatnonzero(item[1:] != item[:-1]) + 1]
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        last = rank == self.top - 1
        self.floor[item[last]] = score[last]
        kept = tuple(c[rank < self.top] for c in (item, score, doc, null))
        self.held, self.size = [kept], len(kept[0])
        return kept


def _counted(docs: DataFrame, label: str, terms) -> DataFrame:
    """First scan: per task, documents with each term, at -1 documents with any term and at -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(label, terms.value)
        df, n_docs, n_terms = np.zeros(len(terms.value), "i8"), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                text = plain(text.as_py())
                if n := len(text.split()):
                    n_docs, n_terms = n_docs + 1, n_terms + n
                    df[scanner.counts(text)[0]] += 1
        term = np.r_[-1, -2, np.flatnonzero(df)]
        count = np.r_[n_docs, n_terms, df[df > 0]]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], names=["term", "docs"])

    return docs.select("text").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", pairs: int = PAIRS,
) -> DataFrame:
    """The `top` best documents of each item: the item's id, `rank` from 1, the document's id and `score`.

    Terms are runs of ASCII letters, ASCII digits and characters beyond ASCII, with A to Z lower-cased. A term's weight
    is floor(1000 ln((2N + 2) / (2 df + 1))), a document's length term m is 50 + 50 n N div L, and the score sums
    weight * (10^9 tf div (1000 tf + 20 m)) over the item's terms. N, L, n, df and tf count the whole texts.

    The item terms of up to `pairs` pairs of item and term are broadcast as one automaton; what exceeds that is dealt
    by the item's hash to further automata, each scanning all documents again, so neither driver nor worker holds
    more. A first scan counts the documents of each term, a second one scores each document as it is read; no index
    of documents is made. Each task keeps the best of each item, which meet in parts before they meet as a whole.

    Equal scores are ordered by ascending id (integers), NULL last. Rows with one id are documents of their own. Rows
    of items with one id are one item; NULL is an id like others. NULL and empty texts have no terms: such documents
    are no result and such items have none. Empty tables give no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    terms_of = written(item_terms(items, item_col, item_text_col), "item_terms")
    parts = max(1, -(-terms_of.count() // pairs))
    found = None
    for part in range(parts):
        # At most about `pairs` rows, as counted.
        rows = terms_of.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        names = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i))
        best = _best(spark, slim, rows, names, top, uuid.uuid4().hex)
        kind = terms_of.schema["item"].dataType.simpleString()
        ids = spark.createDataFrame(list(enumerate(names)), f"item long, id {kind}")
        best = best.join(F.broadcast(ids), "item").drop("item")
        found = best if found is None else found.unionByName(best)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    apart = Window.partitionBy("id", F.pmod(F.xxhash64("doc"), F.lit(PARTS))).orderBy(*order)
    whole = Window.partitionBy("id").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(apart)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
    return found.select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _best(spark, docs: DataFrame, rows: list, names: list, top: int, label: str) -> DataFrame:
    """Per task and item, the best documents for the items of one automaton: `item` (its number), `doc`, `score`."""
    number = {name: i for i, name in enumerate(names)}
    terms = sorted({bytes(r["term"]) for r in rows})
    at = {t: i for i, t in enumerate(terms)}
    # The items of each term, end to end.
    pairs = np.array([(at[bytes(r["term"])], number[r["item"]]) for r in rows], "i8").reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    many = np.bincount(pairs[:, 0], minlength=len(terms))
    shared = spark.sparkContext.broadcast(terms)
    counts = {r["term"]: r["docs"] for r in _counted(docs, label, shared).collect()}  # a row per term of the automaton
    n_docs, n_terms = counts.get(-1, 0), max(counts.get(-2, 0), 1)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], "i8")
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], "i8")
    model = spark.sparkContext.broadcast((weight, many, np.cumsum(many) - many, pairs[:, 1].copy()))
    n_items = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(label, shared.value)
        weight, many, begin, items = model.value
        best = Best(n_items, top)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                text = plain(text.as_py())
                term, tf = scanner.counts(text)
                if not len(term):
                    continue
                m = 50 + (50 * len(text.split()) * n_docs) // n_terms
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                n = many[term]
                places = np.repeat(begin[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                # Whole numbers below 2^53, so sums of doubles are exact.
                score = np.bincount(items[places], np.repeat(part, n), minlength=n_items)
                best.add(score.astype("i8"), doc_id)
        item, score, doc, null = best.cut()
        columns = [pa.array(item), pa.array(doc, mask=null), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc", "score"])

    return docs.mapInArrow(run, "item long, doc long, score long")
