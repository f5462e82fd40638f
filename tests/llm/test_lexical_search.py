"""Ranked search against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vacanta.llm import lexical_search
from vacanta.llm.lexical_search import Best, Scanner, plain, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def reference(docs, items, top=50):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for d, c in counts:
            score = 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * sum(c.values()) * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, null, d) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if null else d, -score))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = [(1, "Alpha beta, GAMMA!"), (2, "über straße 42"), (3, "no-such"), (4, ""), (5, None), (1, "delta"), (None, "beta")]


@pytest.fixture(scope="module")
def docs():
    out = [(i, f"alpha {'beta ' * (i % 5)}x{i} gamma-delta") for i in range(120)]
    out += [(200, "ÜBER Straße straße 42 4 2"), (201, "über, 42."), (202, None), (203, ""), (204, "--- !"), (None, "beta gamma")]
    out += [(205, "alpha " * 30_000 + "delta"), (7, "alpha beta"), (7, "alpha beta"), (206, "alphabet betas a\x00beta\x7fgamma")]
    return out


def test_against_plain_python(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert found(search(table, items)) == reference(docs, ITEMS)
    assert found(search(table, items, top=3)) == reference(docs, ITEMS, 3)


def test_many_automata_give_the_same(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert found(search(table, items, pairs=2)) == reference(docs, ITEMS)


def test_cutting_while_reading_keeps_the_best(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "HELD", 4)
    best = Best(2, 3)
    import numpy as np

    scores = np.random.default_rng(1).integers(0, 6, (400, 2))
    for d, row in enumerate(scores):
        best.add(row, 400 - d)
    item, score, doc, _ = best.cut()
    for i in range(2):
        expected = sorted((-s, 400 - d) for d, s in enumerate(scores[:, i].tolist()) if s > 0)[:3]
        assert list(zip((-score[item == i]).tolist(), doc[item == i].tolist())) == expected


def test_whole_terms_only():
    scanner = Scanner([b"a", b"ab", "é".encode()])
    number, times = scanner.counts(plain("A ab,a abc é éa a".encode()))
    assert dict(zip(number.tolist(), times.tolist())) == {0: 3, 1: 1, 2: 1}


def test_empty_tables_and_other_columns(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert found(search(none, items)) == []
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(search(table, items.limit(0))) == []
    clashing = table.withColumns({c: F.lit("x") for c in ("score", "rank", "item", "term", "doc", "item_id")})
    assert found(search(clashing, items.withColumn("doc_id", F.lit(1)))) == reference(docs, ITEMS)
