"""Near duplicates and components against all pairs in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.llm import jaccard_join as jj
from vacanta.llm.components import components
from vacanta.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def closed(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def reference(docs):
    """docs: (id, text), ids unique: id -> (n_shingles, component)."""
    sets = {d: grams(t) for d, t in docs}
    by_gram, edges, seen = defaultdict(list), set(), set()
    for d, s in sets.items():
        for g in s:
            by_gram[g].append(d)
    for found in by_gram.values():
        for i, a in enumerate(found):
            for b in found[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        edges.add((a, b))
    root = closed(sets, edges)
    return {d: (len(sets[d]), root[d]) for d in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op9_jaccard_join"](spark, path)) == reference(docs)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [4, 8192])
def test_drifting_families(spark, most):
    rng = random.Random(3)
    texts, passage = [], [f"s{i}" for i in range(40)]
    for f in range(12):
        base = [f"w{f}_{i}" for i in range(rng.choice([12, 60, 150]))] + passage * (f % 2)
        texts += family(rng, base, 25, max(1, len(base) // 25))
    texts += [" ".join(passage[:20] + [f"u{i}_{k}" for k in range(30)]) for i in range(30)]
    rng.shuffle(texts)
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = reference(docs)
    assert found(jj.near_duplicates(df, most=most)) == want
    assert len({c for _, c in want.values()}) not in (1, len(docs))


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(40)]  # 36 shingles
    docs = [(1, " ".join(base)), (2, " ".join(base[:-4])), (3, " ".join(base + ["x"] * 9)), (4, " ".join(base + ["x"] * 10)),
            (5, " ".join(base[:32] + ["q"]))]
    got = found(jj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == reference(docs)


def test_odd_rows(spark):
    docs = [(None, "a b c"), (2, "A  b\tC"), (3, None), (4, ""), (5, " \n"), (6, "É b c d e f"), (7, "é b c d e f"),
            (8, "x " * 30000), (9, "x x x x x"), (9, "other text"), (9, "other text"), (10, "a b c d"), (11, "Other TEXT")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, COMPONENT_ID int").repartition(3)
    rows = jj.near_duplicates(df).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got == sorted([(None, 1, 2), (2, 1, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 2, 6), (7, 2, 7), (8, 1, 8),
                          (9, 1, 8), (9, 1, 9), (9, 1, 9), (10, 1, 10), (11, 1, 9)], key=str)
    kept = jj.keep_first(df)
    assert kept.columns == ["doc_id", "text", "COMPONENT_ID"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 3, 4, 5, 6, 7, 8, 9, 10], key=str)
    assert jj.near_duplicates(df.limit(0)).count() == 0


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(5, 300)).astype("u8")
        for _ in range(5):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 62, len(base)).astype("u8"), base)))
    sizes, maps = np.array([len(s) for s in sets]), [jj.bitmap_of(s) for s in sets]
    links = {(i, j) for i in range(len(sets)) for j in range(i)
             if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (sizes[i] + sizes[j])}
    labels = np.arange(len(sets))
    pairs = {(max(p), min(p)) for p in jj.candidate_pairs(sizes, maps, labels, False)}
    assert links <= pairs and len(pairs) < 2 * len(links) + 50
    spanning = jj.candidate_pairs(sizes, maps, labels, True)
    assert len(spanning) < len(sets) and closed(range(len(sets)), spanning) == closed(range(len(sets)), pairs)


def test_star_takes_all_that_may_link_to_the_centre():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 130).astype("u8")
    sets = [base] + [np.unique(np.where(rng.random(130) < e, rng.integers(0, 1 << 62, 130).astype("u8"), base)) for e in (0.02, 0.05, 0.6)]
    sets.append(np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 400).astype("u8")])))
    pairs = jj.star_pairs(np.array([len(s) for s in sets]), [jj.bitmap_of(s) for s in sets], np.arange(5), np.array([9, 1, 1, 9, 1]))
    assert {tuple(sorted(p)) for p in pairs} == {(0, 1), (0, 2)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = closed({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_postings(spark):
    rows = [(t % 50 if t % 3 else 1000 + t, t) for t in range(3000)]
    df = spark.createDataFrame(rows, "token long, rid long")
    got = {tuple(r) for r in jj.shared_postings(df).collect()}
    want = {r for r in rows if r[0] < 50}
    assert want <= got and len(got - want) <= 20


def test_word_hashes(monkeypatch):
    import pyarrow as pa

    from vacanta.llm import wordhash

    texts = ["a b", None, "", "ab", "b", " x\ty\n", "Ab É é" * 9, "q" * 3000 + " " + "q" * 256, "a\x0b\x0cb\rC", "z"]
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(wordhash, "CHUNK", chunk)
        for array in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
            got = [h.tolist() for h in wordhash.word_hashes(array)]
            assert len(got) == len(texts)
            names = {}
            for text, hashes in zip(texts, got):
                words = WORD.findall((text or "").translate(LOWER))
                assert len(words) == len(hashes)
                for w, h in zip(words, hashes):
                    assert names.setdefault(w, h) == h
            assert len(set(names.values())) == len(names)
    assert list(wordhash.word_hashes(pa.array([], pa.string()))) == []


def test_reference_sql():
    import duckdb

    from vacanta.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    docs = con.execute("select doc_id, text from documents").fetchall()
    got = con.execute(ORACLES["op9_jaccard_join"]).fetchall()
    assert {d: (n, c) for d, n, c in got} == reference(docs)


def test_places_are_narrow_and_of_more_than_two_after_the_first_round(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[40 * i:40 * i + 200] + [f"x{i}"])) for i in range(1, 6)]  # shared shingles, no links
    docs += [(20 + i, " ".join(f"y{i // 2}a{k}" for k in range(60 + 40 * (i % 2)))) for i in range(4)]  # places of two
    docs += [(40 + i, " ".join(f"z{k}" for k in range(120)) + f" q{i}") for i in range(3)]
    seen, pairs_of = [], jj.block_pairs

    def looked_at(blocks, how):
        rows = blocks.collect()
        least = min((sum(r.block == b.block for r in rows) for b in rows), default=3)
        seen.append((how, least, {(r.n, len(r.bitmap)) for r in rows}))
        return pairs_of(blocks, how)

    monkeypatch.setattr(jj, "block_pairs", looked_at)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(jj.near_duplicates(df)) == reference(docs)
    assert [how for how, _, _ in seen] == ["star", "spanning", "all"]
    assert all(least > 2 for _, least, _ in seen[1:])
    assert seen[0][2] and all(size < n for n, size in seen[0][2])  # less than a byte a shingle


def test_folded_bitmaps_prune_nothing_that_links(spark):
    r = random.Random(2)
    whole = [np.array([r.getrandbits(63) for _ in range(n)], "u8") for n in (40, 63, 64, 65, 300)]
    sets = [s[:max(1, len(s) - k)] for s in whole for k in range(0, len(s) // 5)]
    rows = [(i, len(s), jj.bitmap_of(s)) for i, s in enumerate(sets)]
    short = [jj.shorter(b, len(b) >> jj.FOLDS) for _, _, b in rows]
    true = {(i, j) for i in range(len(sets)) for j in range(i) for x, y in [(set(sets[i]), set(sets[j]))]
            if 9 * len(x & y) >= 4 * (len(x) + len(y))}
    met = jj.candidate_pairs(np.array([len(s) for s in sets]), short, np.arange(len(sets)), False)
    met = {(max(p), min(p)) for p in met}
    assert true <= met
    meta = spark.createDataFrame(rows, "cid long, n long, bitmap binary")
    every = spark.createDataFrame([(j, i) for i in range(len(sets)) for j in range(i)], "a long, b long")
    fit = {(r.b, r.a) for r in jj.fitting(every, meta).collect()}
    assert true <= fit < {(i, j) for i in range(len(sets)) for j in range(i)}
