"""Repeated passages: planted ones are found, parts agree with slow versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.llm import substring_dedup as sd
from vacanta.llm.queries import QUERIES


def own(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def spans(df):
    return [r.asDict() for r in df.collect()]


def covered(found, doc, begin, end):
    """Share of a document's span that its passages, or those that name it as source, cover."""
    words = set()
    for r in found:
        if r["doc_id"] == doc:
            words.update(range(r["begin"], r["end"]))
        if r["source_id"] == doc:
            words.update(range(r["source_begin"], r["source_end"]))
    return len(words & set(range(begin, end))) / (end - begin)


def test_planted_passages(spark):
    rng = random.Random(8)
    docs, where = [], defaultdict(list)
    plans = [own(rng, n) for n in (51, 60, 80, 120, 300)]
    for d in range(300):
        text = own(rng, rng.randint(20, 200))
        if d % 3 == 0:
            p = (d // 3) % len(plans)
            at = rng.randint(0, len(text))
            where[p].append((d, at))
            text[at:at] = [w.upper() if d % 2 else w for w in plans[p]]
        elif d % 7 == 0:
            text += plans[2][:30]  # too short
        docs.append((d, " ".join(text)))
    found = spans(sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)))
    for p, holders in where.items():
        for d, at in holders:
            assert covered(found, d, at, at + len(plans[p])) == 1, (p, d)
    holders = {d for held in where.values() for d, _ in held}
    assert {r["doc_id"] for r in found} | {r["source_id"] for r in found} == holders
    # Seeds at a passage's ends may have another first holder.
    assert sum(len(h) - 1 for h in where.values()) <= len(found) <= 2 * len(docs) // 3
    assert all(r["identity"] == 1 and r["end"] - r["begin"] >= 51 for r in found)


def test_fuzzy_passages(spark):
    rng = random.Random(9)
    passage, docs = own(rng, 150), []
    for d in range(20):
        p = list(passage)
        for _ in range(6 if d else 0):
            at = rng.randrange(10, len(p) - 10)
            p[at:at + 1] = rng.choice([[], [f"x{rng.random()}"], [p[at], "more"]])
        docs.append((d, " ".join(own(rng, 50) + p + own(rng, 50))))
    found = spans(sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    shares = sorted(covered(found, d, 60, 190) for d in range(1, 20))
    assert shares[0] > 0.5 and shares[2] > 0.85, shares
    assert all(0.8 <= r["identity"] <= 1 for r in found)


@pytest.mark.parametrize("seed", range(4))
def test_best_chain_is_found(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        n = int(rng.integers(1, 14))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)
        _, once = np.unique(np.stack([x, y], 1), axis=0, return_index=True)
        x, y = x[once], y[once]
        k, cost = 8, 0.25
        order = np.lexsort((y, x))
        best = np.zeros(len(x))
        for i in order:
            best[i] = k + max([0, *[best[j] - cost * (x[i] - x[j] + y[i] - y[j]) for j in order if x[j] < x[i] and y[j] < y[i]]])
        got = sd.chains_of(x, y, k, cost, 10**6)
        score = max(
            k * len(c) - cost * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) for c in got
        )
        strict = (np.diff(x[order]) > 0).all() and (np.diff(y[order]) > 0).all()
        assert score == pytest.approx(best.max()) or strict
        assert sorted(np.concatenate(got).tolist()) == list(range(len(x)))
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in got)


@pytest.mark.parametrize("seed", range(4))
def test_best_chain_is_found_among_rising_anchors_too(seed):
    rng = np.random.default_rng(seed)
    for _ in range(50):
        n = int(rng.integers(1, 14))
        x, y = (np.sort(rng.choice(200, n, replace=False)) for _ in "xy")
        best = np.zeros(n)
        for i in range(n):
            best[i] = 8 + max([0, *[best[j] - 0.25 * (x[i] - x[j] + y[i] - y[j]) for j in range(i)]])
        got = sd.chains_of(x, y, 8, 0.25, 10**6)
        assert max(8 * len(c) - 0.25 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) for c in got) == pytest.approx(best.max())
        assert sorted(np.concatenate(got).tolist()) == list(range(n))


@pytest.mark.parametrize("gap", [10, 15, 20, 25, 30])
def test_a_passage_between_shorter_shared_pieces_is_found(spark, gap):
    rng, docs = random.Random(gap), []
    for pair in range(60):
        head, passage, foot = own(rng, 20), own(rng, 60), own(rng, 20)
        docs += [(2 * pair + i, " ".join(head + own(rng, gap) + passage + own(rng, gap) + foot)) for i in (0, 1)]
    found = spans(sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    for d, _ in docs:
        assert covered(found, d, 20 + gap, 80 + gap) == 1, d
    assert all(r["identity"] >= 0.8 for r in found)


@pytest.mark.parametrize("part", [30, 35, 40, 49])
def test_a_passage_whose_parts_stand_first_in_other_documents_is_found(spark, part):
    rng, docs = random.Random(part), []
    for n in range(60):
        passage = own(rng, 60)
        for i, words in enumerate((passage[:part], passage[-part:], passage, passage)):
            docs.append((4 * n + i, " ".join(own(rng, 20) + words + own(rng, 20))))
    found = spans(sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    for n in range(60):
        assert covered([r for r in found if r["doc_id"] == 4 * n + 3], 4 * n + 3, 20, 80) == 1, n
        assert covered(found, 4 * n + 2, 20, 80) == 1, n
    texts = {d: t.split() for d, t in docs}
    for r in found:
        assert r["identity"] == 1 and r["end"] - r["begin"] >= 50
        assert texts[r["doc_id"]][r["begin"]:r["end"]] == texts[r["source_id"]][r["source_begin"]:r["source_end"]]


@pytest.mark.parametrize("changed, part, step", [(30, 40, 20), (40, 45, 20), (45, 42, 25)])
def test_a_changed_passage_whose_parts_stand_first_elsewhere_is_found(spark, changed, part, step):
    rng = random.Random(changed)
    docs, where = [], []
    for n in range(20):
        passage = own(rng, 160)
        for at in range(0, len(passage) - part + 1, step):
            docs.append((len(docs), " ".join([*own(rng, 15), *passage[at:at + part], *own(rng, 15)])))
        docs.append((len(docs), " ".join([*own(rng, 10), *passage, *own(rng, 10)])))
        other = [f"x{i}" if i % changed == changed // 2 else w for i, w in enumerate(passage)]
        where.append((len(docs), len(passage)))
        docs.append((len(docs), " ".join([*own(rng, 25), *other])))
    found = spans(sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    recall = [covered([r for r in found if r["doc_id"] == d], d, 25, 25 + n) for d, n in where]
    assert sum(recall) / len(recall) >= 0.9, recall


def test_every_word_of_a_run_that_stands_earlier_is_covered(spark):
    d = "/root/testdata/sf0.01"
    docs = {r[0]: r[1].lower().split() for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    have, first = defaultdict(set), {}
    for r in QUERIES["op1_substring_dedup"](spark, d).collect():
        have[r.doc_id].update(range(r.begin, r.end))
    for i in sorted(docs):
        for at in range(len(docs[i]) - 49):
            doc, _ = first.setdefault(tuple(docs[i][at:at + 50]), (i, at))
            assert doc == i or have[i] >= set(range(at, at + 50)), (i, at)


def test_stretches_cover_every_part_that_is_alike_enough():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a, b, x, y = [], [], [], []
        for _ in range(int(rng.integers(2, 8))):
            run = rng.integers(0, 1 << 30, int(rng.integers(8, 45))).tolist()
            x += range(len(a), len(a) + len(run) - 7, 6)
            y += range(len(b), len(b) + len(run) - 7, 6)
            a, b = a + run, b + run
            a = a + rng.integers(0, 1 << 30, int(rng.integers(1, 30))).tolist()
            b = b + rng.integers(0, 1 << 30, int(rng.integers(1, 30))).tolist()
        a, b, x, y = map(np.array, (a, b, x, y))
        got = sd.stretches(x, y, a, b, 8, 50, 0.8)
        have = {w for g in got for w in range(g[0], g[1])}
        for b0, e0, b1, e1, n in got:
            assert n == sd.matched(a[b0:e0], b[b1:e1]) >= 0.8 * max(e0 - b0, e1 - b1) and e0 - b0 >= 50
        for i in range(len(x)):
            for j in range(i, len(x)):
                b0, e0, b1, e1 = x[i], x[j] + 8, y[i], y[j] + 8
                if e0 - b0 >= 50 and sd.matched(a[b0:e0], b[b1:e1]) >= 0.8 * max(e0 - b0, e1 - b1):
                    assert have >= set(range(b0, e0))


def test_matched_is_the_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert sd.matched(a, b) == table[-1, -1]


def test_shared_runs_share_a_seed():
    rng = np.random.default_rng(1)
    for _ in range(200):
        run = rng.integers(0, 1 << 62, 19).astype("u8")
        a, b = (np.concatenate([rng.integers(0, 1 << 62, 30).astype("u8"), run, rng.integers(0, 1 << 62, 9).astype("u8")]) for _ in "ab")
        assert set(sd.seeds_of(a, 8, 12)[1]) & set(sd.seeds_of(b, 8, 12)[1])


def test_anchors_of_a_hot_seed(spark):
    rows = [(5 if i % 3 else i, i // 4 if i else None, i // 4, i % 4) for i in range(4000)]
    seeds = spark.createDataFrame(rows, "seed long, doc long, rid long, pos int")
    got = {tuple(r)[:2] for r in sd.anchors(seeds).collect()}
    hot = {(r[2], r[3]) for r in rows if r[0] == 5}
    assert got == hot - {min(hot, key=lambda h: (h[0], h[1]))}


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r[0]: r[1].lower().split() for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    found = spans(QUERIES["op1_substring_dedup"](spark, d))
    places = defaultdict(list)
    for i, w in docs.items():
        for at in range(len(w) - 49):
            places[hash(tuple(w[at:at + 50]))].append((i, at))
    need = defaultdict(set)
    for held in places.values():
        if len({i for i, _ in held}) > 1:
            for i, at in held:
                need[i].update(range(at, at + 50))
    for i, words in need.items():
        have = {w for r in found for w in (range(r["begin"], r["end"]) if r["doc_id"] == i else
                                           range(r["source_begin"], r["source_end"]) if r["source_id"] == i else ())}
        assert len(words - have) <= 0.1 * len(words), i
    for r in found[:300]:
        a, b = docs[r["doc_id"]][r["begin"]:r["end"]], docs[r["source_id"]][r["source_begin"]:r["source_end"]]
        ids = {w: n for n, w in enumerate({*a, *b})}
        assert r["n_matched"] <= sd.matched(np.array([ids[w] for w in a]), np.array([ids[w] for w in b]))


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    rows = [(None, long), (1, None), (2, ""), (3, "a " * 3000), (4, "a " * 3000), (5, long), (5, long), (6, "x y z"), (7, long[:2000])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source_id int")
    found = spans(sd.repeated_passages(df))
    whole = [(r["doc_id"], r["source_id"], r["begin"], r["end"]) for r in found if r["doc_id"] == 5]
    assert whole == [(5, None, 0, 20000)] * 2
    assert {r["doc_id"] for r in found} <= {3, 4, 5, 7} and 7 in {r["doc_id"] for r in found}
    assert sd.repeated_passages(df.limit(0)).count() == 0


def test_seeds_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, wide, n).astype("u8") for n in (0, 1, 7, 8, 18, 19, 20, 60, 300) for wide in (2, 9, 1 << 62)]
    for some in (texts, texts[:6], texts[::-1], [texts[0]]):
        row, at, value = sd.seeds_of_all(some, 8, 12)
        for i, h in enumerate(some):
            mine = np.flatnonzero(row == i)
            mine = mine[np.argsort(at[mine])]
            own = sd.seeds_of(h, 8, 12)
            assert at[mine].tolist() == own[0].tolist() and value[mine].tolist() == own[1].tolist(), i
    h = rng.integers(0, 1 << 62, 200).astype("u8")
    total = np.zeros(151, "u8")
    for i in range(50):
        total = total * np.uint64(sd._FACTOR) + h[i:i + 151]
    assert (sd.run_hashes(h, 50) == sd.mixed(total)).all() and len(sd.run_hashes(h[:49], 50)) == 0


def test_anchors_write_hashes_and_documents_of_boundary_records_only(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(sd, "written", lambda df, label, write=sd.written: tables.setdefault(label, write(df, label)))
    rows = [(i // 3, i % 7, i, 1) for i in range(3000)]
    sd.anchors(spark.createDataFrame(rows, "seed long, doc long, rid long, pos int"), lasts=False).count()
    assert tables["anchors"].filter("not edge and (seed is not null or doc is not null)").isEmpty()
    assert "last_rid" not in tables["anchors"].columns


def test_texts_are_not_broadcast_to_at_any_size(spark, monkeypatch):
    plans = {}

    def planned(df, label, write=sd.written):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(sd, "written", planned)
    words = " ".join(f"t{i}" for i in range(80))
    sd.repeated_passages(spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string")).count()
    assert "SortMergeJoin" in plans["blocks"] and "Broadcast" not in plans["blocks"]
