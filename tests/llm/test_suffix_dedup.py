"""Bytes of windows that start in an earlier document, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.llm import suffix_dedup
from vacanta.llm.suffix_dedup import equal_groups, remove_repeated_windows, rolled, runs_of_windows, smallest


def reference(docs, length=50):
    raw = [(i, (t or "").encode()) for i, t in docs]
    rank = {i: (i is not None, i or 0) for i, _ in raw}
    first = {}
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, rank[i]), rank[i])
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < rank[i]:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


def table(spark, docs, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    word = [("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(word) for _ in range(n))
    shared = [prose(n) for n in (9, 12, 30, 60)]
    docs = []
    for i in range(150):
        parts = [prose(r.randint(0, 20)) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared))
        docs.append((i * 3 % 151, r.choice(["", " "]).join(parts)))
    text = prose(80)
    docs += [(200, text), (201, text[:60] + "X" + text[61:]), (202, text), (203, text[30:] + text[:30]), (204, text)]
    docs += [(205, "=" * 700), (206, "-" + "=" * 49), (207, "=" * 50 + "-" + "=" * 51), (208, "=" * 49)]
    docs += [(209, None), (210, ""), (211, "short"), (None, text + "!"), (None, "null " + text), (212, text), (212, text), (213, shared[3] + "\n" + prose(4000))]
    return docs


def test_against_plain_python(spark, corpus):
    expected = reference(corpus)
    assert found(remove_repeated_windows(table(spark, corpus))) == expected
    assert sum(r[2] for r in expected) > 5000


def test_seeds_of_many_runs_and_small_chunks(spark, corpus, monkeypatch):
    expected = reference(corpus)
    assert found(remove_repeated_windows(table(spark, corpus), hot=2)) == expected
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    monkeypatch.setattr(suffix_dedup, "SORTED", 8)
    some = corpus[:40] + corpus[-22:-1]
    assert found(remove_repeated_windows(table(spark, some))) == reference(some)


@pytest.mark.parametrize("length", [20, 64])
def test_other_lengths(spark, corpus, length):
    some = corpus[:60] + corpus[-22:]
    assert found(remove_repeated_windows(table(spark, some), length)) == reference(some, length)


def test_too_short(spark):
    with pytest.raises(ValueError):
        remove_repeated_windows(table(spark, [(1, "a")]), 19)


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(none).collect() == []
    docs = [(2, "ab " * 30), (1, "ab " * 30), (3, None)]
    clashing = table(spark, docs).withColumns({c: F.lit("x") for c in ("u", "key", "bytes", "kept", "n_bytes", "first", "seed")})
    out = remove_repeated_windows(clashing)
    assert found(out) == reference(docs)
    assert [r.key for r in out.collect()] == ["x"] * 3
    digests = remove_repeated_windows(clashing, kept=lambda c: F.sha2(c, 256))
    assert {(r.doc_id, r.kept) for r in digests.collect()} == {(r.doc_id, r.d) for r in out.select("doc_id", F.sha2("kept", 256).alias("d")).collect()}


def test_radix_sort():
    rows = np.random.default_rng(1).integers(0, 2, (4000, 11)).astype("u1")
    first = np.random.default_rng(2).integers(0, 3, 4000)
    group = equal_groups(rows, first)
    by = {}
    for i, key in enumerate(zip(first.tolist(), map(bytes, rows))):
        by.setdefault(key, []).append(i)
    for members in by.values():
        assert len({group[i] for i in members}) == 1 and (group[members[0]] >= 0) == (len(members) > 1)
    assert len({group[m[0]] for m in by.values() if len(m) > 1}) == sum(len(m) > 1 for m in by.values())
    assert len(equal_groups(rows[:0], first[:0])) == 0


def test_equal_windows_have_equal_seeds():
    r = np.random.default_rng(3)
    data = r.integers(0, 4, 3000).astype("u1")
    twice = np.concatenate([data, data])
    ends = np.array([3000, 6000])
    seeds = np.zeros(6000, "i8")
    seen = np.zeros(6000, int)
    for seed, place, n in runs_of_windows(twice, ends, 50):
        for s, p, k in zip(seed, place, n):
            seeds[p:p + k] = s
            seen[p:p + k] += 1
    assert (seeds[:2951] == seeds[3000:5951]).all()
    assert (seen[:2951] == 1).all() and (seen[2951:3000] == 0).all()
    plain = rolled(data, 20)
    assert len(plain) == 2981 and plain[5] == rolled(data[5:25], 20)[0]
    assert (smallest(plain, 31) == [plain[i:i + 31].min() for i in range(2951)]).all()


@pytest.mark.parametrize("size", [8, 16, 24])
def test_hashes_of_words_of_eight_bytes(size):
    data = np.random.default_rng(4).integers(0, 256, 101).astype("u1")
    plain = rolled(data, size)
    assert len(plain) == 102 - size and len(set(plain.tolist())) == len(plain)
    assert all(plain[i] == rolled(data[i:i + size].copy(), size)[0] for i in range(len(plain)))
    assert len(rolled(data[:size - 1], size)) == 0


def test_seeds_are_made_twice_a_text(spark, corpus, monkeypatch):
    """Once to find those of several texts and once to cut the runs, however many join steps follow."""
    made, plain = spark.sparkContext.accumulator(0), suffix_dedup.seeds_of

    def counting(texts, length):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return plain(texts.select("u", "bytes").mapInArrow(run, "u long, bytes binary"), length)

    monkeypatch.setattr(suffix_dedup, "seeds_of", counting)
    rows = table(spark, corpus)
    assert found(remove_repeated_windows(rows)) == reference(corpus)
    assert 0 < made.value <= len({r[1] for r in corpus})


def test_texts_are_joined_once_to_their_spans(spark, corpus, monkeypatch):
    scans, write = [], suffix_dedup.written

    def kept(df, label):
        if label == "kept":
            plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
            scans.append(sum("Relation [" in line and "bytes#" in line for line in plan))
        return write(df, label)

    monkeypatch.setattr(suffix_dedup, "written", kept)
    assert found(remove_repeated_windows(table(spark, corpus), kept=lambda c: c)) == reference(corpus)
    assert scans == [1]
