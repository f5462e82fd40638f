"""Fingerprints against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash

from vacanta.llm import fingerprints as fp
from vacanta.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=seed)
    return signed(seed)


def terms(text):
    return [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in re.findall(r"[^\W_]+", (text or "").lower())]


def reference(docs, band=fp.IDF_BAND):
    """docs: (id, text) with unique ids."""
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    df = Counter(t for _, text in docs for t in set(terms(text)))
    low, high = len(docs) * math.exp(-band[1]) - 1e-9, len(docs) * math.exp(-band[0]) + 1e-9
    known = {t for t, n in df.items() if low <= n <= high}
    lexicons = [(7 * i, mask, j) for i, (mask, n) in enumerate(fp.SUBSETS) for j in range(n)]

    def fingerprint(text):
        mine = sorted(set(terms(text)) & known)
        subsets = [[t for t in mine if (t >> shift) & mask == j] for shift, mask, j in lexicons]
        out = [hash_longs(s) if s else None for s in subsets]
        return [*out, None if mine else hash_longs(sorted(set(terms(text))))]

    def alike(a, b):
        used = sum(x is not None or y is not None for x, y in zip(a, b))
        return sum(x == y and x is not None for x, y in zip(a, b)) / max(used, 1)

    def shown(f):
        return " ".join("-" if h is None else f"{h % (1 << 64):x}" for h in f)

    out = {}
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b = fingerprint(text), fingerprint(edited)
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b),
                  alike(a, fingerprint(after)))
    return out


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    want = reference(docs)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4] and got[d][4:] == pytest.approx(want[d][4:]), d


def rows_of(df):
    return [(r[0], r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), fp_text(r.fingerprint),
             fp_text(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


def fp_text(f):
    return " ".join("-" if h is None else f"{h % (1 << 64):x}" for h in f)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_odd_rows(spark, buckets):
    texts = [None, "", "x", "one two", "Straße 𝄞𝄞 été", "a b c d e f g " * 500, "one two", "!!!", "two THREE, one", "été x"]
    docs = [(None if i == 6 else i * i, t, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, FINGERPRINT string")
    band = (0.1, 3.0)
    got = rows_of(fp.fingerprint_documents(df, band=band, buckets=buckets))
    want = [(d, *v[:4], *(round(x, 9) for x in v[4:])) for d, v in reference([r[:2] for r in docs], band).items()]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = rows_of(fp.fingerprint_documents(df.unionByName(df.filter("doc_id = 9")), band=band, buckets=buckets))
    assert len(again) == len(docs) + 1 and [r for r in again if r[0] == 9][0][6] in (0.0, 1.0)
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    assert rows_of(fp.fingerprint_documents(df.limit(1)))[0][6] == 1.0


def test_equal_texts_are_alike_and_others_not(spark):
    got = QUERIES["op7_fingerprints"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (both.groupby("text").fingerprint.nunique() == 1).all()
    assert both.groupby("fingerprint").text.nunique().max() <= 3
    assert got.near_next.mean() < 0.05 < 0.1 < got.near_edited.mean() < 0.9


def test_near_copies_in_a_rare_language_stay_alike(spark):
    rng = random.Random(4)
    common, rare = ([f"{x}{i}" for i in range(n)] for x, n in (("c", 3000), ("r", 90)))
    docs = [(i, " ".join(rng.sample(common, 80))) for i in range(2955)]
    texts = [rng.sample(rare, 60) for _ in range(45)]  # 1.5 percent of all, with a term in 1 percent each
    docs += [(5000 + i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = fp.lexicon(df)
    near = [(i, " ".join(t), " ".join(t[:30] + ["changed"] + t[31:])) for i, t in enumerate(texts)]
    both = fp.with_fingerprint(spark.createDataFrame(near, "i long, a string, b string"), "a", terms, "x")
    both = fp.with_fingerprint(both, "b", terms, "y")
    alike = [r[0] for r in both.select(fp.likeness(both.x, both.y)).collect()]
    assert min(alike) > 0.3, sorted(alike)[:5]


def test_each_text_is_fingerprinted_once(spark, monkeypatch):
    """Besides one row per bucket, no text is fingerprinted again to find the buckets of its id."""
    done, plain = spark.sparkContext.accumulator(0), fp.with_fingerprint

    def counting(docs, *args):
        def run(batches):
            for batch in batches:
                done.add(batch.num_rows)
                yield batch

        return plain(docs.mapInArrow(run, docs.schema), *args)

    monkeypatch.setattr(fp, "with_fingerprint", counting)
    df = spark.createDataFrame([(i, f"word{i % 7} other{i}") for i in range(200)], "doc_id long, text string")
    assert len(fp.fingerprint_documents(df, buckets=3).collect()) == 200
    assert done.value <= 200 + 3 + 200
