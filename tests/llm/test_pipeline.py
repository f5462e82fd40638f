"""Every stage of the pipeline against plain Python, on what the stage before it kept."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_jaccard_join import reference as components
from tests.llm.test_layout import count, water_level
from tests.llm.test_line_dedup import reference as shortened
from tests.llm.test_quality_rules import verdicts
from vacanta.llm.common import written
from vacanta.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def kept(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_the_stages_and_their_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    for df in kept[:-1]:
        assert df.columns == kept[0].columns and df.count() > 0


def test_quality_rules(kept):
    before = rows(kept[0])
    good = verdicts([r[:4] for r in before], 100)
    assert rows(kept[1]) == [r for r in before if good[r[0]][-1]]


def test_line_dedup(kept):
    before, want = rows(kept[1]), []
    short = shortened([r[:2] for r in before])
    for r in before:
        lines, removed, text = short[r[0]]
        if removed == 0 or removed < lines:
            want.append((r[0], text, r[2], r[3], len(text) if removed else r[4]))
    assert rows(kept[2]) == sorted(want, key=str)


def test_near_duplicates(kept):
    before = rows(kept[2])
    root = components([r[:2] for r in before])
    assert rows(kept[3]) == [r for r in before if root[r[0]][1] == r[0]]


def test_mixing(kept):
    before, after = rows(kept[3]), Counter(rows(kept[4]))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += count(r[1])
    for r, n in after.items():
        assert r in set(before) and n <= 3
        taken[r[3]] += n * count(r[1])
    target = water_level(sizes)
    longest = max(count(r[1]) for r in before)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)


def test_packing(kept):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode
    before = rows(kept[4])
    found = sorted(kept[5].collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in found] == list(range(len(found)))
    assert all(r.n_tokens == 2048 for r in found[:-1]) and all(len(r.ids) == 4 * 2048 for r in found)
    line = np.concatenate([np.frombuffer(r.ids, "<u4")[:r.n_tokens] for r in found])
    owners = [d for r in found for d, n in zip(r.doc_ids, r.lengths) for _ in range(n)]
    texts = {r[0]: r[1] for r in before}
    ids = {d: [*encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    assert owners == sorted(owners) and Counter(owners) == Counter(
        {d: n * len(ids[d]) for d, n in Counter(r[0] for r in before).items()}
    )
    want = [i for d, n in sorted(Counter(r[0] for r in before).items()) for i in ids[d] * n]
    assert line.tolist() == want


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == kept[-1].columns
    assert sorted((r.sequence_id, bytes(r.ids)) for r in got.collect()) == sorted(
        (r.sequence_id, bytes(r.ids)) for r in kept[-1].collect()
    )


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
