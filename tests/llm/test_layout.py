"""Shards, mixes, packed sequences and token files against plain Python."""

import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.llm import mixing, packing, prefix, sharding, token_files, tokens
from vacanta.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
ODD = [
    (5, "béta  two\n\nthree \t", "s", "x"), (None, "no id", None, "x"), (2, None, "s", "x"), (3, "", "t", "x"),
    (4, "word " * 3000, "t", "x"), (4, "same id", "t", "x"), (7, "copy of one", "s", "x"), (7, "copy of one", "s", "x"),
    (9, "a b  c\x1cd <|endoftext|> it's 12,5 !!\n x", "u", "x"), (10, " lead", "u", "x"),
]
COLUMNS = "doc_id long, text string, source string, {} string"


def count(text):
    return len("".join(" " if c in SPACE else c for c in text or "").split(" ")) - "".join(
        " " if c in SPACE else c for c in text or ""
    ).split(" ").count("")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS.format("SIZE"))


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def check_shards(rows, shards):
    """rows: (doc_id, size, shard, slot)."""
    total = sum(r[1] for r in rows)
    rows = sorted(rows, key=lambda r: (r[2], r[3]))
    assert [r[0] is None for r in rows] == sorted((r[0] is None for r in rows), reverse=True)
    ids = [r[0] for r in rows if r[0] is not None]
    assert ids == sorted(ids)
    before = 0
    for r, at in zip(rows, accumulate([r[1] for r in rows], initial=0)):
        assert r[2] == (2 * at + r[1]) * shards // (2 * total)
        before = r[3] + 1 if before and r[3] else r[3] + 1
    for shard in {r[2] for r in rows}:
        assert [r[3] for r in rows if r[2] == shard] == list(range(sum(r[2] == shard for r in rows)))


def test_shards_of_documents(spark, documents):
    got = QUERIES["op2_sharding"](spark, SF).collect()
    check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in got], 16)
    texts = {d: t for d, t, _ in documents}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {
        d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()
    }
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_shards_of_odd_rows(odd, tmp_path):
    got = sharding.shard_documents(odd, 3)
    rows = got.collect()
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "size", "shard", "slot"])
    assert sorted((r.doc_id or 0, r["size"]) for r in rows) == sorted(
        (d or 0, len((t or "").encode()) + 1) for d, t, *_ in ODD
    )
    check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in rows], 3)
    sharding.write_shards(got, str(tmp_path / "s"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(ODD)
    assert sharding.shard_documents(odd.limit(0), 3).count() == 0


def test_prefix_sums_split_a_hot_value(spark):
    rows = spark.range(6000).select((F.col("id") % 3 > 0).cast("int").alias("k"), F.lit(2).alias("v"))
    keyed = rows.withColumn("salt", F.monotonically_increasing_id())
    got, total = prefix.with_prefix(keyed, [F.col("k"), F.xxhash64("salt"), F.col("salt")], ["v"], "t")
    assert total == {"rows": 6000, "v": 12000}
    assert sorted(r[0] for r in got.select(prefix.ROW).collect()) == list(range(6000))
    assert got.filter(f"__before_v != 2 * {prefix.ROW}").count() == 0


def best_sum(lengths, counts, budget):
    sums = {0}
    for length, n in zip(lengths, counts):
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= budget}
    return max(sums)


def test_knapsack_is_best(spark):
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.array(sorted(set(rng.integers(1, 40, 5).tolist())))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 120))
        chosen = mixing.knapsack(lengths, counts, budget)
        assert (chosen <= counts).all() and (lengths * chosen).sum() == best_sum(lengths, counts, budget)


def test_counts_fit_a_large_budget():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(0, 3000), rng.integers(0, 50, 3000)
    for budget in (0, 1, 777, 10**6, 5 * 10**7, int((lengths * counts).sum()) + 5):
        take = mixing.fit_counts(lengths, counts, budget, 1 << 12)
        assert (0 <= take).all() and (take <= counts).all()
        assert (lengths * take).sum() == min(budget, (lengths * counts).sum())


def water_level(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        share, used = sum(weight[n] for n in free), 0.0
        for n in sorted(free, key=str):
            more = min(left * weight[n] / share, most * sizes[n] - target[n])
            target[n] += more
            used += more
        left -= used
        free = {n for n in free if target[n] < most * sizes[n] - 1e-9}
    return target


def check_mix(got, docs):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += count(text)
    want = water_level(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, count(t)) for d, t, _ in docs)
    by_source, source_of = Counter(), {}
    for d, t, s in docs:
        source_of.setdefault((d, count(t)), set()).add(s)
    for r in got:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        source = next(s for s in source_of[(r.doc_id, r["size"])] if sizes[s] == r.source_size)
        assert r.target == pytest.approx(want[source])
        by_source[source] += r.taken
    return {s: want[s] - by_source[s] for s in want}


def test_mix_of_documents(spark, documents):
    got = QUERIES["op10_mixing"](spark, SF).collect()
    missed = check_mix(got, documents)
    for source, miss in missed.items():
        sizes = Counter(count(t) for _, t, s in documents if s == source)
        target, whole = water_level({s: sum(count(t) for _, t, o in documents if o == s) for s in missed})[source], sum(
            k * v for k, v in sizes.items()
        )
        rest = int(target + 0.5) % whole if int(target + 0.5) < 3 * whole else 0
        assert abs(miss - (rest - best_sum(sizes, sizes.values(), rest))) <= 0.51
    again = QUERIES["op10_mixing"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(odd):
    mixed = mixing.mix_documents(odd)
    rows = mixed.withColumn("taken", F.col("size") * F.col("copies")).collect()
    check_mix(rows, [r[:3] for r in ODD])
    repeated = mixing.repeat_documents(mixed, ["doc_id", "text"])
    assert repeated.count() == sum(r.copies for r in rows)
    assert mixing.mix_documents(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    names = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
    loaded = {k: Tokenizer.from_file(vocabulary(v)) for k, v in names.items()}
    return lambda kind, text: loaded[kind].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind,name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_cached_ids_are_the_tokenizers(plain, documents, kind, name):
    mine = tokens.worker_tokenizer(kind, vocabulary(name))
    texts = [t for _, t, *_ in ODD] + [t for _, t, _ in documents] + [
        "", " ", "\n", "a", "a\n", "\na b", "a\tb  c", "x \n y", "Don't STOP, it's... (ok)!", "éa İΣ ẞ", "你好 \U0001f600",
        "foo bar baz", "a\x85b c", "12 3.4 5", "!!!,,, ...a", "word word two  three", "café, déjà.",
    ]
    for text in texts:
        assert np.frombuffer(mine.encode(text or ""), "<u4").tolist() == plain(kind, text), repr((text or "")[:80])


def id_order(docs):
    import xxhash

    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, -1 if d[1] is None else 0))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packed_documents(spark, documents, plain):
    got = sorted(QUERIES["op4_packing"](spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    line, at = {d: plain("word", t) + [1] for d, t, _ in documents}, 0
    for d in sorted(line):
        begin = 0
        while begin < len(line[d]):
            r, got = got[0], got[1:]
            size = min(2048 - at % 2048, len(line[d]) - begin)
            assert tuple(r) == (d, begin, size, crc(line[d][begin:begin + size]), len(line[d]), at // 2048, at % 2048)
            at, begin = at + size, begin + size
    assert not got


def test_packed_sequences(odd, plain, spark):
    pieces = packing.pack_documents(odd, vocabulary("word_bpe_49k.json"), length=64)
    rows = sorted(packing.packed_sequences(pieces, 64, pad_id=9).collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    ids = [i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()[:r.n_tokens]]
    assert all(len(r.ids) == 256 and r.n_tokens == sum(r.lengths) for r in rows)
    assert all(r.n_tokens == 64 for r in rows[:-1]) and set(np.frombuffer(rows[-1].ids, "<u4")[rows[-1].n_tokens:]) <= {9}
    docs = [d for r in rows for d in r.doc_ids]
    assert [d is None for d in docs] == sorted((d is None for d in docs), reverse=True)
    assert Counter(ids) == Counter(i for _, t, *_ in ODD for i in [*plain("word", t), 1])
    assert packing.packed_sequences(pieces.limit(0), 64).count() == 0
    assert packing.pack_documents(odd.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_token_files(spark, documents, plain):
    got = {r.doc_id: tuple(r) for r in QUERIES["op8_token_files"](spark, SF).collect()}
    at = 0
    for d, t, _ in sorted(documents):
        ids = plain("byte", t) + [0]
        assert got.pop(d) == (d, at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_token_files_of_odd_rows(odd, plain, tmp_path):
    path = str(tmp_path / "files")
    manifest = token_files.write_token_files(odd, path, vocabulary("byte_bpe_50k.json"))
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert sorted(map(tuple, ids)) == sorted(tuple([*plain("byte", t), 0]) for _, t, *_ in ODD)
    assert [r.start for r in rows] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [r.doc_id for r in rows] == [None, 2, 3, 4, 4, 5, 7, 7, 9, 10]
    some = token_files.read_token_files(manifest, [4, 9, 99]).collect()
    assert sorted(r.doc_id for r in some) == [4, 4, 9]
    assert token_files.write_token_files(odd.limit(0), path, vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_file_is_plain_zstandard_and_finds_damage(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    path = str(tmp_path / "a.zst")
    out = token_files.TokenFile(path)
    docs = [(1, b"\1\0\0\0" * 50), (None, b""), (3, b"\2\0\0\0")]
    for doc, ids in docs:
        out.add(doc, ids)
    out.close()
    reader = token_files.TokenFileReader(path)
    assert [reader.ids(i) for i in range(3)] == [ids for _, ids in docs] and reader.rows_of({0, 3}) == [2]
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    with zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True) as stream:
        assert stream.read().startswith(docs[0][1])
    last = int(reader.begins[-2])
    raw[last + 7] ^= 1
    (tmp_path / "a.zst").write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFileReader(path).ids(2)
