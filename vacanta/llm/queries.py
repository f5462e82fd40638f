"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm import (
    fingerprints, jaccard_join, lexical_search, line_dedup, mixing, packing, quality_model, quality_rules, sharding,
    substring_dedup, suffix_dedup, token_files, whitening,
)
from vacanta.llm.common import document_texts
from vacanta.sources.scratch import scratch_dir

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen contiguous shards of near-equal bytes."""
    shards = sharding.shard_documents(document_texts(spark, d, "doc_id", "text"), 16)
    return shards.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents concatenated and cut into sequences of 2048 tokens."""
    packed = packing.pack_documents(document_texts(spark, d, "doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op8_token_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents written as ids in seekable files, and read back."""
    docs = document_texts(spark, d, "doc_id", "text")
    manifest = token_files.write_token_files(docs, scratch_dir(spark, "tokens"), vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Words that a mix of the sources, weighted 5, 2, 1 in turn, takes of each document."""
    docs = document_texts(spark, d, "doc_id", "source", "text")
    mixed = mixing.mix_documents(docs, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every text, and whether fixed limits and outlier distances keep it."""
    docs = document_texts(spark, d, "doc_id", "text", "lang", "source")
    return quality_rules.quality_outliers(docs, keep=["doc_id"]).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept"
    )


@query
def op7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every text and of its edited form."""
    found = fingerprints.fingerprint_documents(document_texts(spark, d, "doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """All documents without the runs of lines that stand earlier in the corpus."""
    docs = document_texts(spark, d, "doc_id", "text")
    return line_dedup.remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query
def op9_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose five-word shingles have a similarity of 0.8 or more."""
    found = jaccard_join.near_duplicates(document_texts(spark, d, "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op6_quality_model(spark: SparkSession, d: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels that are not held out."""
    docs = document_texts(spark, d, "doc_id", "text")
    model = quality_model.fit_model(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scored = quality_model.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents, also with small changes."""
    return substring_dedup.repeated_passages(document_texts(spark, d, "doc_id", "text"))


@query
def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    docs = document_texts(spark, d, "doc_id", "text")
    return lexical_search.search(docs, spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text"))


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings on the 32 leading components of their covariance, whitened."""
    return whitening.whiten(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op13_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    """All documents without the 50-byte strings that start in an earlier one, too."""
    found = suffix_dedup.remove_repeated_windows(document_texts(spark, d, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# The same sets, all pairs that share a shingle, and components by reachability.
ORACLES["op9_jaccard_join"] = r"""
with recursive texts as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
grams as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ')
         else array_to_string(list_slice(w, i, i + 4), ' ') end as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from grams x join grams y on x.gram = y.gram and x.doc_id < y.doc_id
  group by x.doc_id, y.doc_id),
links as (
  select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * k >= 80 * (s.n + t.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id
from documents d join least l using (doc_id) left join sizes s using (doc_id)"""

# Terms by the same pattern, A to Z lower-cased, and the same whole-number score.
ORACLES["op11_lexical_search"] = r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where text is not null),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where text is not null),
lengths as (select doc_id, count(*) as n from doc_terms group by doc_id),
corpus as (select count(*) as docs, sum(n)::bigint as terms from lengths),
tfs as (select doc_id, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by all),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tfs, corpus group by term),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from item_terms join tfs using (term) join weights using (term) join lengths using (doc_id), corpus
  group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scores where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50"""

# All windows of 50 bytes (in hexadecimal, from parts of a text) with the first document of each.
ORACLES["op13_suffix_dedup"] = r"""
with bytes as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
parts as (select doc_id, q, substr(h, 2 * q + 1, 2 * 249) as h from (
  select doc_id, h, unnest(range(0, n - 49, 200)) as q from bytes where n >= 50)),
windows as (
  select doc_id, q + k as p, substr(h, 2 * k + 1, 100) as w
  from (select doc_id, q, h, unnest(range(0, least(200, length(h) // 2 - 49))) as k from parts)),
firsts as (select w, min(doc_id) as first from windows group by w),
hits as (select doc_id, p from windows join firsts using (w) where first < doc_id),
gaps as (
  select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new from hits),
runs as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from gaps),
spans as (select doc_id, min(p) as b, max(p) + 50 as e from runs group by doc_id, run),
kept as (
  select doc_id, h, n, b, e, lead(b, 1, n) over (partition by doc_id order by b) as until,
    row_number() over (partition by doc_id order by b) as k from bytes join spans using (doc_id)),
cut as (
  select doc_id, any_value(n) as n_bytes, sum(e - b)::bigint as n_removed, count(*) as n_spans,
    string_agg(case when k = 1 then substr(h, 1, 2 * b) else '' end || substr(h, 2 * e + 1, 2 * (until - e)), '' order by b) as rest
  from kept group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(rest, h))) as kept_sha256
from bytes left join cut using (doc_id)"""
