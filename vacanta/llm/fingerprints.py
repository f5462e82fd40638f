"""I-Match fingerprints: hashes of randomised lexicons of a band of inverse document frequencies."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.common import barrier, without

#: Terms in at least 1 and at most 10 percent of all documents.
IDF_BAND = (math.log(10), math.log(100))
#: Randomised lexicons as (mask, number): each keeps 1 in mask + 1 of the terms, and those of one mask have none in
#: common. Large ones tell texts apart, small ones outlast edits.
SUBSETS = ((0, 1), (1, 2), (3, 4), (7, 4), (15, 4), (31, 8), (63, 16), (127, 24))
_EMPTY = 42  # Spark's xxhash64 of an empty array


def term_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits of a text, in order."""
    terms = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> list[int]:
    """Sorted hashes of the terms whose ln(documents / documents with the term) lies in the band.

    Each such term is in at least exp(-band[1]) of all documents, so there are at most exp(band[1]) times as many
    as a document has distinct terms on average, however many documents there are.
    """
    total = docs.count()
    seen = docs.select(F.explode(F.array_distinct(term_hashes(F.col(text_col)))).alias("term"))
    counted = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    fits = F.col("df").between(math.ceil(total * math.exp(-band[1]) - 1e-9), math.floor(total * math.exp(-band[0]) + 1e-9))
    return sorted(r[0] for r in counted.filter(fits).select("term").collect())


def with_fingerprint(docs: DataFrame, text_col: str, terms: list[int], name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text: one hash per randomised lexicon, over its sorted distinct terms in it.

    An entry is NULL where a text has none of a lexicon's terms. A text without any term of the band has one
    entry only, the last, which hashes all its terms. A NULL text counts as empty.
    """
    known = F.from_json(F.lit(json.dumps(terms)), "array<bigint>")
    once = barrier(docs, __t=F.sort_array(F.array_intersect(term_hashes(F.col(text_col)), known)))

    def lexicon_of(term: Column, level: int) -> Column:
        """Which lexicon of a level a term belongs to: bits of its hash that no other level looks at."""
        return F.shiftright(term, 7 * level).bitwiseAND(F.lit(SUBSETS[level][0]).cast("bigint"))

    def picked(level: int) -> Column:
        return F.filter("__t", lambda t: lexicon_of(t, level) < SUBSETS[level][1])

    def entries(level: int) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(SUBSETS[level][1] - 1))
        return F.transform(numbers, lambda j: F.nullif(
            F.xxhash64(F.filter(f"__l{level}", lambda t: lexicon_of(t, level) == j)), F.lit(_EMPTY)
        ))

    levels = range(len(SUBSETS))
    # The terms that any lexicon of a level keeps are picked out once.
    chosen = barrier(once, **{f"__l{i}": picked(i) for i in levels})
    rest = F.xxhash64(F.sort_array(F.array_distinct(term_hashes(F.col(text_col)))))
    last = F.when(F.size("__t") == 0, rest)
    done = barrier(chosen, **{name: F.concat(*map(entries, levels), F.array(last))})
    return done.drop("__t", *[f"__l{i}" for i in levels])


def likeness(one: Column, other: Column) -> Column:
    """Share of equal entries among those that either fingerprint has."""
    used = F.size(F.filter(F.zip_with(one, other, lambda a, b: F.coalesce(a, b)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(one, other, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    return same / F.greatest(used, F.lit(1))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), " ")


def id_bucket(docs: DataFrame, id_col: str, buckets: int) -> Column:
    """Number of the range of ids that a row belongs to, NULL first; ranges hold about equal numbers of rows."""
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.select(F.percentile_approx(id_col, shares, 20 * buckets)).first()[0] or []
    bounds = sorted(set(found))
    wide = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + wide] for i in range(0, len(bounds), wide)]
    if not groups:
        return F.when(F.col(id_col).isNull(), 0).otherwise(1)
    coarse = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    at = F.size(F.filter(coarse, lambda b: b <= F.col(id_col)))
    inside = F.size(F.filter(F.get(fine, at - 1), lambda b: b <= F.col(id_col)))
    return F.when(F.col(id_col).isNull(), 0).when(at == 0, 1).otherwise(1 + (at - 1) * wide + inside)


def with_next(
    docs: DataFrame, id_col: str, tie: Column, values: list[str], buckets: int,
    derive: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Add `next_<value>` of the row with the next higher id; the last row's next is the first row.

    Rows meet in buckets of neighbouring ids, so nothing is sorted as a whole. The first rows of a bucket are also
    dealt to the bucket before it, the very first to the last, and go again when they have been looked at. Rows
    with one id stay in one bucket, in the order of `tie`.

    `derive` adds columns to rows that have their buckets: buckets are found from the ids alone, without that work.
    """
    placed = docs.withColumns({"__bucket": id_bucket(docs, id_col, buckets), "__tail": F.lit(0)})
    firsts = placed.groupBy("__bucket").agg(F.min(id_col).alias("__id")).orderBy("__bucket").collect()
    ids = [r["__id"] for r in firsts]
    before = [r["__bucket"] for r in [firsts[-1], *firsts[:-1]]] if firsts else []
    kind = docs.schema[id_col].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame(
        [(i, b, 1) for i, b in zip(ids, before)], f"__id {kind}, __bucket int, __tail int"
    )
    # At most one row per bucket, and the number of buckets is given.
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    tails = docs.join(F.broadcast(heads), same).select(*docs.columns, "__bucket", "__tail")
    order = Window.partitionBy("__bucket").orderBy("__tail", id_col, tie)
    looked = derive(placed.unionByName(tails)).withColumns({f"next_{v}": F.lead(v).over(order) for v in values})
    return looked.filter("__tail = 0").drop("__bucket", "__tail")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of another text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND,
    buckets: int | None = None,
) -> DataFrame:
    """Fingerprint every document, the same document half overwritten by its successor, and compare.

    Returns the id, `n_chars`, `edited_text`, the arrays `fingerprint` and `edited_fingerprint`, and their
    likeness to each other (`near_edited`) and of the fingerprint to the next document's (`near_next`).

    The lexicon comes from all documents and is the only thing that all tasks need; see `lexicon` for its bound.
    A NULL text is empty; a single document is its own next; ids may be NULL (first in order) or repeated (then
    ordered by a hash of the text; such rows meet in one task); no rows give no rows. Other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    terms = lexicon(slim, "__text", band)
    if buckets is None:
        buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = with_next(
        slim, "__doc", F.xxhash64("__text"), ["__text", "fingerprint"], buckets,
        lambda rows: with_fingerprint(rows, "__text", terms),
    )
    edited = barrier(
        near.withColumn("n_chars", F.char_length("__text").cast("long")),
        edited_text=edited_text(F.col("__text"), F.col("next___text")),
    ).drop("__text", "next___text")
    both = with_fingerprint(edited, "edited_text", terms, "edited_fingerprint")
    return without(both.withColumns({
        "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
        "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint")),
    }), "next_fingerprint").withColumnRenamed("__doc", id_col)
