"""Mixing sources to target weights: exact budgets by subset sums over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.llm.common import WORD, without, written
from vacanta.llm.prefix import ROW, with_prefix

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source its `target`: a share of all sizes by weight, at most `most` times the source's own size.

    `sizes` has one row per source with `source` and `source_size`. Weights repeat over the sources by code
    point, NULL last. What a capped source cannot take is shared out again by weight until no source is above
    its cap. That is one level for all others, found by a few passes over the sources.
    """
    ranked, _ = with_prefix(sizes, [F.col("source").isNull(), F.col("source")], [], "sources")
    rows = ranked.select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col(ROW) % len(weights) + 1).cast("int"))
        .cast("double").alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"),
    )
    total, level, capped = None, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        got = rows.agg(
            F.sum("source_size"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above),
        ).first()
        total = got[0] or 0
        if got[3] == capped or not got[2]:
            break
        level, capped = (total - got[1]) / got[2], got[3]
    return rows.select(
        "source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target")
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to the budget or just below.

    Each length first gives its share rounded down. Long documents fill what is missing down to the last
    `window` words, and a bounded-knapsack table over these decides the rest.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype="i8")
    rest = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        room = rest - window
        if room <= 0:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), room // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    return take + knapsack(lengths, counts - take, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the counts whose total length is the largest that does not pass the budget."""
    chosen = np.zeros_like(counts)
    reach = np.zeros(budget + 1, dtype=bool)
    by = np.full(budget + 1, -1, dtype="i4")
    reach[0], items = True, []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        if not 0 < length <= budget or reach[budget]:
            continue
        left, power = min(int(counts[i]), budget // length), 1
        while left > 0 and not reach[budget]:
            copies = min(power, left)
            step = length * copies
            left, power = left - copies, power * 2
            new = reach[: budget + 1 - step] & ~reach[step:]
            by[step:][new] = len(items)
            reach[step:] |= new
            items.append((i, copies, step))
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, copies, step = items[by[at]]
        chosen[i] += copies
        at -= step
    return chosen


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7, window: int = 1 << 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """Decide how often the mix takes each document.

    Adds `size` (words), `source_size`, `target` and `copies` to the `keep` columns (all, if not given).
    Sources get the targets of `source_targets`. A source gives all its documents as many whole times as its
    target holds, then some once more: documents are counted by exact length, `fit_counts` says how many of
    each length make up the remaining budget, and these are the first by a seeded hash of their id. The sum of
    copies times size misses a target by less than a word plus what no subset of lengths can reach.

    A NULL text has size 0, sizes of 0 are taken as often as their source's whole turns, a NULL source is a
    source of its own, and an empty table gives no rows. Rows with the same id are different documents; which
    of two equal rows is taken once more does not show. Input columns named as an added one are replaced.
    One task sees one source's table of lengths, never its documents.
    """
    added = ["size", "source_size", "target", "copies"]
    kept = [c for c in (keep or docs.columns) if c.lower() not in added]
    clean = without(docs, *added).withColumn("size", word_count(F.col(text_col))).withColumn("__source", F.col(source_col))
    clean = clean.select(*kept, "size", "__source", F.xxhash64(F.lit(seed), F.col(id_col)).alias("__draw"))
    order = [F.col(c) for c in ("__source", "size", "__draw")] + [F.monotonically_increasing_id()]
    ranked, _ = with_prefix(clean, order, [], "mix")
    lengths = written(
        ranked.groupBy("__source", "size").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first")), "lengths"
    )
    sizes = lengths.groupBy(F.col("__source").alias("source")).agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")
    )
    targets = written(source_targets(sizes, weights, most), "targets")
    known = F.col("l.__source").eqNullSafe(F.col("t.source"))
    per_length = lengths.alias("l").join(targets.alias("t"), known).select("l.*", "t.source_size", "t.target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, budget = int(pdf["source_size"].iloc[0]), int(pdf["target"].iloc[0] + 0.5)
        turns = min(budget // size, most) if size else 0
        pdf = pdf.sort_values("size")
        more = fit_counts(
            pdf["size"].to_numpy("i8"), pdf["n"].to_numpy("i8"), budget - turns * size if turns < most else 0, window
        )
        return pdf.assign(turns=turns, more=more)

    schema = "__source string, size long, n long, first long, source_size long, target double, turns long, more long"
    plans = written(per_length.groupBy("__source").applyInPandas(plan, schema), "mixplan")
    same = (F.col("d.size") == F.col("p.size")) & F.col("d.__source").eqNullSafe(F.col("p.__source"))
    again = (F.col(f"d.{ROW}") < F.col("p.first") + F.col("p.more")).cast("long")
    return ranked.alias("d").join(plans.alias("p"), same).select(
        *[F.col(f"d.`{c}`") for c in kept], F.col("d.size"), F.col("p.source_size"), F.col("p.target"),
        (F.col("p.turns") + again).alias("copies"),
    )


def repeat_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as `copies` says."""
    return mixed.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).filter(
        "copies > 0"
    ).select(*[f"`{c}`" for c in columns])
