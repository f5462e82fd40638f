"""Quality scores of a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature or pair at a time, adds up to a lookup table per feature and pair.
A score is the logistic function of the sum of a document's table entries.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from vacanta.llm.common import without

FEATURES = [
    "words", "word_length", "distinct_words", "distinct_pairs", "repeats", "short_words", "long_words", "lines",
    "repeated_lines", "line_words", "upper", "digits", "symbols", "marks", "exclamations", "foreign", "entropy",
]
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _MARK, _FOREIGN = range(7)
_SYMBOLS = "#*$%&|<>"


def byte_classes() -> np.ndarray:
    kinds = np.full(256, _MARK, "u1")
    kinds[128:] = _FOREIGN
    for kind, chars in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)),
                        (_SPACE, [9, 10, 11, 12, 13, 32]), (_SYMBOL, map(ord, _SYMBOLS))):
        kinds[list(chars)] = kind
    return kinds


_CLASSES = byte_classes()


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a whole text; an empty one has zeros only."""
    raw = (text or "").encode()
    found = raw.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    kinds = np.bincount(_CLASSES, counts, 7)
    solid = len(raw) - kinds[_SPACE]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts[counts > 0] / len(raw)
    lengths = list(map(len, found))
    return [
        np.log(n), np.log(solid / n), len(set(found)) / n, len(set(zip(found, found[1:]))) / max(n - 1, 1),
        sum(map(operator.eq, found, found[1:])) / n, sum(map((3).__ge__, lengths)) / n,
        sum(map((14).__le__, lengths)) / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        np.log(n / len(lines)), kinds[_UPPER] / solid, kinds[_DIGIT] / solid, kinds[_SYMBOL] / solid,
        kinds[_MARK] / solid, counts[33] / solid, kinds[_FOREIGN] / solid, float(-(share * np.log(share)).sum()),
    ]


@dataclass
class Model:
    """Bin edges and tables: `mains[j][bin]`, and `pairs[(i, j)][bin, bin]` over every `coarse`-th bin."""

    intercept: float
    edges: list[np.ndarray]
    mains: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.mains):
            total += table[b[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins, given sums of gradients and curvatures."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A step for each bin by a tree of depth two over the order of the bins."""
    out = np.empty(len(g))
    cut = best_cut(g, h, ridge)[1]
    for begin, end in ((0, cut), (cut, len(g))):
        part_g, part_h = g[begin:end], h[begin:end]
        inner = best_cut(part_g, part_h, ridge)[1] if len(part_g) else 0
        for b, e in ((begin, begin + inner), (begin + inner, end)):
            out[b:e] = g[b:e].sum() / (h[b:e].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that cuts the first feature, then the second on either side."""
    cut = best_cut(g.sum(1), h.sum(1), ridge)[1]
    best = (-1.0, np.zeros_like(g))
    for at in sorted({cut, *range(1, len(g), max(1, len(g) // 4))}):
        gain, out = 0.0, np.zeros_like(g)
        for part in (slice(0, at), slice(at, len(g))):
            if not g[part].size:
                continue
            side_g, side_h = g[part].sum(0), h[part].sum(0)
            inner = best_cut(side_g, side_h, ridge)[1]
            for cells in (slice(0, inner), slice(inner, None)):
                sum_g, sum_h = side_g[cells].sum(), side_h[cells].sum()
                gain += sum_g**2 / (sum_h + ridge)
                out[part, cells] = sum_g / (sum_h + ridge)
        if gain > best[0]:
            best = (gain, out)
    return best


def fit_tables(
    x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 4, rounds: int = 200, pair_rounds: int = 60,
    pairs: int = 6, rate: float = 0.1, ridge: float = 2.0,
) -> Model:
    """Boost main tables in turn, then those of the pairs that a cut of both features improves most."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.empty(0) for c in x.T]
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(rate_of_ones / (1 - rate_of_ones))), edges, [np.zeros(len(e) + 1) for e in edges], {}, coarse)
    if not len(y):
        return model
    b, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.mains):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), ridge)
            table += step
            total += step[b[:, j]]
    c = b // coarse
    wide = [(len(e) // coarse) + 1 for e in edges]

    def cells(i, j, values):
        return np.bincount(c[:, i] * wide[j] + c[:, j], values, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, h = slopes()
    gains = {}
    for i in range(len(edges)):
        for j in range(i):
            gains[i, j] = pair_tree(cells(i, j, g), cells(i, j, h), ridge)[0]
    for i, j in sorted(gains, key=gains.get, reverse=True)[:pairs]:
        model.pairs[i, j] = np.zeros((wide[i], wide[j]))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            step = rate * pair_tree(cells(i, j, g), cells(i, j, h), ridge)[1]
            table += step
            total += step[c[:, i], c[:, j]]
    return model


def held_out(id_column: Column) -> Column:
    """Whether labels of this document are kept from training."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def fit_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = 10_000,
) -> Model:
    """Learn from at most `sample_rows` labelled documents that are not held out, chosen by a hash of their id.

    Labels that are NULL or belong to no document teach nothing. Without any label every score is one half.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).orderBy(
        F.xxhash64("__id"), "__id", "__y"
    ).limit(sample_rows)
    # The limit bounds what is broadcast.
    known = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen), F.col("__doc") == F.col("__id")
    )
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("__text")]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__y"), *map(pa.array, x.T)], names=["__id", "__y", *names]
            )

    kind = known.schema["__id"].dataType.simpleString()
    schema = ", ".join([f"__id {kind}", "__y double", *[f"{n} double" for n in names]])
    rows = sorted(tuple(r) for r in known.select("__id", "__y", "__text").mapInArrow(run, schema).collect())
    x = np.array([r[2:] for r in rows]).reshape(-1, len(names))
    return fit_tables(x, np.array([r[1] for r in rows]))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `score` (0 to 1, high for label 1) and `predicted` to the `keep` columns (all, if not given).

    A NULL text is scored as an empty one. Input columns named as an added one are replaced; no rows give no rows.
    """
    kept = [c for c in (keep or docs.columns) if c.lower() not in ("score", "predicted")]
    slim = without(docs, "score", "predicted").select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                score = model.score(np.array([features(t.as_py()) for t in part.column("__scored")]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype("i4"))],
                    names=[*kept, "score", "predicted"],
                )

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return slim.mapInArrow(run, StructType([*slim.schema.fields[:-1], *added]))
