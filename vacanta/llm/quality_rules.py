"""Quality rules: a few fixed limits, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.common import WORD, barrier, without, words, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics compared, all logarithms, and the least standard deviation given to each.
FEATURES = {"length": 0.5, "word": 0.05, "symbols": 0.5, "lines": 0.7, "repeats": 1.0}
#: Statistics are kept as whole numbers of this fraction, so that sums are exact in any order.
STEP = 256


def text_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the columns of COUNTS to the `keep` columns (all, if not given). A NULL text has no words.

    Three-word windows are compared by 64-bit hashes, sorted together with their places: equal neighbours are
    repeated windows, and a word counts once however many of them cover it.
    """
    kept = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    first = barrier(
        docs, __w=words(text), __lines=lines, n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    ).select(*kept, "__w", "__lines", "n_symbols")
    w, last = F.col("__w"), F.greatest(F.size("__w") - 2, F.lit(0))
    windows = F.transform(F.slice(w, F.lit(1), last), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    second = barrier(
        first, n_words=F.size(w).cast("long"), word_chars=F.char_length(F.array_join(w, "")).cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), __g=windows,
    ).drop("__w", "__lines")
    g, none = F.col("__g"), F.array().cast("array<struct<h:bigint,at:int>>")
    placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("at"))))
    repeated = F.size(F.array_distinct(g)) < F.size(g)
    third = barrier(second, __s=F.when(repeated, placed).otherwise(none)).drop("__g")
    s = F.col("__s")
    alike = F.filter(s, lambda x, i: (
        F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    ))
    fourth = barrier(third, __p=F.sort_array(F.transform(alike, lambda x: x["at"]))).drop("__s")
    p = F.col("__p")
    steps = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: F.least(F.lit(3), x - F.get(p, i)))
    covered = F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda a, x: a + x))
    return fourth.withColumn("n_repeat_words", covered.cast("long")).drop("__p")


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [
        F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n),
    ]
    return [F.round(x * STEP).cast("long").alias(f"q{i}") for i, x in enumerate(raw)]


P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def gamma_share(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / shape
    k = shape
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(shape * math.log(x) - x - math.lgamma(shape))


def chi2_quantile(df: int, share: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_share(df / 2, middle / 2) < share else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """Factor that makes a normal sample's covariance out of that of its innermost share."""
    return share / gamma_share(P / 2 + 1, chi2_quantile(P, share) / 2)


def distance() -> Column:
    """Squared Mahalanobis distance from the joined parameters m (centre) and v (inverse Cholesky factor)."""
    x = [F.col(f"q{i}") / STEP - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"v{i}{j}") * x[j]
        total = total + z * z
    return total


def parameters(moments: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse Cholesky factor per group from n, s (sums) and c (sums of products)."""
    n = F.col("n").cast("double")
    floors = list(FEATURES.values())
    cov = {
        f"k{i}{j}": (F.col(f"c{i}{j}") - F.col(f"s{i}") * (F.col(f"s{j}") / n)) / n * (factor / STEP**2)
        + (floors[i] ** 2 if i == j else 0.0) for i, j in _PAIRS
    }
    df = barrier(moments, **cov, **{f"m{i}": F.col(f"s{i}") / n / STEP for i in range(P)})
    for j in range(P):
        left = F.col(f"k{j}{j}")
        for k in range(j):
            left = left - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        df = barrier(df, **{f"l{j}{j}": F.sqrt(left)})
        below = {}
        for i in range(j + 1, P):
            x = F.col(f"k{i}{j}")
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = x / F.col(f"l{j}{j}")
        df = barrier(df, **below) if below else df
    for i in range(P):
        row = {f"v{i}{i}": 1.0 / F.col(f"l{i}{i}")}
        for j in range(i):
            x = F.lit(0.0)
            for k in range(j, i):
                x = x - F.col(f"l{i}{k}") * F.col(f"v{k}{j}")
            row[f"v{i}{j}"] = x / F.col(f"l{i}{i}")
        df = barrier(df, **row)
    return df.select("__group", *[f"m{i}" for i in range(P)], *[f"v{i}{j}" for i, j in _PAIRS])


def moments_of(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f"q{i}").alias(f"s{i}") for i in range(P)]
    products = [F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]
    return rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def concentrate(rows: DataFrame, params: DataFrame, share: float, factor: float) -> DataFrame:
    """One concentration step: parameters of the `share` of each group's rows that are nearest to its centre.

    The order statistic comes from counts of finely binned distances, so a group of any size needs one row per
    bin and task. Rows in the bin of the last one are all taken.
    """
    scored = rows.join(params, "__group").withColumn("__bin", F.floor(F.log(distance() + 1e-9) * 64).cast("int"))
    counted = scored.groupBy("__group", "__bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("__group")
    upto = F.sum("n").over(group.orderBy("__bin"))
    cut = counted.select("__group", "__bin", upto.alias("upto"), F.sum("n").over(group).alias("all")).filter(
        F.col("upto") >= F.ceil(F.col("all") * share)
    ).groupBy("__group").agg(F.min("__bin").alias("__last"))
    nearest = scored.join(written(cut, "mcdcut"), "__group").filter("__bin <= __last")
    return written(parameters(moments_of(nearest), factor), "mcd")


def robust_parameters(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """Minimum-covariance-determinant centre and covariance per group, reweighted once.

    The start is the median and interquartile range of each statistic; every concentration step lowers the
    determinant of the covariance of the chosen share, or ends where the step before did.
    """
    quartiles = rows.groupBy("__group").agg(*[F.percentile(f"q{i}", [0.25, 0.5, 0.75]).alias(f"t{i}") for i in range(P)])
    floors = list(FEATURES.values())
    params = written(quartiles.select(
        "__group", *[(F.col(f"t{i}")[1] / STEP).alias(f"m{i}") for i in range(P)],
        *[
            (1.0 / F.greatest((F.col(f"t{i}")[2] - F.col(f"t{i}")[0]) / (1.349 * STEP), F.lit(floors[i]))
             if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS
        ],
    ), "mcd")
    for step in range(steps):
        params = concentrate(rows, params, share, consistency(share) if step == steps - 1 else 1.0)
    inner = rows.join(params, "__group").filter(distance() <= chi2_quantile(P, 0.975))
    return written(parameters(moments_of(inner), consistency(0.975)), "mcd")


def group_keys(good: DataFrame, least: int) -> DataFrame:
    """The group of each language and source: its own, its language's rest, or the rest of all."""
    sizes = good.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= least
    sizes = written(sizes, "groups")
    rest = sizes.filter(~own).groupBy(F.col("__lang").alias("rest_lang")).agg(F.sum("n").alias("rest"))
    joined = sizes.join(rest, F.col("__lang").eqNullSafe(F.col("rest_lang")), "left")
    key = (
        F.when(own, F.to_json(F.struct(F.lit(0).alias("level"), "__lang", "__source")))
        .when(F.col("rest") >= least, F.to_json(F.struct(F.lit(1).alias("level"), "__lang")))
        .otherwise(F.lit("{}"))
    )
    return written(joined.select("__lang", "__source", key.alias("__group"), "n"), "groups")


def quality_outliers(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    share: float = 0.75, steps: int = 5, tail: float = 1e-6, least: int = 100, keep: list[str] | None = None,
) -> DataFrame:
    """Add COUNTS, `base_failed`, `distance` and `kept` to the `keep` columns (all, if not given).

    Documents that pass the fixed limits give five logarithms of their counts. Per language and source, a
    minimum-covariance-determinant estimate over `share` of them gives a centre and a covariance (each statistic
    keeps the variance stated in FEATURES besides). A document whose squared Mahalanobis distance passes the
    chi-squared quantile of 1 - `tail` is not kept. Sources with fewer than `least` good documents are taken
    together by language, languages with fewer by all; if these are fewer too, their documents have no distance
    and are kept.

    A NULL or empty text has no words and fails; a NULL language or source is a group of its own; equal rows get
    equal verdicts; no rows give no rows; input columns named as an added one are replaced. No statistic leaves
    its group's partial sums, so a hot source costs a row per task.
    """
    added = [*COUNTS, "base_failed", "distance", "kept"]
    kept = [c for c in (keep or docs.columns) if c.lower() not in added]
    named = without(docs, *added).withColumns({"__lang": F.col(lang_col), "__source": F.col(source_col)})
    counted = text_counts(named, text_col, [*kept, "__lang", "__source"]).withColumn("base_failed", base_failed())
    stats = written(counted.select("*", *features()), "quality")
    good = stats.filter(~F.col("base_failed"))
    keys = group_keys(good.select("__lang", "__source"), least)

    def with_group(rows: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("__lang").alias("k1"), F.col("__source").alias("k2"), "__group")
        on = F.col("__lang").eqNullSafe(F.col("k1")) & F.col("__source").eqNullSafe(F.col("k2"))
        return rows.join(k, on, how).drop("k1", "k2")

    large = keys.groupBy("__group").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("__group")
    rows = with_group(good.select("__lang", "__source", *[f"q{i}" for i in range(P)]), "inner").drop("__lang", "__source")
    rows = written(rows.join(large, "__group", "left_semi"), "qrows")
    params = robust_parameters(rows, share, steps)
    judged = with_group(stats, "left").join(params, "__group", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), distance())
    )
    near = F.coalesce(F.col("distance") <= chi2_quantile(P, 1 - tail), F.lit(True))
    return judged.select(*kept, *COUNTS, "base_failed", "distance", (~F.col("base_failed") & near).alias("kept"))
