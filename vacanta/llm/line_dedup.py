"""Repeated runs of lines: winnowed fingerprints, extended on both sides and joined to the first place of what they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.common import SPACE, WORD, barrier, without, written


def with_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """Add `__at`, `__h` and `__n`: places, hashes and words of the lines that hold a word.

    Lines are cut at line feeds and trimmed.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    placed = F.filter(F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("at"), x.alias("x"))),
                      lambda s: s["x"].rlike(WORD))
    once = barrier(docs, __lines=placed)
    return once.withColumns({
        "__at": F.col("__lines.at"),
        "__h": F.transform("__lines", lambda s: F.xxhash64(F.btrim(s["x"], F.lit(" \t\r\x0b\x0c")))),
        "__n": F.transform("__lines", lambda s: F.size(F.split(F.btrim(s["x"], F.lit(" \t\r\x0b\x0c")), SPACE))),
    }).drop("__lines")


def winnowed(gram: int, window: int) -> Column:
    """Places, in `__g`, of the smallest hash of each window; the last one of equals. Short texts are one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("__g") - window, F.lit(0)))
    least = F.transform(starts, lambda s: F.array_min(F.transform(
        F.slice("__g", s + 1, F.lit(window)), lambda g, o: F.struct(g.alias("g"), (-(s + o)).alias("back"))
    )))
    return F.when(F.size("__g") > 0, F.array_distinct(F.transform(least, lambda m: -m["back"]))).otherwise(
        F.array().cast("array<int>")
    )


def fingerprints(lined: DataFrame, gram: int, window: int) -> DataFrame:
    """One row per chosen run of `gram` lines: hash `g`, document, place, and the lines on either side.

    `before` is nearest first. Sides hold `window` - 1 lines: beyond these, a longer match has its next fingerprint.
    """
    count = F.greatest(F.size("__h") - (gram - 1), F.lit(0))
    grams = barrier(lined, __g=F.transform(
        F.slice("__h", F.lit(1), count), lambda _, i: F.xxhash64(F.slice("__h", i + 1, F.lit(gram)))
    ))
    chosen = grams.select("__doc", "__rid", "__h", "__g", F.explode(winnowed(gram, window)).alias("pos"))
    side, pos = window - 1, F.col("pos")
    before = F.slice("__h", F.greatest(pos - side, F.lit(0)) + 1, F.least(pos, F.lit(side)))
    return chosen.select(
        F.get("__g", pos).alias("g"), "__doc", "__rid", "pos", F.reverse(before).alias("before"),
        F.slice("__h", pos + gram + 1, F.lit(side)).alias("after"),
    )


def leading_equal(one: Column, other: Column) -> Column:
    same = F.zip_with(one, other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False).cast("int")
    return F.when(at == 0, F.size(same)).otherwise(at - 1)


def winnowed_spans(lined: DataFrame, gram: int, window: int) -> DataFrame:
    """Places of the fingerprints that stand earlier, extended both ways: `__rid`, `begin`, `end`."""
    seeds = fingerprints(lined, gram, window)
    place = F.struct("__doc", "__rid", "pos", "before", "after")
    firsts = written(
        seeds.groupBy("g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("g", "first"), "firsts",
    )
    same_place = (F.col("__rid") == F.col("first.__rid")) & (F.col("pos") == F.col("first.pos"))
    later = seeds.join(firsts, "g").filter(~same_place)
    return later.select(
        "__rid", (F.col("pos") - leading_equal(F.col("before"), F.col("first.before"))).alias("begin"),
        (F.col("pos") + gram + leading_equal(F.col("after"), F.col("first.after"))).alias("end"),
    )


def guaranteed(lined: DataFrame, size: int, min_words: int) -> DataFrame:
    """Fingerprints of all runs of `size` lines: `g`, and the runs they were chosen for, extended to their ends.

    Grams of one line less than a run are winnowed: of the two in a run the smaller one is its fingerprint (the last of
    equals), so wherever the run stands, the same gram of it is chosen. A gram that is chosen for the run that ends with
    it and for the one that begins with it is one row. With `min_words`, only runs of so many words are looked at. For
    each run, `offset` is the place of the fingerprint in it and `edge` the hash of the line that extends it.
    """
    gram = max(size - 1, 1)
    count = F.greatest(F.size("__h") - (gram - 1), F.lit(0))
    grams = barrier(lined, __g=F.transform(
        F.slice("__h", F.lit(1), count), lambda h, i: F.xxhash64(F.slice("__h", i + 1, F.lit(gram))) if gram > 1 else h
    ))
    last = F.size("__h") - (size - 1)
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    if min_words:
        starts = F.filter(starts, lambda i: F.aggregate(
            F.slice("__n", i + 1, F.lit(size)), F.lit(0), lambda n, w: n + w
        ) >= min_words)
    second = (lambda i: F.lit(False)) if size == 1 else (lambda i: F.get("__g", i + 1) <= F.get("__g", i))
    runs = F.transform(starts, lambda i: F.struct(
        i.alias("begin"), F.when(second(i), 1).otherwise(0).alias("offset"),
    ))
    each = grams.select("__doc", "__rid", "__h", "__g", F.explode(runs).alias("r"))
    at = F.col("r.begin") + F.col("r.offset")
    edge = F.lit(None).cast("bigint") if size == 1 else F.get(
        "__h", F.when(F.col("r.offset") == 0, F.col("r.begin") + gram).otherwise(F.col("r.begin"))
    )
    return each.select(
        "__doc", "__rid", F.get("__g", at).alias("g"), F.col("r.begin").alias("begin"),
        F.col("r.offset").alias("offset"), edge.alias("edge"), F.lit(size).alias("size"),
    )


def earlier_spans(lined: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """Runs of `min_lines` lines, or fewer with `min_words` words, that one earlier place holds.

    Fingerprints meet where they agree with the line that extends them, so each run is judged against the first place
    that holds all of it, whatever place holds its fingerprint alone. Returns `__rid`, `begin`, `end`. A longer match
    goes on at the next fingerprint: it is the union of these.
    """
    seeds = None
    for size in range(1, min_lines + 1):
        found = guaranteed(lined, size, min_words if size < min_lines else 0)
        seeds = found if seeds is None else seeds.unionByName(found)
    seeds = seeds.withColumn("key", F.xxhash64("size", "offset", "g", "edge"))
    firsts = written(
        seeds.groupBy("key").agg(F.min(F.struct("__doc", "__rid", "begin")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("key", "first.__rid", "first.begin").toDF("key", "first_rid", "first_begin"), "firsts",
    )
    later = seeds.join(firsts, "key").filter("__rid <> first_rid or begin <> first_begin")
    return later.select("__rid", "begin", (F.col("begin") + F.col("size")).alias("end"))


def repeated_runs(spans: DataFrame, min_lines: int) -> DataFrame:
    """Per document `__rid` its `runs` of lines (first, and one past the last, counted among `__h`) to delete.

    What overlaps or touches is one run; shorter ones than `min_lines` stay.
    """
    in_doc = Window.partitionBy("__rid").orderBy("begin", "end")
    upto = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("open", F.coalesce((F.col("begin") > upto).cast("int"), F.lit(1)))
    runs = opened.withColumn("run", F.sum("open").over(in_doc.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "__rid", "run"
    ).agg(F.min("begin").alias("begin"), F.max("end").alias("end")).filter(F.col("end") - F.col("begin") >= min_lines)
    return runs.groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def without_runs(lines: Column, at: Column, runs: Column) -> Column:
    """The text of these lines without those of its runs and the blank lines inside the runs.

    `lines` has to be a column, not an expression: the functions below would split the text again for every run.
    """
    count = F.size(runs)

    def between(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(at, F.get(runs, i - 1)["end"] - 1) + 1)
        end = F.when(i == count, F.size(lines)).otherwise(F.get(at, F.get(runs, i)["begin"]))
        return F.slice(lines, begin + 1, end - begin)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), count), between)), "\n")


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None,
    window: int | None = None, min_lines: int = 3, min_words: int = 50,
) -> DataFrame:
    """Delete runs of lines that an earlier document, or an earlier place of the same one, holds as well.

    Adds `n_lines` (lines with a word) and `n_removed` (of these, how many are gone) and shortens the text.
    Lines are compared without white space at their ends. Hashes of grams of lines are winnowed in windows as wide as
    a run of `min_lines` lines (for runs of `min_words` words or more: of fewer lines), so that each run is guaranteed a
    fingerprint; fingerprints are extended to the ends of their runs, joined to the first place of these in the order of
    ids, and go if that is another one. So exactly the lines of runs of `min_lines` lines or `min_words` words or more
    that one earlier place holds go, and the blank lines between them. Shorter common lines stay.

    With `gram` or `window` the guarantee is another: each `window` of hashes of `gram` successive lines gives its
    smallest, each of these is joined to its own first place and extended both ways from there; what overlaps or
    touches is one run.

    One row per hash is joined to, so a line shared by many documents costs no pairs, and Spark splits it
    when it is hot. A NULL text stays NULL and has no lines; a text that is deleted whole becomes empty; NULL ids
    come first; of equal rows and rows with one id, one in no stated order counts as the first; no rows give no
    rows; input columns named as an added one are replaced.
    """
    clean = without(docs, "n_lines", "n_removed")
    marked = clean.withColumns({"__rid": F.monotonically_increasing_id(), "__doc": F.col(id_col)})
    lined = written(with_lines(marked, text_col), "lines")
    sampled = gram is not None or window is not None
    if sampled:
        runs = repeated_runs(winnowed_spans(lined, gram or 2, window or 2), min_lines)
    else:
        runs = repeated_runs(earlier_spans(lined, min_lines, min_words), 1)
    joined = barrier(lined.join(runs, "__rid", "left"), __split=F.when(F.col("runs").isNotNull(), F.split(F.col(text_col), "\n")))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + (r["end"] - r["begin"]).cast("int"))
    short = F.when(F.col("runs").isNull(), F.col(text_col)).otherwise(
        without_runs(F.col("__split"), F.col("__at"), F.col("runs"))
    )
    return joined.select(
        *[short.alias(c) if c == text_col else F.col(f"`{c}`") for c in clean.columns],
        F.size("__h").cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )
