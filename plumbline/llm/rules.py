"""Quality rules whose limits come from quantile sketches per language and source.

The sketch of a group is a histogram over numbers cut to three significant digits: sketches merge by adding counts, in any order,
and a quantile is off by less than one percent. Groups that are too small use the merged sketch of their language, or of all.
A limit lies a few widths beyond the median, and widths are distances between quantiles of the sketch: no limit is a constant. Only
chance is allowed for beside it: a few symbols, repeated lines or repeated words in any text, and the spread of a mean of few words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BLANK_CHARS, BLANKS, Scratch, columns, small_side

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
LEAST_DOCS = 30  # a smaller group uses the sketch of the next level
FENCE = 4  # widths beyond the median
# metric: percent of the sketch that ends the width above the median, and that below it (None: no lower limit)
METRICS = {"symbols": (75, None), "dup_lines": (90, None), "repeats": (90, None), "word_length": (75, 25)}
# metric: its count, what that is a share of, and the count that is left out of the share as chance
COUNTS = {"symbols": ("n_symbols", "word_chars", 5), "dup_lines": ("n_dup_lines", "n_lines", 5), "repeats": ("n_repeat_words", "n_words", 36)}
SPREAD = 1000  # four deviations of a word's length, in hundredths of a character; divided by the root of the number of words


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``, all from the whole text.

    Words of 3-word windows are compared by a 64-bit hash. Null and blank texts have zeros. The input should hold no other
    columns of these names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns(
        {
            "_w": F.filter(F.split(body, BLANKS), lambda w: w != ""),
            "_l": F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0),
            "word_chars": F.length(F.translate(body, BLANK_CHARS, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    )
    w = F.col("_w")
    window = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    step = step.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        window.alias("_h"),
    ).drop("_w", "_l")
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])))
    step = step.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("_s")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(F.when(p.isNotNull(), covered), F.lit(0).cast("long"))).drop("_p")


def _cut(x: Column) -> Column:
    """Rounded down to three significant digits."""
    unit = F.when(x < 1000, 1).otherwise(F.pow(F.lit(10.0), F.length(x.cast("string")) - 3).cast("long"))
    return x - x % unit


def _ratio(part: str, whole: str, unit: int, free: int = 0) -> Column:
    return F.when(F.col(whole) > 0, F.floor(unit * F.greatest(F.col(part) - free, F.lit(0)) / F.col(whole))).otherwise(0).cast("long")


def metric_columns() -> dict[str, Column]:
    """The metrics from the measures: parts per thousand, and hundredths of a character."""
    return {
        **{m: _ratio(part, whole, 1000) for m, (part, whole, _) in COUNTS.items()},
        "word_length": _ratio("word_chars", "n_words", 100),
    }


def quality_sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, metric, bucket, n)``: one mergeable sketch per language, source and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), _cut(F.col(m)).alias("bucket")) for m in METRICS])
    return measured.select("lang", "source", F.inline(cells)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def sketch_limits(sketches: DataFrame, keys: list[str], fence: int = FENCE) -> DataFrame:
    """Per ``keys`` the documents and, as ``<metric>_low`` / ``<metric>_high``, the limits of each metric."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "metric")
    merged = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("total", F.sum("n").over(own))
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket"))).alias(f"q{percent}")
    quantiles = merged.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[at(p) for p in (25, 50, 75, 90)])
    wide = []
    for m, (above, below) in METRICS.items():
        pick = lambda c, m=m: F.max(F.when(F.col("metric") == m, c))
        wide.append(pick(F.col("q50") + fence * (F.col(f"q{above}") - F.col("q50"))).alias(f"{m}_high"))
        if below is not None:
            wide.append(pick(F.col("q50") - fence * (F.col("q50") - F.col(f"q{below}"))).alias(f"{m}_low"))
    return quantiles.groupBy(*keys).agg(F.max("total").alias("group_docs"), *wide)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", fence: int = FENCE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of ``docs``: the measures, ``base_failed``, ``kept`` and the size of the group that gave the limits.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. The others are kept if each ratio lies
    within ``fence`` widths of the median of its group or of its language, whichever is wider; ``METRICS`` names the quantiles that end a width. What ``COUNTS`` allows any text
    is no part of its ratio, and the limits of the mean word length widen for texts of few words. Null languages and sources are groups of their own. Null and empty texts fail. Sketches hold the documents that did not fail.
    """
    limits = [f"{m}_{side}" for m, (_, below) in METRICS.items() for side in (("high", "low") if below is not None else ("high",))]
    with Scratch(docs.sparkSession) as scratch:
        given = columns(docs, doc_id=doc_id, text=text, lang=lang, source=source)
        measured = text_measures(given).drop("text")
        failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
        measured = scratch.keep(measured.withColumns(metric_columns()).withColumn("base_failed", failed), release=True)
        sketches = scratch.keep(quality_sketches(measured.where("not base_failed")))
        levels = []
        for keys in (["lang", "source"], ["lang"]):
            level = sketch_limits(sketches, keys, fence).where(F.col("group_docs") >= least_docs)
            level = scratch.keep(level.select(*[F.col(x).alias(f"{x}_{len(keys)}") for x in keys], F.struct("group_docs", *limits).alias(f"limits_{len(keys)}")), release=True)
            levels.append((keys, small_side(level, level.count(), 160)))
        whole = sketch_limits(sketches.withColumn("all", F.lit(1)), ["all"], fence).select("group_docs", *limits).first()
    out = measured
    for keys, level in levels:
        on = measured["lang"].eqNullSafe(level[f"lang_{len(keys)}"])
        if len(keys) == 2:
            on &= measured["source"].eqNullSafe(level[f"source_{len(keys)}"])
        out = out.join(level, on, "left")
    last = {x: F.lit(whole[x] if whole else None).cast("long") for x in ["group_docs", *limits]}

    def limit(name: str) -> Column:
        wider = F.greatest if name.endswith("_high") else F.least  # they pass over nulls
        return F.coalesce(wider(F.col(f"limits_2.{name}"), F.col(f"limits_1.{name}")), last[name]).alias(name)

    group_docs = F.coalesce("limits_2.group_docs", "limits_1.group_docs", last["group_docs"]).alias("group_docs")
    out = out.withColumn("limits", F.struct(group_docs, *[limit(x) for x in limits]))
    fits = F.lit(True)
    spread = F.floor(F.lit(SPREAD) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    for m, (_, below) in METRICS.items():
        value, chance = (_ratio(*COUNTS[m][:2], 1000, COUNTS[m][2]), F.lit(0)) if m in COUNTS else (F.col(m), spread)
        fits &= value <= F.col(f"limits.{m}_high") + chance
        if below is not None:
            fits &= value >= F.col(f"limits.{m}_low") - chance
    kept = ~F.col("base_failed") & F.coalesce(fits, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("limits.group_docs").alias("group_docs"))
