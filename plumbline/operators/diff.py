"""Comparison of two versions of a table, down to the cell.

With a key, both versions are joined once. Without one, every distinct after-row is paired with the most
similar before-row by "leave cells out" keys: two rows with at most ``m`` different cells agree exactly once
some ``m`` columns are left out. Before-rows are reduced to one representative per key ahead of the
join, so the join is one-to-many on a unique key and no group of look-alikes is ever multiplied out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators.common import constants, join_on, q, union_all
from plumbline.operators.ranks import running
from plumbline.session import broadcast_bytes, materialize

SIMILARITY = 0.8
MAX_KEY_FAMILIES = 5000  # keys that leave single cells out, per row; beyond, groups of columns are left out
GROUP_FAMILIES = 100
ARROW = " → "


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(column, change)`` with change one of removed, added, common."""
    rows = [(c, "removed") for c in before.columns if c not in after.columns]
    rows += [(c, "added") for c in after.columns if c not in before.columns]
    rows += [(c, "common") for c in before.columns if c in after.columns]
    return constants(before, rows, ["column", "change"], ["string", "string"])


def _common(before: DataFrame, after: DataFrame, key: Sequence[str] = ()) -> list[str]:
    return [c for c in before.columns if c in after.columns and c not in key]


def exact_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows present in both versions, nulls equal, over the common columns."""
    columns = [q(c) for c in _common(before, after)]
    return before.select(*columns).intersect(after.select(*columns))


def _keyed(before: DataFrame, after: DataFrame, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Full outer join on the key; cells as ``b`` and ``a`` structs, null when the row is absent.

    NULL equals NULL in a key. Rows that repeat a key are numbered in the order of their cells and matched by number, so a
    table compared with itself has no changes and no key is multiplied out. Keys that do not repeat need no number; equal rows
    of the others are collapsed before they are numbered, and a key of many rows is numbered across tasks.
    """
    common = _common(before, after, key)

    def side(frame: DataFrame, name: str) -> DataFrame:
        numbered = _numbered(frame.select(*[q(c) for c in (*key, *common)]), key, common)
        return numbered.select(*[q(k) for k in key], F.struct(*[q(c) for c in common], F.lit(True).alias("_here")).alias(name), "_copy")

    return join_on(side(before, "b"), side(after, "a"), [*key, "_copy"], "full_outer").drop("_copy"), common


def _numbered(frame: DataFrame, key: Sequence[str], common: Sequence[str]) -> DataFrame:
    """``frame`` with ``_copy``: the place of a row among those of its key, in the order of their cells."""
    one = F.lit(1).cast("long").alias("_copy")
    repeated = materialize(frame.groupBy(*[q(k) for k in key]).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    n = repeated.count()
    if not n:
        return frame.select("*", one)
    if n * 64 * len(key) <= broadcast_bytes(frame.sparkSession):
        repeated = F.broadcast(repeated)
    names = {**{k: f"k{i}" for i, k in enumerate(key)}, **{c: f"c{i}" for i, c in enumerate(common)}}
    several = join_on(frame, repeated, key, "left_semi").select(*[q(old).alias(new) for old, new in names.items()])
    by, order = [names[k] for k in key], [names[c] for c in common]
    several = materialize(several.groupBy(*by, *order).agg(F.count("*").alias("n"))) if order else materialize(several.groupBy(*by).agg(F.count("*").alias("n")).withColumn("o", F.lit(0)))
    placed = running(several, by, order or ["o"], ["n"], upper_bound=several.count())
    copies = F.explode(F.sequence(F.col("cum_n") - F.col("n") + 1, F.col("cum_n"))).alias("_copy")
    back = placed.select(*[F.col(new).alias(old) for old, new in names.items()], copies)
    return join_on(frame, repeated, key, "left_anti").select("*", one).unionByName(back)


def _cell(side: str, c: str) -> Column:
    return F.col(side).getField(c)


def imputed_rows(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present in both whose only changes, if any, are null to value; with the number of filled cells."""
    joined, common = _keyed(before, after, key)
    both = joined.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    ok = [_cell("a", c).eqNullSafe(_cell("b", c)) | _cell("b", c).isNull() for c in common]
    filled = [(_cell("b", c).isNull() & _cell("a", c).isNotNull()).cast("int") for c in common]
    return both.where(reduce(lambda x, y: x & y, ok)).select(*key, reduce(lambda x, y: x + y, filled).alias("filled"))


def row_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key..., change, similarity)`` for removed, added and modified rows."""
    joined, common = _keyed(before, after, key)
    equal = reduce(lambda x, y: x + y, [_cell("a", c).eqNullSafe(_cell("b", c)).cast("int") for c in common])
    similarity = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), equal / F.lit(len(common)))
    change = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("modified")
    found = joined.select(*key, change.alias("change"), similarity.alias("similarity"))
    return found.where((F.col("change") != "modified") | (F.col("similarity") < 1))


def cell_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key..., column, before, after, text)`` for every changed cell of a row present in both."""
    joined, common = _keyed(before, after, key)
    both = joined.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return _changed_cells(both, list(key), common)


def _changed_cells(both: DataFrame, key: Sequence[str], common: Sequence[str]) -> DataFrame:
    cells = F.array_compact(
        F.array(
            *[
                F.when(
                    ~_cell("a", c).eqNullSafe(_cell("b", c)),
                    F.struct(
                        F.lit(c).alias("column"),
                        _cell("b", c).cast("string").alias("before"),
                        _cell("a", c).cast("string").alias("after"),
                    ),
                )
                for c in common
            ]
        )
    )
    shown = F.concat(F.coalesce("before", F.lit("None")), F.lit(ARROW), F.coalesce("after", F.lit("None")))
    return both.select(*key, F.inline(cells)).withColumn("text", shown)


def summary(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(change, n)`` for rows and columns in one table."""
    rows = row_changes(before, after, key).groupBy("change").agg(F.count("*").alias("n"))
    columns = column_changes(before, after).groupBy("change").agg(F.count("*").alias("n"))
    return rows.select(F.concat(F.lit("rows "), "change").alias("change"), "n").unionByName(
        columns.select(F.concat(F.lit("columns "), "change").alias("change"), "n")
    )


def allowed_changes(columns: int, threshold: float) -> int:
    """Most cells in which two rows may differ while their share of equal cells stays above ``threshold``."""
    m = 0
    while (columns - m - 1) / columns > threshold:
        m += 1
    return m


def similar_rows(before: DataFrame, after: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(a, b, different)``: each distinct after-row with its most similar distinct before-row, if above ``threshold``.

    Ties go to the smallest before-row. Narrow tables match on keys that leave single cells out; wide ones, which would need too
    many such keys, leave out groups of columns and count the equal cells of each pair found. Both are exact.
    """
    common = _common(before, after)
    m = allowed_changes(len(common), threshold)
    families = sum(comb(len(common), j) for j in range(m + 1))
    b = before.select(*[q(c) for c in common]).distinct()
    a = after.select(*[q(c) for c in common]).distinct()
    if families > MAX_KEY_FAMILIES:
        return _similar_by_groups(b, a, common, m)

    left_out = ";".join(
        ",".join(map(str, cells)) for j in range(m + 1) for cells in combinations(range(len(common)), j)
    )

    def keyed(frame: DataFrame, side: str) -> DataFrame:
        """One row per family: the cells that are left out, and the row with those cells blanked."""
        whole = F.struct(*[q(c) for c in common]).alias(side)
        families = frame.select(whole, F.explode(F.split(F.lit(left_out), ";")).alias("family"))
        blank = families.withColumn("_out", F.filter(F.split("family", ","), lambda i: i != "").cast("array<int>"))
        cells = [
            F.when(~F.array_contains("_out", F.lit(i)), F.col(side).getField(c)).alias(f"k{i}") for i, c in enumerate(common)
        ]
        return blank.select(side, "family", F.size("_out").alias("different"), *cells)

    keys = ["family", "different", *[f"k{i}" for i in range(len(common))]]
    representative = keyed(b, "b").groupBy(*keys).agg(F.min("b").alias("b"))
    left, right = keyed(a, "a").alias("x"), representative.alias("y")
    same = reduce(
        lambda s, t: s & t, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys if k != "different"]
    )
    candidates = left.join(right, same).select("x.a", "x.different", "y.b")
    best = candidates.groupBy("a").agg(F.min(F.struct("different", "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"), F.col("m.different").alias("different"))


def _similar_by_groups(b: DataFrame, a: DataFrame, common: Sequence[str], m: int) -> DataFrame:
    """Rows with at most ``m`` different cells agree on all but ``m`` of any groups of columns.

    Each row gets one hashed key per choice of groups left out; only hashes and row digests are shuffled, and the pairs that share a
    key are compared once. Keys that many rows share make many pairs: rows alike in most columns need a key of their own.
    """
    groups = max(g for g in range(m + 1, len(common) + 1) if comb(g, m) <= GROUP_FAMILIES or g == m + 1)
    left_out = [set(x) for x in combinations(range(groups), m)]
    members = [[q(c) for c in common[g::groups]] for g in range(groups)]

    def keyed(frame: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[q(c) for c in common])
        # a flag per cell keeps NULL apart from a value that hashes like it
        hashed = [F.xxhash64(*cells, *[c.isNull() for c in cells]) for cells in members]
        placed = frame.select(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias(side), *[h.alias(f"g{g}") for g, h in enumerate(hashed)])
        keys = [F.struct(F.lit(f).alias("family"), F.xxhash64(*[f"g{g}" for g in range(groups) if g not in out]).alias("key")) for f, out in enumerate(left_out)]
        return placed.select(side, F.inline(F.array(*keys)))

    pairs = keyed(b, "b_id").join(keyed(a, "a_id"), ["family", "key"]).select("a_id", "b_id").distinct()

    def whole(frame: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[q(c) for c in common])
        return frame.select(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias(f"{side}_id"), row.alias(side))

    cells = [(~F.col("a").getField(c).eqNullSafe(F.col("b").getField(c))).cast("int") for c in common]
    compared = pairs.join(whole(a, "a"), "a_id").join(whole(b, "b"), "b_id").select("a", "b", reduce(lambda x, y: x + y, cells).alias("different"))
    best = compared.where(F.col("different") <= m).groupBy("a").agg(F.min(F.struct("different", "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"), F.col("m.different").alias("different"))


def keyless_diff(before: DataFrame, after: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(change, row, column, text)``: removed and added distinct rows, and the changed cells of paired rows."""
    common = _common(before, after)
    pairs = similar_rows(before, after, threshold)
    b = before.select(F.struct(*[q(c) for c in common]).alias("row")).distinct()
    a = after.select(F.struct(*[q(c) for c in common]).alias("row")).distinct()

    def uncovered(rows: DataFrame, side: str) -> DataFrame:
        covered = pairs.select(F.col(side).alias("covered")).distinct()
        return rows.join(covered, F.col("row").eqNullSafe(F.col("covered")), "left_anti")

    def listed(rows: DataFrame, change: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(F.lit(change).alias("change"), "row", none.alias("column"), none.alias("text"))

    cells = _changed_cells(pairs.where(F.col("different") > 0), ["a"], common)
    modified = cells.select(F.lit("modified").alias("change"), F.col("a").alias("row"), "column", "text")
    return union_all([listed(uncovered(b, "b"), "removed"), listed(uncovered(a, "a"), "added"), modified])


def lineage(messages: DataFrame, files: DataFrame) -> DataFrame:
    """``(key, file_in, file_out)``, latest first: messages with one CSV in and one CSV out that still exist.

    ``messages`` has ``key, files_in, files_out``; ``files`` has ``name``.
    """
    edges = messages.where(
        (F.size("files_in") == 1)
        & (F.size("files_out") == 1)
        & F.contains(F.get("files_in", F.lit(0)), F.lit(".csv"))
        & F.contains(F.get("files_out", F.lit(0)), F.lit(".csv"))
    ).select("key", F.get("files_in", F.lit(0)).alias("file_in"), F.get("files_out", F.lit(0)).alias("file_out"))
    existing = files.select("name").distinct()
    return (
        edges.join(existing.withColumnRenamed("name", "file_in"), "file_in", "left_semi")
        .join(existing.withColumnRenamed("name", "file_out"), "file_out", "left_semi")
        .select("key", "file_in", "file_out")
        .orderBy(F.desc("key"))
    )
