"""Class balancing and fairness augmentation. Class sizes come from one count; which rows stay or repeat is
decided by a hash of the key against a per-class cut, so no class is ever sorted in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.common import constants, q, union_all
from plumbline.operators.neighbours import as_vector, knn, min_max
from plumbline.operators.ranks import running

MAX_CLASSES = 1000


def class_table(df: DataFrame, target: str) -> DataFrame:
    """``(_class, n)`` of the known classes."""
    return df.where(q(target).isNotNull()).groupBy(q(target).alias("_class")).agg(F.count("*").alias("n"))


def class_sizes(df: DataFrame, target: str) -> dict:
    """Rows per class on the driver, for operators that run a job per class: more than ``MAX_CLASSES`` are refused."""
    rows = class_table(df, target).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return {r["_class"]: r["n"] for r in rows}


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), q(key))


def uniform(seed: int, *keys: Column | str) -> Column:
    """Repeatable number in [0, 1) from the keys."""
    mixed = F.xxhash64(F.lit(seed), *[q(k) if isinstance(k, str) else k for k in keys])
    return F.pmod(mixed, F.lit(2**53)) / F.lit(float(2**53))


def _cuts(df: DataFrame, target: str, key: str, take: DataFrame, seed: int) -> DataFrame:
    """Per class the largest ``(hash, key)`` among its ``_take`` smallest: one row per class."""
    narrow = df.select(q(target).alias("_class"), _hash(key, seed).alias("_h"), q(key).alias("_key"), F.lit(1).alias("_one"))
    narrow = narrow.join(take.select("_class", "_take"), "_class")
    ordered = running(narrow, ["_class"], ["_h", "_key"], ["_one"])
    inside = ordered.where(F.col("cum__one") <= F.col("_take"))
    return inside.groupBy("_class").agg(F.max(F.struct("_h", "_key")).alias("_cut"))


def _mark(df: DataFrame, target: str, key: str, take: DataFrame, seed: int) -> DataFrame:
    """Adds ``_in``: whether the row is among the ``_take`` smallest hashes of its class."""
    here = F.struct(_hash(key, seed).alias("_h"), q(key).alias("_key"))
    marked = df.join(_cuts(df, target, key, take, seed), q(target) == F.col("_class"), "left")
    return marked.withColumn("_in", F.coalesce(here <= F.col("_cut"), F.lit(False))).drop("_class", "_cut")


def undersample(df: DataFrame, target: str, key: str, size: int | None = None, seed: int = 0) -> DataFrame:
    """Every class cut to ``size`` rows, by default to the smallest class."""
    sizes = class_table(df, target)
    size = sizes.agg(F.min("n")).first()[0] if size is None else size
    take = sizes.withColumn("_take", F.least("n", F.lit(size)))
    return _mark(df, target, key, take, seed).where("_in").drop("_in")


def oversample(df: DataFrame, target: str, key: str, size: int | None = None, seed: int = 0) -> DataFrame:
    """Every class repeated up to ``size`` rows, by default to the largest class. Copies are spread evenly."""
    sizes = class_table(df, target)
    size = sizes.agg(F.max("n")).first()[0] if size is None else size
    wanted = F.greatest("n", F.lit(size))
    marked = _mark(df, target, key, sizes.withColumn("_take", wanted % F.col("n")), seed)
    return _repeated(marked, target, sizes.withColumn("_times", F.floor(wanted / F.col("n")).cast("int"))).drop("_in", "_copy")


def _repeated(marked: DataFrame, target: str, times: DataFrame) -> DataFrame:
    """Repeats each row ``_times`` of its class, once more where ``_in``; ``_copy`` numbers the copies from 1."""
    joined = marked.join(times.select("_class", "_times"), q(target) == F.col("_class"))
    copies = F.col("_times") + F.col("_in").cast("int")
    numbered = F.explode(F.filter(F.sequence(F.lit(0), copies), lambda i: i > 0))
    return joined.withColumn("_copy", numbered).drop("_class", "_times")


def smote(
    df: DataFrame, target: str, key: str, features: Sequence[str], size: int | None = None, k: int = 5, seed: int = 0
) -> DataFrame:
    """The table plus synthetic rows that bring every class to ``size`` (Chawla et al. 2002).

    A synthetic row lies on the segment from a row to one of its ``k`` nearest neighbours of the same class. Other
    columns come from the starting row, the key is null, and ``is_synthetic`` tells the rows apart.
    """
    sizes = class_sizes(df, target)
    size = max(sizes.values()) if size is None else size
    scale = min_max(df, features)
    parts = [df.withColumn("is_synthetic", F.lit(False))]
    for label, n in sorted(sizes.items(), key=lambda item: str(item[0])):
        missing = size - n
        if missing <= 0:
            continue
        if n < 2:
            raise ValueError(f"class {label!r} has a single row, no neighbour to interpolate with")
        own = df.where(q(target) == F.lit(label))
        vectors = own.select(q(key).alias("id"), as_vector(features, scale).alias("vector"))
        near = knn(vectors, vectors, min(k, n - 1), skip_same_id=True)
        options = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "base_id"))).alias("_near"))
        part = constants(df, [(label, missing % n, missing // n)], ["_class", "_take", "_times"], [df.schema[target].dataType.simpleString(), "long", "int"])
        copies = _repeated(_mark(own, target, key, part, seed), target, part).join(options, q(key) == F.col("query_id"))
        pick = F.floor(uniform(seed + 1, key, F.col("_copy")) * F.size("_near")).cast("int")
        other = own.select(q(key).alias("_other"), *[q(c).cast("double").alias(f"_o_{c}") for c in features])
        joined = copies.withColumn("_other", F.get("_near", pick)["base_id"]).join(other, "_other")
        gap = uniform(seed + 2, key, F.col("_copy"))
        types = dict(df.dtypes)
        moved = {c: (q(c) + gap * (F.col(f"_o_{c}") - q(c))).cast("double") for c in features}
        moved[key] = F.lit(None).cast(types[key])
        made = joined.withColumns(moved).select(*df.columns).withColumn("is_synthetic", F.lit(True))
        parts.append(made)
    widened = parts[0].withColumns({c: q(c).cast("double") for c in features})
    return union_all([widened, *parts[1:]])


def combine(
    df: DataFrame, target: str, key: str, features: Sequence[str], size: int | None = None, k: int = 5, seed: int = 0
) -> DataFrame:
    """Classes above the common size are cut, classes below it are filled by ``smote``; the default size is the mean."""
    sizes = class_sizes(df, target)
    size = round(sum(sizes.values()) / len(sizes)) if size is None else size
    return smote(undersample(df, target, key, size, seed), target, key, features, size, k, seed)


def fairness_augmentation(
    df: DataFrame, column: str, generate: Callable[[DataFrame, int, int], DataFrame], seed: int = 0
) -> DataFrame:
    """Synthetic rows that bring every group of ``column`` to the size of the largest.

    ``generate(rows_of_group, n, seed)`` makes ``n`` rows like those of one group; the group value is set on them.
    """
    sizes = class_sizes(df, column)
    top = max(sizes.values())
    parts = []
    for i, (value, n) in enumerate(sorted(sizes.items(), key=lambda item: str(item[0]))):
        if n < top:
            made = generate(df.where(q(column) == F.lit(value)), top - n, seed + i)
            parts.append(made.withColumn(column, F.lit(value).cast(df.schema[column].dataType)))
    if not parts:
        return df.limit(0)
    return union_all([p.select(*[q(c) for c in df.columns if c in p.columns]) for p in parts])


def augmented(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Real rows with the augmentation rows below them."""
    return df.unionByName(extra, allowMissingColumns=True)
