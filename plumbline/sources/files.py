"""Reading and writing tables: delimited text with type inference, stage outputs, file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import human_size
from plumbline.operators.clean import parses, possible_types
from plumbline.operators.common import q
from plumbline.sources.quoted import read_quoted

# Text that stands for a missing cell in a delimited file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SEPARATORS = (",", ";", "\t", "|")

# Stage suffixes of derived tables.
STAGES = {
    "merged": "_merged",
    "user_columns": "_user_cols",
    "missing_normalised": "_nan",
    "imputed": "_imputed",
    "features_selected": "_selected_features",
    "valued_samples": "_data_valuation_samples",
    "filtered": "_filtered",
}
SUMMARY_SUFFIX = "__descriptive_stats"

# File categories by extension; a model must also be named like one.
FILE_CATEGORIES = {"image": ("png", "jpg", "jpeg"), "data": ("csv",), "model": ("pkl", "pth", "pt", "p")}
MODEL_NAME = r"^model(_[a-zA-Z]+)?"


def read_text_table(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Header row, all columns as text, missing-cell tokens as NULL.

    Quoted cells may hold line breaks, also across the blocks that tasks read; ``multi_line=False`` saves a pass over files that have none.
    """
    raw = read_quoted(spark, paths, sep).drop("file_name") if multi_line else spark.read.csv(paths, sep=sep, header=True, escape='"')
    return raw.select(*[F.when(~q(c).isin(*NA_TOKENS), q(c)).alias(c) for c in raw.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Casts each text column to the narrowest of bigint, double, boolean that fits every value.

    Whole numbers with gaps become double and booleans with gaps stay text, as missing cells have no
    integer or boolean form in the data model. One scan decides, a second one reads.
    """
    return df.select(*[value.alias(c) for c, value in _inferred(df).items()])


def _inferred(df: DataFrame) -> dict[str, Column]:
    likely = possible_types(df, df.columns, ("bigint", "double"))
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(q(c)).alias(f"n{i}"), F.count_if(F.lower(q(c)).isin("true", "false")).alias(f"b{i}")]
        aggs += [F.coalesce(F.bool_and(parses(q(c), kind)), F.lit(True)).alias(f"{kind}{i}") for kind in likely[c]]
    seen = df.agg(*aggs).first().asDict()
    out = {}
    for i, c in enumerate(df.columns):
        n, gaps = seen[f"n{i}"], seen[f"n{i}"] < seen["rows"]
        if n and not gaps and seen.get(f"bigint{i}"):
            out[c] = F.trim(q(c)).cast("bigint")
        elif seen.get(f"double{i}"):
            out[c] = F.trim(q(c)).cast("double")
        elif seen[f"b{i}"] == n and not gaps:
            out[c] = F.lower(q(c)).cast("boolean")
        else:
            out[c] = q(c)
    return out


def read_csv(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    return infer_types(read_text_table(spark, paths, sep, multi_line))


def read_many(spark: SparkSession, paths: Sequence[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Several files in one scan, each row with the ``file_name`` it came from."""
    if multi_line:
        raw = read_quoted(spark, list(paths), sep)
        named = F.col("file_name")
    else:
        raw = spark.read.csv(list(paths), sep=sep, header=True, escape='"')
        named = F.col("_metadata.file_name").alias("file_name")
    cells = [F.when(~q(c).isin(*NA_TOKENS), q(c)).alias(c) for c in raw.columns if not (multi_line and c == "file_name")]
    text = raw.select(*cells, named)
    types = _inferred(text)
    return text.select(*[(F.col(c) if c == "file_name" else v).alias(c) for c, v in types.items()])


def is_loaded(df: DataFrame) -> bool:
    """A load counts only with more than one column and more than one row."""
    return len(df.columns) > 1 and len(df.limit(2).take(2)) > 1


def read_any_separator(spark: SparkSession, path: str, separators: Sequence[str] = SEPARATORS) -> tuple[DataFrame, str]:
    """The first separator under which the file loads; the check reads two rows."""
    for sep in separators:
        if is_loaded(spark.read.csv(path, sep=sep, header=True, escape='"', multiLine=True)):
            return read_csv(spark, path, sep), sep
    raise ValueError(f"no separator of {separators!r} gives more than one column and row")


def stage_path(path: str, stage: str) -> str:
    """``folder/name.csv`` becomes ``folder/name<suffix>.csv``."""
    folder, _, name = path.rpartition("/")
    stem, dot, extension = name.rpartition(".")
    if not dot:
        stem, extension = name, ""
    return (f"{folder}/" if folder else "") + stem + STAGES[stage] + dot + extension


def save_stage(df: DataFrame, path: str, stage: str, fmt: str = "parquet") -> str:
    """Writes under the stage name and never over existing data."""
    target = stage_path(path, stage)
    writer = df.write.mode("errorifexists")
    writer.csv(target, header=True) if fmt == "csv" else writer.format(fmt).save(target)
    return target


def save_summary(table: DataFrame, path: str, fmt: str = "csv") -> str:
    target = f"{path}{SUMMARY_SUFFIX}.{fmt}"
    writer = table.write.mode("overwrite")
    writer.csv(target, header=True) if fmt == "csv" else writer.format(fmt).save(target)
    return target


def save_by_generator(df: DataFrame, path: str, by: Sequence[str] = ("generator",)) -> str:
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return path


def file_category(name: Column) -> Column:
    """image, data, model or other."""
    lowered = F.lower(name)

    def has_extension(kind: str) -> Column:
        return F.rlike(lowered, F.lit(r"\.(" + "|".join(FILE_CATEGORIES[kind]) + ")$"))

    return (
        F.when(has_extension("image"), "image")
        .when(has_extension("data"), "data")
        .when(has_extension("model") & F.rlike(name, F.lit(MODEL_NAME)), "model")
        .otherwise("other")
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, size, unit, bytes, modified, category)``; scripts are left out and no content is read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    name = F.substring_index("path", "/", -1)
    return (
        files.withColumn("name", name)
        .where(~F.endswith("name", F.lit(".py")))
        .withColumn("human", human_size(F.col("length").cast("double")))
        .select(
            "name", F.col("human.size").alias("size"), F.col("human.unit").alias("unit"), F.col("length").alias("bytes"),
            F.col("modificationTime").alias("modified"), file_category(F.col("name")).alias("category"),
        )
    )


def newest_files(files: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    chosen = files if categories is None else files.where(F.col("category").isin(*categories))
    return chosen.orderBy(F.desc("modified"), "name")


def preview(df: DataFrame, order: Sequence[str], rows: int | None = 5) -> DataFrame:
    """The first rows in an explicit order; everything with ``rows=None``."""
    ordered = df.orderBy(*order)
    return ordered if rows is None else ordered.limit(rows)
