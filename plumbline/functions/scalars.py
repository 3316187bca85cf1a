"""Column expressions: number formats, slugs, truncation, log filtering and fenced-block extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a size ladder in steps of 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")

# A log line holding any of these is noise.
NOISE_MARKERS = (
    "FutureWarning:",
    "`sparse` was renamed",
    "elementwise comparison failed;",
    "UserWarning:",
    "The least populated class in y has only 1 members",
    "RuntimeWarning:",
    "divide by zero encountered",
    "'multi_class' was deprecated",
)

# Fixed value: longest log text that is kept whole.
MAX_LOG_CHARS = 300

# Names of the fenced blocks, and the single entry that stands for "no dependencies".
BLOCKS = ("DEPENDENCIES", "CODE", "FILES_IN", "FILES_OUT")
NO_DEPENDENCY_WORDS = ("", "none", "no", "nothing", "no dependencies")
DEPENDENCY_PATTERN = "^[a-zA-Z0-9_-]+$"


def decimals_for_figures(x: Column, figures: int = 3) -> Column:
    """Decimals that show ``x`` with the given number of significant figures; none for zero."""
    return F.when(x == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(figures - 1) - F.floor(F.log10(F.abs(x))), F.lit(0)).cast("int")
    )


def safe_name(s: Column, remove_slashes: bool = False) -> Column:
    """A name safe for files and columns: anything but letters, digits, ``_`` and ``.`` becomes ``-``.

    A path separator is dropped on request and is an error otherwise.
    """
    if remove_slashes:
        s = F.translate(s, "/\\", "")
    else:
        s = F.when(F.contains(s, F.lit("/")) | F.contains(s, F.lit("\\")), F.raise_error(F.lit("path separator in name"))).otherwise(s)
    return F.regexp_replace(s, r"[^.\p{L}\p{N}_]", "-")


def replace_all(s: Column, pairs: Mapping[str, object]) -> Column:
    """Literal replacements, applied in the order given."""
    for key, value in pairs.items():
        s = F.replace(s, F.lit(key), F.lit(str(value)))
    return s


def human_size(size: Column) -> Column:
    """``struct(size, unit)`` in steps of 1024, largest unit PB."""
    step = F.least(
        F.lit(len(SIZE_UNITS) - 1),
        F.aggregate(
            F.sequence(F.lit(1), F.lit(len(SIZE_UNITS) - 1)),
            F.lit(0),
            lambda acc, i: acc + F.when(size >= F.pow(F.lit(1024.0), i), 1).otherwise(0),
        ),
    )
    return F.struct(
        (size / F.pow(F.lit(1024.0), step)).alias("size"),
        F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), step + 1).alias("unit"),
    )


def drop_noise(text: Column, markers: Sequence[str] = NOISE_MARKERS) -> Column:
    """Removes the lines that hold a marker."""

    def clean(line: Column) -> Column:
        keep = F.lit(True)
        for marker in markers:
            keep = keep & ~F.contains(line, F.lit(marker))
        return keep

    return F.array_join(F.filter(F.split(text, "\n", -1), clean), "\n")


def cut_middle(text: Column, limit: int = MAX_LOG_CHARS) -> Column:
    """Text longer than ``limit`` keeps its two halves around an ellipsis line."""
    half = limit // 2
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))
    ).otherwise(text)


def strip(text: Column) -> Column:
    """Drops white space of any kind, line breaks included, from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fenced_blocks(text: Column, none_words: Sequence[str] = NO_DEPENDENCY_WORDS) -> Column:
    """``struct(dependencies, code, files_in, files_out, error)`` from a text with four fenced blocks.

    The first problem found is reported in ``error``: a missing block, a bad dependency name, empty code.
    """
    body = {
        name: F.regexp_extract(text, f"(?s){name}:\\n```{'python' + chr(92) + 'n' if name == 'CODE' else ''}(.*?)```", 1)
        for name in BLOCKS
    }
    found = {
        name: F.rlike(text, F.lit(f"(?s){name}:\\n```{'python' + chr(92) + 'n' if name == 'CODE' else ''}.*?```"))
        for name in BLOCKS
    }

    def lines(name: str) -> Column:
        return F.filter(F.transform(F.split(body[name], "\n", -1), strip), lambda s: s != "")

    dependencies = F.filter(
        F.transform(F.split(body["DEPENDENCIES"], "\n", -1), lambda s: strip(F.replace(s, F.lit("pip install"), F.lit("")))),
        lambda s: s != "",
    )
    bad = F.filter(dependencies, lambda s: ~F.rlike(s, F.lit(DEPENDENCY_PATTERN)))
    no_dependencies = (F.size(dependencies) == 1) & F.lower(F.get(dependencies, F.lit(0))).isin(*none_words)
    error = F.lit(None).cast("string")
    error = F.when(strip(body["CODE"]) == "", "code block is empty").otherwise(error)
    error = F.when(F.size(bad) > 0, F.concat(F.lit("bad dependency name: "), F.get(bad, F.lit(0)))).otherwise(error)
    for name in ("FILES_OUT", "FILES_IN", "CODE", "DEPENDENCIES"):
        error = F.when(~found[name], f"no {name} block").otherwise(error)
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(no_dependencies, empty).otherwise(dependencies).alias("dependencies"),
        strip(body["CODE"]).alias("code"),
        lines("FILES_IN").alias("files_in"),
        lines("FILES_OUT").alias("files_out"),
        error.alias("error"),
    )
