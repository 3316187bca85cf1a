"""Generate, evaluate and report synthetic tables in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import balance, metrics, models, synth
from plumbline.operators.common import union_all
from plumbline.session import materialize


@dataclass
class GenerationReport:
    """``outputs``: ``(generator, repeat, syn_id, columns...)``; ``scores``: mean, deviation and range of each metric over the repeats,
    with the ground truth of performance metrics under generator ``gt``; ``augmentation``: rows that even out the fairness column, or None."""

    outputs: DataFrame
    scores: DataFrame
    augmentation: DataFrame | None


def generation_report(
    df: DataFrame, key: str, methods: str | Sequence[str], count: int | None = None, repeats: int = synth.REPEATS, options: dict[str, dict] | None = None,
    target: str | None = None, test: DataFrame | None = None, task: str = "classification", fairness: str | None = None, quasi: Sequence[str] = (),
    sensitive: str | None = None, existing: DataFrame | None = None, seed: int = 0,
) -> GenerationReport:
    """Sanity, fidelity and privacy of every output against ``df``; with ``target`` and a held-out ``test`` table also what models learn from it.

    ``existing`` takes the place of generating: outputs of an earlier call. With ``fairness`` the first method fills the smaller groups
    of that column, and with ``target`` the gain from the added rows is scored too.
    """
    names = synth.method_names(methods)
    made = existing if existing is not None else materialize(synth.generate(df, names, count, repeats, [key], options))
    runs = sorted((r["generator"], r["repeat"]) for r in made.select("generator", "repeat").distinct().collect())
    parts = []
    for generator, repeat in runs:
        own = materialize(made.where((F.col("generator") == generator) & (F.col("repeat") == repeat)).drop("generator", "repeat").withColumnRenamed(synth.ID, key))
        found = metrics.evaluate(df, own.select(*df.columns), key, quasi=quasi, sensitive=sensitive)
        parts.append(found.select(F.lit(generator).alias("generator"), F.lit(repeat).alias("repeat"), "family", "metric", "value"))
        if target is not None and test is not None:
            learnt = models.performance(df, own.select(*df.columns), test, target, task, [key], seed)
            parts += _columns(learnt, {"gt": "gt", "syn": generator}, repeat)
    extra = None
    if fairness is not None:
        chosen = names[0] if names else runs[0][0]
        extra = materialize(balance.fairness_augmentation(df.drop(key), fairness, synth.group_generator(chosen, **(options or {}).get(chosen, {})), seed))
        if target is not None and test is not None:
            gained = models.augmentation_performance(df, extra, test, target, task, [key], seed)
            parts += _columns(gained, {"gt": "gt", "augmented": chosen}, 0)
    return GenerationReport(made, metrics.score_table(union_all(parts)), extra)


def _columns(table: DataFrame, generators: dict[str, str], repeat: int) -> list[DataFrame]:
    return [table.select(F.lit(g).alias("generator"), F.lit(repeat).alias("repeat"), F.lit("performance").alias("family"), "metric", F.col(c).cast("double").alias("value")) for c, g in generators.items()]
