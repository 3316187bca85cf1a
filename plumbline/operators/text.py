"""Categorical features from free text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.common import q

FOUND, NOT_FOUND = "yes", "no"


def mentions(text: Column, synonyms: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any synonym; short forms match inside longer words."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(s.lower())) for s in synonyms])


def topic_features(df: DataFrame, topics: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Adds one ``<column>_<topic>`` yes/no column per topic of ``{column: {topic: [synonyms]}}``; null text stays null."""
    added = {}
    for column, by_topic in topics.items():
        for topic, synonyms in by_topic.items():
            found = mentions(q(column), synonyms)
            added[f"{column}_{topic}"] = F.when(found, FOUND).when(~found, NOT_FOUND)
    return df.withColumns(added)
