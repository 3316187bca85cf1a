"""Operators over conversation logs: visibility, windows of messages, progress and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Roles and visibilities that are shown, and the length of the shown window.
SHOWN_ROLES = ("user", "assistant", "tool", "code_execution")
SHOWN_VISIBILITIES = ("all", "ui_only")
LAST_MESSAGES = 15
# Markers replaced in a transcript.
TRANSCRIPT_MARKERS = {"TASK COMPLETED": "✅🎉 Task completed!", "= CONTINUE =": "▶️"}
TRANSCRIPT_SEPARATOR = "\n\n---\n\n"
# The planning agent and the text shown in place of its messages.
PLANNING_AGENT = "coordinator"
PLANNING_TEXT = "💡 `Planning step`"


def visible(df: DataFrame) -> DataFrame:
    """Shown roles with shown visibilities. The exception for ephemeral system messages also requires a shown
    visibility, so it never adds a row; it is not repeated here."""
    return df.where(F.col("visibility").isin(*SHOWN_VISIBILITIES) & F.col("role").isin(*SHOWN_ROLES))


def last_messages(df: DataFrame, n: int = LAST_MESSAGES, by: str = "conv_id", order: str = "turn") -> DataFrame:
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order))))
    return ranked.where(F.col("_r") <= n).drop("_r")


def split_at_last(df: DataFrame, flag: Column, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds ``part``: ``recent`` from the last flagged message on, ``history`` before it or when none is flagged.

    The marker is found by an aggregate and joined back, so a huge conversation is not held in one task.
    """
    marks = df.where(flag).groupBy(by).agg(F.max(order).alias("_mark"))
    return (
        df.join(marks, by, "left")
        .withColumn("part", F.when(F.col(order) >= F.col("_mark"), "recent").otherwise("history"))
        .drop("_mark")
    )


def latest_per_agent(
    df: DataFrame, counts: str, agents: Sequence[str], context_size: int, by: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """``(by, agent, used, share)``: newest known value of a map column per agent, 0 where none is known."""
    cells = df.select(by, order, F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.col(counts)[a].alias("v")) for a in agents])).alias("c"))
    flat = cells.select(by, order, "c.agent", "c.v")
    newest = flat.groupBy(by, "agent").agg(F.max_by(F.col("v"), F.when(F.col("v").isNotNull(), F.col(order))).alias("v"))
    used = F.coalesce("v", F.lit(0))
    return newest.select(by, "agent", used.alias("used"), (used / F.lit(context_size)).alias("share"))


def by_agents(df: DataFrame, agents: str | Sequence[str]) -> DataFrame:
    names = [agents] if isinstance(agents, str) else list(agents)
    return df.where(F.col("agent").isin(*names))


def last_like(df: DataFrame, like: Column, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last message per conversation that meets a condition."""
    others = [c for c in df.columns if c not in (by,)]
    best = df.where(like).groupBy(by).agg(F.max_by(F.struct(*others), F.col(order)).alias("m"))
    return best.select(by, "m.*")


def plan_progress(df: DataFrame, plan: str = "plan", current: str = "current", include_current: bool = True) -> DataFrame:
    """Adds ``completed`` and ``remaining`` step arrays. The marker ``None`` means nothing has started; a step that is
    not part of the plan leaves the whole plan completed, as nothing is found to stop at."""
    steps, now = F.col(plan), F.col(current)
    at = F.array_position(steps, now)
    before = F.when(at > 0, F.slice(steps, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(steps)
    done = F.concat(before, F.array(now)) if include_current else before
    rest = F.filter(steps, lambda s: ~F.array_contains(before, s) & (s != now))
    none = now == F.lit("None")
    return df.withColumns(
        {
            "completed": F.when(none, F.array().cast("array<string>")).otherwise(done),
            "remaining": F.when(none, steps).otherwise(rest),
        }
    )


def transcript(df: DataFrame, by: str = "conv_id", order: str = "turn", turns_per_part: int | None = None) -> DataFrame:
    """``(by, part, transcript)``: messages in order under bold role headings.

    Each conversation is one row, part 0. With ``turns_per_part`` long ones continue in further parts.
    """
    text = F.coalesce("text", F.lit(""))
    for marker, shown in TRANSCRIPT_MARKERS.items():
        text = F.replace(text, F.lit(marker), F.lit(shown))
    if "agent" in df.columns:
        text = F.when(F.col("agent") == PLANNING_AGENT, PLANNING_TEXT).otherwise(text)
    role = F.concat(F.upper(F.left("role", F.lit(1))), F.lower(F.substring("role", 2, 2**31 - 1)))
    entry = F.concat(F.lit("**"), role, F.lit(":**\n\n"), text, F.lit("\n"))
    collected = F.array_sort(F.collect_list(F.struct(F.col(order), entry.alias("entry"))))
    part = (F.lit(0).cast("long") if turns_per_part is None else F.floor(F.col(order) / F.lit(turns_per_part))).alias("part")
    return df.groupBy(by, part).agg(
        F.array_join(F.transform(collected, lambda m: m["entry"]), TRANSCRIPT_SEPARATOR).alias("transcript")
    )
