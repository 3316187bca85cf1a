"""Differential privacy: noise from a source that no caller can repeat, and a ledger of what was spent."""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def secret_source() -> np.random.Generator:
    """Random numbers seeded by the operating system; the seed is kept nowhere."""
    return np.random.default_rng(secrets.randbits(256))


@dataclass
class Budget:
    """What private releases of one table have spent, in order; beyond ``epsilon`` or ``delta`` (if given) spending raises.

    Spends add up (sequential composition). Give one ledger to all generators and repeats that read the same table.
    """

    epsilon: float | None = None
    delta: float | None = None
    spends: list[tuple[str, str, float, float]] = field(default_factory=list)
    release: str = ""

    def spend(self, purpose: str, epsilon: float, delta: float = 0.0) -> None:
        if not epsilon > 0 or delta < 0:
            raise ValueError("a private release must spend a positive epsilon")
        total, loose = self.spent
        for name, most, now in (("epsilon", self.epsilon, total + epsilon), ("delta", self.delta, loose + delta)):
            if most is not None and now > most * (1 + 1e-9):
                raise ValueError(f"{purpose} would bring {name} to {now:.6g}, beyond the budget of {most:.6g}")
        self.spends.append((self.release, purpose, float(epsilon), float(delta)))

    @property
    def spent(self) -> tuple[float, float]:
        return math.fsum(x[2] for x in self.spends), math.fsum(x[3] for x in self.spends)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(release, purpose, epsilon, delta)``: a row per mechanism, as many as columns and edges call for."""
        return spark.createDataFrame(self.spends, "release string, purpose string, epsilon double, delta double")


def noisy_counts(counts: np.ndarray, epsilon: float, source: np.random.Generator, sensitivity: float = 2.0) -> np.ndarray:
    """Counts with two-sided geometric noise, the whole-number form of Laplace noise, so no digits of a float can give it away.

    One changed row moves two cells by one, hence the sensitivity.
    """
    p = -math.expm1(-epsilon / sensitivity)
    return counts + source.geometric(p, counts.shape) - source.geometric(p, counts.shape)


def exponential_choice(scores: np.ndarray, epsilon: float, sensitivity: float, source: np.random.Generator) -> int:
    """The place of one score, drawn in proportion to ``exp(epsilon * score / (2 * sensitivity))``."""
    return int(np.argmax(epsilon * np.asarray(scores) / (2 * sensitivity) + source.gumbel(size=len(scores))))


def information_sensitivity(rows: int) -> float:
    """By how much one row can move the mutual information, in nats, of two columns over ``rows`` rows (Zhang et al. 2014)."""
    n = max(rows, 2)
    return 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1))


def private_tree(information: dict[tuple[int, int], float], k: int, epsilon: float, rows: int, source: np.random.Generator) -> list[tuple[int, int | None]]:
    """``(node, parent)``: a tree grown edge by edge, each drawn by the exponential mechanism from all that leave the tree.

    Every draw spends its even part of ``epsilon``; the first node does not depend on the data.
    """
    order: list[tuple[int, int | None]] = [(0, None)]
    inside = [0]
    while len(inside) < k:
        edges = [(i, j) for i in range(k) if i not in inside for j in inside]
        scores = np.array([information.get((max(e), min(e)), 0.0) for e in edges])
        node, parent = edges[exponential_choice(scores, epsilon / (k - 1), information_sensitivity(rows), source)]
        inside.append(node)
        order.append((node, parent))
    return order
