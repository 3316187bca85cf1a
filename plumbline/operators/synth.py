"""Synthetic tables. A generator is fitted by aggregates into a small model (edges, category lists, count tables whose
size depends on the schema, not on the rows); sampling is a narrow job over ``spark.range``.

Text columns with more than ``MAX_LEVELS`` values are not modelled: they are drawn from uniformly chosen real rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import gaussian
from plumbline.operators.balance import uniform
from plumbline.operators.common import constants, numeric_columns, q, string_columns, union_all
from plumbline.operators.neighbours import min_max
from plumbline.operators.privacy import Budget, noisy_counts, private_tree, secret_source
from plumbline.operators.profile import distinct_counts, value_counts
from plumbline.operators.ranks import quantile_map
from plumbline.session import materialize

MAX_LEVELS = 200
GRID = 200
TREE_BINS = 16
DELTA = 1e-6
ID = "syn_id"


@dataclass
class ColumnModel:
    """One modelled column. Numbers have ``edges`` (a quantile or equal-width grid), texts have ``levels``."""

    name: str
    kind: str
    whole: bool = False
    edges: np.ndarray | None = None
    levels: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    missing: float = 0.0

    @property
    def size(self) -> int:
        return len(self.levels) if self.edges is None else len(self.edges) - 1

    def codes(self, values: pd.Series) -> np.ndarray:
        if self.edges is None:
            return pd.Categorical(values, categories=self.levels).codes.astype("int64")
        x = values.to_numpy(dtype="float64", na_value=np.nan)
        found = np.clip(np.searchsorted(self.edges, x, side="right") - 1, 0, self.size - 1)
        return np.where(np.isnan(x), -1, found)

    def value_at(self, u: np.ndarray) -> np.ndarray:
        """Inverse distribution function."""
        total = np.concatenate([[0.0], np.cumsum(self.weights)])
        if self.edges is None:
            return np.array(self.levels, dtype=object)[np.clip(np.searchsorted(total, u, side="right") - 1, 0, self.size - 1)]
        return self._number(np.interp(u, total, self.edges))

    def position(self, values: pd.Series) -> np.ndarray:
        """Distribution function; the middle of the category's interval for texts, 0.5 for gaps."""
        total = np.concatenate([[0.0], np.cumsum(self.weights)])
        if self.edges is None:
            code = self.codes(values)
            return np.where(code < 0, 0.5, (total[code] + total[code + 1]) / 2)
        x = values.to_numpy(dtype="float64", na_value=np.nan)
        low, high = np.interp(x, self.edges, total), 1 - np.interp(-x, -self.edges[::-1], 1 - total[::-1])
        return np.where(np.isnan(x), 0.5, (low + high) / 2)

    def inside(self, code: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A value within the bin or level ``code``."""
        if self.edges is None:
            return np.array(self.levels, dtype=object)[code]
        return self._number(self.edges[code] + u * (self.edges[code + 1] - self.edges[code]))

    def _number(self, x: np.ndarray) -> np.ndarray:
        return np.rint(x) if self.whole else x


@dataclass
class TableModel:
    columns: list[ColumnModel]
    free: list[str]
    source: DataFrame
    types: dict[str, str]
    order: list[str]
    withheld: list[str] = field(default_factory=list)


def describe_table(
    df: DataFrame, exclude: Sequence[str] = (), bins: int | None = None, bounds: dict[str, tuple[float, float]] | None = None
) -> TableModel:
    """Marginals of every column: quantile grids for numbers (equal-width bins with ``bins``), level shares for texts."""
    names = [c for c in df.columns if c not in exclude]
    numbers = [c for c in names if c in numeric_columns(df)]
    texts = [c for c in names if c in string_columns(df)]
    few = {r["column"] for r in distinct_counts(df, texts, exact=False).where(F.col("nunique") <= MAX_LEVELS).collect()} if texts else set()
    rows = df.agg(
        F.count("*").alias("rows"), *[F.count(q(c)).alias(f"_{i}") for i, c in enumerate(names)]
    ).first()
    missing = {c: 1.0 - rows[f"_{i}"] / max(rows["rows"], 1) for i, c in enumerate(names)}
    models = []
    if numbers and bins is None:
        grids = quantile_map(df, numbers, [i / GRID for i in range(GRID + 1)])
    elif numbers:
        ranges = {**min_max(df, numbers), **{c: (a, b - a) for c, (a, b) in (bounds or {}).items()}}
        grids = {c: list(np.linspace(low, low + (span if span > 0 else 1.0), bins + 1)) for c, (low, span) in ranges.items()}
    for c in numbers:
        if grids[c][0] is not None:
            edges = np.array(grids[c], dtype="float64")
            whole = isinstance(df.schema[c].dataType, T.IntegralType)
            models.append(ColumnModel(c, "number", whole, edges, weights=np.full(len(edges) - 1, 1.0 / (len(edges) - 1)), missing=missing[c]))
    modelled = [c for c in texts if c in few]
    counted: dict[str, list] = {c: [] for c in modelled}
    for r in value_counts(df, modelled).orderBy("column", "value").collect() if modelled else []:
        counted[r["column"]].append((r["value"], r["n"]))
    for c in modelled:
        total = sum(n for _, n in counted[c])
        if total:
            models.append(
                ColumnModel(c, "text", levels=[v for v, _ in counted[c]], weights=np.array([n / total for _, n in counted[c]]), missing=missing[c])
            )
    have = {m.name for m in models}
    free = [c for c in names if c not in have]
    return TableModel(models, free, df.select(*[q(c) for c in free]) if free else df, dict(df.dtypes), names)


def private_table(
    df: DataFrame, exclude: Sequence[str], epsilon: float, delta: float, bounds: dict[str, tuple[float, float]],
    levels: dict[str, Sequence[str]], rng: np.random.Generator, budget: Budget,
) -> TableModel:
    """A table model that holds nothing of the rows but noisy counts.

    Numbers need public ``bounds`` and get equal-width bins over them. Texts take public ``levels``; without them a level enters only if
    its noisy count passes the threshold of an ``(epsilon, delta)`` stability histogram, so values of single rows stay out. All
    other columns are withheld and come out as NULL. Weights and missing shares come from noisy counts in which the missing
    cells are one more cell. ``epsilon`` is split evenly over the columns, and a text without public levels spends half of its part and a
    ``delta`` on them; ``budget`` is told of every part.
    """
    names = [c for c in df.columns if c not in exclude]
    numbers = [c for c in names if c in numeric_columns(df)]
    texts = [c for c in names if c in string_columns(df)]
    unknown = [c for c in numbers if c not in bounds]
    if unknown:
        raise ValueError(f"private generators need public bounds of {unknown}, or leave these columns out")
    part = epsilon / max(len(numbers) + len(texts), 1)
    models = []
    for c in numbers:
        low, high = bounds[c]
        edges = np.linspace(low, high if high > low else low + 1.0, TREE_BINS + 1)
        models.append(ColumnModel(c, "number", isinstance(df.schema[c].dataType, T.IntegralType), edges))
    open_texts = [c for c in texts if c not in levels]
    found: dict[str, list[str]] = {c: sorted(levels[c]) for c in texts if c in levels} | {c: [] for c in open_texts}
    least = 1 + 4 / part * np.log(2 / delta)
    for c in open_texts:
        budget.spend(f"levels of {c}", part / 2, delta)
    if open_texts:
        # the counts stay in Spark until they are near the threshold; a far rarer level passes with a chance below delta
        likely = value_counts(df, open_texts).where(F.col("n") >= max(1.0, least / 2)).orderBy("column", "value")
        for r in likely.collect():
            if noisy_counts(np.array([r["n"]]), part / 2, rng)[0] >= least:
                found[r["column"]].append(r["value"])
    models += [ColumnModel(c, "text", levels=found[c]) for c in texts if found[c]]
    for m, (seen, gaps) in zip(models, marginal_counts(df, models)):
        own = part / 2 if m.name in open_texts else part
        budget.spend(f"cells of {m.name}", own)
        noisy = np.clip(noisy_counts(np.append(seen, gaps), own, rng), 0.0, None)
        total = noisy.sum()
        m.missing = float(noisy[-1] / total) if total > 0 else 0.0
        m.weights = noisy[:-1] / noisy[:-1].sum() if noisy[:-1].sum() > 0 else np.full(m.size, 1.0 / m.size)
    have = {m.name for m in models}
    return TableModel(models, [], df, dict(df.dtypes), names, [c for c in names if c not in have])


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", ID)


def _finish(model: TableModel, sampled: DataFrame, seed: int) -> DataFrame:
    """Restores types, gaps and column order, and adds the columns drawn from real rows."""
    out = {}
    for i, m in enumerate(model.columns):
        value = q(m.name).cast(model.types[m.name])
        if m.missing > 0:
            value = F.when(uniform(seed + 7919 + i, ID) >= F.lit(m.missing), value)
        out[m.name] = value
    out |= {c: F.lit(None).cast(model.types[c]) for c in model.withheld}
    done = sampled.withColumns(out) if out else sampled
    if model.free:
        done = with_drawn_rows(done, model.source, model.free, seed)
    return done.select(ID, *[q(c) for c in model.order])


def with_drawn_rows(sampled: DataFrame, source: DataFrame, columns: Sequence[str], seed: int) -> DataFrame:
    """Adds columns, each cell from an independently and uniformly chosen row of ``source``.

    Rows get a position from their partition and place in it; the partition sizes are the only thing collected.
    Joins are on unique positions, so no value can be hot.
    """
    placed = materialize(source.select(*[q(c) for c in columns], F.monotonically_increasing_id().alias("_row")))
    shift = 33
    sizes = (
        placed.groupBy(F.shiftright("_row", shift).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    )
    starts = np.cumsum([0] + [r["n"] for r in sizes])
    offsets = constants(
        source, [(int(r["p"]), int(a), int(b)) for r, a, b in zip(sizes, starts[:-1], starts[1:])],
        ["_p", "_from", "_to"], ["long", "long", "long"],
    )
    total = int(starts[-1])
    numbered = placed.withColumn("_p", F.shiftright("_row", shift)).join(F.broadcast(offsets), "_p").withColumn(
        "_at", F.col("_from") + F.col("_row") - F.shiftleft(F.col("_p"), shift)
    )
    out = sampled
    for i, c in enumerate(columns):
        wanted = F.floor(uniform(seed + 104729 + i, ID) * F.lit(total)).cast("long")
        out = out.withColumn("_at", wanted).join(numbered.select("_at", q(c)), "_at").drop("_at")
    return out


def _sampler(model: TableModel, n: int, seed: int, spark: SparkSession, draw: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Runs ``draw(uniforms)`` over batches of ids; uniforms come from a hash of the id, so retries agree."""
    width = 2 * len(model.columns)
    base = _rows(spark, n).select(ID, F.array(*[uniform(seed * 1_000_003 + j, ID) for j in range(max(width, 1))]).alias("u"))
    kinds = ", ".join(f"`{m.name}` {'double' if m.edges is not None else 'string'}" for m in model.columns)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = draw(np.stack(batch["u"].to_numpy()))
                yield pd.DataFrame({ID: batch[ID].to_numpy(), **made})

    return base.mapInPandas(make, f"{ID} long, {kinds}") if model.columns else base.select(ID)


# independent marginals


def sample_marginals(df: DataFrame, n: int, seed: int = 0, exclude: Sequence[str] = ()) -> DataFrame:
    """Every column from its own distribution, independently."""
    model = describe_table(df, exclude)
    columns = model.columns

    def draw(u: np.ndarray) -> dict[str, np.ndarray]:
        return {m.name: m.value_at(u[:, i]) for i, m in enumerate(columns)}

    return _finish(model, _sampler(model, n, seed, df.sparkSession, draw), seed)


# Gaussian copula


def score_correlation(df: DataFrame, columns: Sequence[ColumnModel]) -> np.ndarray:
    """Correlation matrix of the normal scores (Patki et al. 2016): block products per batch, merged by Spark."""
    k = len(columns)

    edge = 1e-6

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((k + 1, k + 1)), 0
        for batch in batches:
            z = np.ones((len(batch), k + 1))
            for i, m in enumerate(columns):
                z[:, i] = gaussian.quantile(np.clip(m.position(batch[m.name]), edge, 1 - edge))
            total += z.T @ z
            rows += len(batch)
        if rows:
            i, j = np.tril_indices(k + 1)
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = df.select(*[q(m.name) for m in columns]).mapInPandas(products, "i int, j int, s double")
    matrix = np.zeros((k + 1, k + 1))
    for r in sums.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["s"]
    n = max(matrix[k, k], 1.0)
    mean = matrix[:k, k] / n
    cov = matrix[:k, :k] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    return cov / np.outer(sd, sd)


def sample_copula(df: DataFrame, n: int, seed: int = 0, exclude: Sequence[str] = ()) -> DataFrame:
    """Gaussian copula: correlated normals pushed through the inverse marginals."""
    model = describe_table(df, exclude)
    columns = model.columns
    k = len(columns)
    correlation = score_correlation(df, columns) if k else np.zeros((0, 0))
    np.fill_diagonal(correlation, 1.0)
    values, vectors = np.linalg.eigh(correlation) if k else (np.zeros(0), np.zeros((0, 0)))
    root = vectors * np.sqrt(np.clip(values, 0.0, None))

    def draw(u: np.ndarray) -> dict[str, np.ndarray]:
        z = gaussian.quantile(u[:, :k]) @ root.T
        p = gaussian.cdf(z)
        return {m.name: m.value_at(p[:, i]) for i, m in enumerate(columns)}

    return _finish(model, _sampler(model, n, seed, df.sparkSession, draw), seed)


# tree-shaped Bayesian network


def pair_counts(df: DataFrame, columns: Sequence[ColumnModel]) -> dict[tuple[int, int], np.ndarray]:
    """Joint bin counts of every pair; each task adds up its own tables, sized by the bins."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)] or [(0, 0)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {p: np.zeros(columns[p[0]].size * columns[p[1]].size, dtype="int64") for p in pairs}
        for batch in batches:
            codes = [m.codes(batch[m.name]) for m in columns]
            for i, j in pairs:
                ok = (codes[i] >= 0) & (codes[j] >= 0)
                flat = codes[i][ok] * columns[j].size + codes[j][ok]
                tables[i, j] += np.bincount(flat, minlength=len(tables[i, j]))
        for (i, j), t in tables.items():
            at = np.flatnonzero(t)
            if len(at):
                yield pd.DataFrame({"i": i, "j": j, "cell": at, "n": t[at]})

    sums = df.select(*[q(m.name) for m in columns]).mapInPandas(count, "i int, j int, cell long, n long")
    out = {p: np.zeros((columns[p[0]].size, columns[p[1]].size)) for p in pairs}
    for r in sums.groupBy("i", "j", "cell").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]].flat[r["cell"]] = r["n"]
    return out


def mutual_information(table: np.ndarray) -> float:
    total = table.sum()
    if total <= 0:
        return 0.0
    p = table / total
    outer = p.sum(axis=1, keepdims=True) @ p.sum(axis=0, keepdims=True)
    some = p > 0
    return float((p[some] * np.log(p[some] / outer[some])).sum())


def spanning_tree(weights: dict[tuple[int, int], float], k: int) -> list[tuple[int, int | None]]:
    """Maximum spanning tree from node 0 as ``(node, parent)`` in an order where parents come first."""
    order: list[tuple[int, int | None]] = [(0, None)]
    inside = {0}
    while len(inside) < k:
        node, parent = max(
            ((i, j) for i in range(k) if i not in inside for j in inside),
            key=lambda e: weights.get((max(e), min(e)), 0.0),
        )
        inside.add(node)
        order.append((node, parent))
    return order


def _binned(model: TableModel) -> None:
    """Coarsens quantile grids to ``TREE_BINS`` bins and drops empty ones."""
    for m in model.columns:
        if m.edges is not None:
            step = max(1, m.size // TREE_BINS)
            edges = np.unique(np.append(m.edges[:-1:step], m.edges[-1]))
            m.edges = edges if len(edges) > 1 else np.array([edges[0], edges[0]])
            m.weights = np.full(m.size, 1.0 / m.size)


def sample_network(
    df: DataFrame, n: int, seed: int = 0, exclude: Sequence[str] = (), epsilon: float | None = None,
    bounds: dict[str, tuple[float, float]] | None = None, levels: dict[str, Sequence[str]] | None = None, delta: float = DELTA, budget: Budget | None = None,
) -> DataFrame:
    """Chow-Liu tree on binned columns. With ``epsilon`` it is private (after Zhang et al. 2014), and a third of it each describes the
    columns (``private_table`` says how), draws the tree by the exponential mechanism and fills its tables with noisy counts.

    The noise comes from a secret source: ``seed`` only decides what is drawn from the fitted model. The number of rows is taken as
    public. ``budget`` is told what was spent.
    """
    rng, budget = secret_source(), budget if budget is not None else Budget()
    if epsilon is None:
        model = describe_table(df, exclude)
        _binned(model)
    else:
        model = private_table(df, exclude, epsilon / 3, delta, bounds or {}, levels or {}, rng, budget)
    columns = model.columns
    k = len(columns)
    if not k:
        return _finish(model, _sampler(model, n, seed, df.sparkSession, lambda u: {}), seed)
    counts = pair_counts(df, columns)

    def noisy(table: np.ndarray, part: float | None) -> np.ndarray:
        return table if part is None else np.clip(noisy_counts(table, part, rng), 0.0, None)

    information = {p: mutual_information(t) for p, t in counts.items() if p[0] != p[1]}
    filling = None if epsilon is None else epsilon / 3 / max(k - 1, 1)
    if epsilon is None or k == 1:
        tree = spanning_tree(information, k)
    else:
        budget.spend("tree", epsilon / 3)
        tree = private_tree(information, k, epsilon / 3, df.count(), rng)
    if epsilon is not None:
        names = [f"table of {columns[i].name} and {columns[j].name}" for i, j in tree[1:]] or [f"table of {columns[0].name}"]
        for name in names:
            budget.spend(name, filling)
    tables: dict[int, np.ndarray] = {}
    for node, parent in tree[1:]:
        pair = (max(node, parent), min(node, parent))
        joint = noisy(counts[pair], filling)
        tables[node] = joint.T if pair[0] == node else joint  # rows: parent, columns: node
    if k > 1:
        first = tables[tree[1][0]].sum(axis=1)
    else:
        first = noisy(np.diag(counts[0, 0]), filling)

    def cumulative(t: np.ndarray) -> np.ndarray:
        t = np.where(t.sum(axis=-1, keepdims=True) > 0, t, 1.0)
        return np.cumsum(t / t.sum(axis=-1, keepdims=True), axis=-1)

    root = cumulative(first[None, :])[0]
    steps = {node: cumulative(t) for node, t in tables.items()}

    def draw(u: np.ndarray) -> dict[str, np.ndarray]:
        codes: dict[int, np.ndarray] = {}
        for node, parent in tree:
            pick = u[:, node]
            if parent is None:
                code = np.searchsorted(root, pick, side="right")
            else:
                code = (steps[node][codes[parent]] <= pick[:, None]).sum(axis=1)
            codes[node] = np.clip(code, 0, columns[node].size - 1)
        return {m.name: m.inside(codes[i], u[:, k + i]) for i, m in enumerate(columns)}

    return _finish(model, _sampler(model, n, seed, df.sparkSession, draw), seed)


# differentially private marginals


def sample_private_marginals(
    df: DataFrame, n: int, seed: int = 0, exclude: Sequence[str] = (), epsilon: float = 1.0,
    bounds: dict[str, tuple[float, float]] | None = None, levels: dict[str, Sequence[str]] | None = None, delta: float = DELTA, budget: Budget | None = None,
) -> DataFrame:
    """Independent columns from histograms with geometric noise (Dwork 2006); ``private_table`` says what enters them.

    The noise comes from a secret source: ``seed`` only decides what is drawn from the fitted model. ``budget`` is told what was spent.
    """
    model = private_table(df, exclude, epsilon, delta, bounds or {}, levels or {}, secret_source(), budget if budget is not None else Budget())
    columns = model.columns

    def draw(u: np.ndarray) -> dict[str, np.ndarray]:
        return {m.name: m.value_at(u[:, i]) for i, m in enumerate(columns)}

    return _finish(model, _sampler(model, n, seed, df.sparkSession, draw), seed)


def marginal_counts(df: DataFrame, columns: Sequence[ColumnModel]) -> list[tuple[np.ndarray, int]]:
    """Per column the counts of its bins or levels, and the number of cells in none of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(m.size + 1, dtype="int64") for m in columns]
        for batch in batches:
            for i, m in enumerate(columns):
                code = m.codes(batch[m.name])
                tables[i] += np.bincount(np.where(code < 0, m.size, code), minlength=m.size + 1)
        for i, t in enumerate(tables):
            yield pd.DataFrame({"i": i, "cell": np.arange(len(t)), "n": t})

    out = [np.zeros(m.size + 1) for m in columns]
    if columns:
        sums = df.select(*[q(m.name) for m in columns]).mapInPandas(count, "i int, cell long, n long")
        for r in sums.groupBy("i", "cell").agg(F.sum("n").alias("n")).collect():
            out[r["i"]][r["cell"]] = r["n"]
    return [(t[:-1], int(t[-1])) for t in out]


# sequential trees


def sample_trees(df: DataFrame, n: int, seed: int = 0, exclude: Sequence[str] = (), depth: int = 6, grid: int = 50) -> DataFrame:
    """Column after column: a decision tree on the columns before it, then a draw from the distribution in the leaf
    (Reiter 2005). Leaves are summarised by mergeable sketches or level counts, one small table per column."""
    model = describe_table(df, exclude)
    columns = model.columns
    spark = df.sparkSession
    coded = df.select(
        *[F.coalesce(q(m.name).cast("double"), F.lit(float(np.median(m.edges)))).alias(f"_c{i}") if m.edges is not None
          else (F.coalesce(F.array_position(F.array(*[F.lit(v) for v in m.levels]), q(m.name)), F.lit(1)) - 1).cast("double").alias(f"_c{i}")
          for i, m in enumerate(columns)]
    )
    made = _rows(spark, n)
    for i, m in enumerate(columns):
        u = uniform(seed * 1_000_003 + i, ID)
        if i == 0:
            leaf_rows, made = coded.withColumn("_leaf", F.lit(0.0)), made.withColumn("_leaf", F.lit(0.0))
        else:
            before = VectorAssembler(inputCols=[f"_c{j}" for j in range(i)], outputCol="_f")
            kind = DecisionTreeRegressor if m.edges is not None else DecisionTreeClassifier
            tree = kind(featuresCol="_f", labelCol=f"_c{i}", leafCol="_leaf", predictionCol="_p", maxDepth=depth, seed=seed)
            fitted = tree.fit(before.transform(coded))
            leaf_rows = fitted.transform(before.transform(coded)).select("_leaf", f"_c{i}")
            made = fitted.transform(before.transform(made)).select(ID, *[f"_c{j}" for j in range(i)], "_leaf")
        if m.edges is not None:
            probs = [j / grid for j in range(grid + 1)]
            leaves = leaf_rows.groupBy("_leaf").agg(F.percentile_approx(f"_c{i}", probs, 1000).alias("_g"))
            at = u * grid
            low = F.least(F.floor(at), F.lit(grid - 1).cast("long")).cast("int")
            value = F.get("_g", low) + (at - low) * (F.get("_g", low + 1) - F.get("_g", low))
            value = F.rint(value) if m.whole else value
        else:
            per = leaf_rows.groupBy("_leaf", f"_c{i}").agg(F.count("*").alias("_n"))
            leaves = per.groupBy("_leaf").agg(
                F.array_sort(F.collect_list(F.struct(F.col(f"_c{i}").alias("v"), F.col("_n").alias("n")))).alias("_g")
            ).withColumn("_t", F.aggregate("_g", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
            step = lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.coalesce(a["v"], F.when(a["seen"] + x["n"] > u * F.col("_t"), x["v"])).alias("v"),
            )
            value = F.aggregate("_g", start, step)["v"]
        leaves = F.broadcast(materialize(leaves))
        made = made.join(leaves, "_leaf", "left").withColumn(f"_c{i}", value).select(ID, *[f"_c{j}" for j in range(i + 1)])
    named = made.select(
        ID,
        *[F.col(f"_c{i}").alias(m.name) if m.edges is not None
          else F.get(F.array(*[F.lit(v) for v in m.levels]), F.col(f"_c{i}").cast("int")).alias(m.name)
          for i, m in enumerate(columns)],
    )
    return _finish(model, named, seed)


# catalogue and runs


GENERATORS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "marginals": ("generic", sample_marginals),
    "gaussian_copula": ("generic", sample_copula),
    "bayesian_network": ("generic", sample_network),
    "sequential_trees": ("generic", sample_trees),
    "dp_marginals": ("privacy", sample_private_marginals),
    "privbayes": ("privacy", lambda df, n, seed=0, exclude=(), epsilon=1.0, **public: sample_network(df, n, seed, exclude, epsilon, **public)),
}
REPEATS = 3


def catalogue(spark: SparkSession, privacy: bool = False) -> DataFrame:
    """``(name, category)`` of the generators; private ones on request."""
    rows = [(name, category) for name, (category, _) in GENERATORS.items() if privacy or category == "generic"]
    return spark.createDataFrame(rows, "name string, category string")


def method_names(methods: str | Sequence[str]) -> list[str]:
    """Names from a comma list, trimmed and lower-cased."""
    names = methods.split(",") if isinstance(methods, str) else list(methods)
    names = [name.strip().lower() for name in names if name.strip()]
    unknown = [name for name in names if name not in GENERATORS]
    if unknown:
        raise ValueError(f"unknown generators {unknown}")
    return names


def generate(
    df: DataFrame, methods: str | Sequence[str], count: int | None = None, repeats: int = REPEATS, exclude: Sequence[str] = (),
    options: dict[str, dict] | None = None, budget: Budget | None = None,
) -> DataFrame:
    """``(generator, repeat, syn_id, columns...)``; as many rows per repeat as the table unless ``count`` is given.

    ``options`` holds further arguments by generator; private ones need ``bounds`` of all numbers. Every repeat of a private one
    is a new fit and spends its ``epsilon``; ``budget`` keeps the account over all of them.
    """
    budget = budget if budget is not None else Budget()
    n = df.count() if count is None else count
    parts = []
    for name in method_names(methods):
        for repeat in range(repeats):
            own = dict((options or {}).get(name, {}))
            if GENERATORS[name][0] == "privacy":
                budget.release = f"{name} {repeat}"
                own.setdefault("budget", budget)
            made = GENERATORS[name][1](df, n, seed=repeat + 1, exclude=exclude, **own)
            parts.append(made.select(F.lit(name).alias("generator"), F.lit(repeat).alias("repeat"), "*"))
    return union_all(parts)


def group_generator(method: str, exclude: Sequence[str] = (), **options) -> Callable[[DataFrame, int, int], DataFrame]:
    """A per-group generator for ``balance.fairness_augmentation``."""
    return lambda df, n, seed: GENERATORS[method][1](df, n, seed=seed, exclude=exclude, **options).drop(ID)


def projection(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(source, x, y)``: both tables on the first two principal components of the real one, columns scaled alike."""
    columns = list(columns if columns is not None else numeric_columns(real))
    scale = min_max(real, columns)

    def scaled(frame: DataFrame, name: str) -> DataFrame:
        cells = [
            F.coalesce((q(c).cast("double") - F.lit(low)) / F.lit(span if span > 0 else 1.0), F.lit(0.0)).alias(f"_{i}")
            for i, (c, (low, span)) in enumerate(scale.items())
        ]
        return frame.select(F.lit(name).alias("source"), *cells)

    assembler = VectorAssembler(inputCols=[f"_{i}" for i in range(len(columns))], outputCol="_f")
    fitted = PCA(k=2, inputCol="_f", outputCol="_z").fit(assembler.transform(scaled(real, "real")))
    both = scaled(real, "real").unionByName(scaled(syn, "synthetic"))


    z = vector_to_array(F.col("_z"))
    return fitted.transform(assembler.transform(both)).select("source", z[0].alias("x"), z[1].alias("y"))
