"""Baseline studies with Spark ML, their evaluation and explanation."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators import survival
from plumbline.operators.balance import uniform
from plumbline.operators.clean import drop_worst
from plumbline.operators.common import constants, join_on, numeric_columns, q, string_columns, union_all
from plumbline.operators.ranks import quantile_map, running
from plumbline.session import materialize

FEATURES, SCALED, LABEL, PREDICTION, PROBABILITY = "_features", "_scaled", "_label", "_prediction", "_probability"
MAX_LEVELS = 200
WALKED_ROWS = 1_000_000  # steps of attribution walks that a task gets at most, about
LEAST_SPREAD = 0.1  # share of the typical residual below which no interval shrinks
# Fixed value: default miscoverage of prediction sets and intervals.
ALPHA = 0.1
# Confidence limits that separate easy and hard samples.
EASY_CONFIDENCE, HARD_CONFIDENCE = 0.75, 0.25


# features


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    numbers = [c for c in numeric_columns(df) if c not in exclude]
    texts = [c for c in string_columns(df) if c not in exclude]
    return numbers, texts


def fit_features(df: DataFrame, exclude: Sequence[str]) -> PipelineModel:
    """Numbers with gaps filled by the mean and texts as codes, in one vector column.

    Texts of up to ``MAX_LEVELS`` values get frequency-ordered codes; wider ones the bucket of their hash, so no column is left out.
    """
    numbers, texts = feature_columns(df, exclude)
    near = df.agg(*[F.approx_count_distinct(q(c)).alias(f"_{i}") for i, c in enumerate(texts)]).first() if texts else []
    # the estimate only rules out; columns near the limit are counted
    close = [(i, c) for i, c in enumerate(texts) if near[f"_{i}"] <= 2 * MAX_LEVELS]
    exact = df.agg(*[F.count_distinct(q(c)).alias(f"_{i}") for i, c in close]).first() if close else {}
    few = [c for i, c in close if exact[f"_{i}"] <= MAX_LEVELS]
    wide = [c for c in texts if c not in few]
    stages: list[Transformer] = []
    if few:
        stages.append(StringIndexer(inputCols=few, outputCols=[f"_x_{c}" for c in few], handleInvalid="keep").fit(df))
    if wide:
        quoted = {c: "`" + c.replace("`", "``") + "`" for c in wide}
        buckets = ", ".join(f"CAST(pmod(xxhash64({name}), {MAX_LEVELS}) AS DOUBLE) AS `_x_{name[1:-1]}`" for name in quoted.values())
        stages.append(SQLTransformer(statement=f"SELECT *, {buckets} FROM __THIS__"))
    inputs = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"_n_{c}" for c in numbers]).fit(df))
        inputs += [f"_n_{c}" for c in numbers]
    inputs += [f"_x_{c}" for c in texts]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
    return PipelineModel(stages)


def feature_names(pipeline: PipelineModel) -> list[str]:
    return [c[3:] for c in pipeline.stages[-1].getInputCols()]


def prepared(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the feature vector and without the intermediate columns."""
    return pipeline.transform(df).select(*df.columns, FEATURES)


# studies


def classifier(name: str, classes: int, width: int, seed: int):
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    if name == "linear_model":
        return LogisticRegression(**common, probabilityCol=PROBABILITY, maxIter=50, regParam=1e-4)
    if name == "forest":
        return RandomForestClassifier(**common, probabilityCol=PROBABILITY, numTrees=20, seed=seed, maxBins=MAX_LEVELS + 2)
    if name == "mlp":
        scaler = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True)
        network = MultilayerPerceptronClassifier(
            **{**common, "featuresCol": SCALED}, probabilityCol=PROBABILITY, layers=[width, 16, classes], maxIter=40, seed=seed
        )
        return Pipeline(stages=[scaler, network])
    boosted = GBTClassifier(**common, maxIter=10, seed=seed, maxBins=MAX_LEVELS + 2)
    if classes == 2:
        return boosted.setProbabilityCol(PROBABILITY)
    return OneVsRest(classifier=GBTClassifier(maxIter=5, seed=seed, maxBins=MAX_LEVELS + 2), **common)


def regressor(name: str, seed: int):
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    if name == "linear_model":
        return LinearRegression(**common, regParam=1e-6)
    if name == "forest":
        return RandomForestRegressor(**common, numTrees=20, seed=seed, maxBins=MAX_LEVELS + 2)
    return GBTRegressor(**common, maxIter=10, seed=seed, maxBins=MAX_LEVELS + 2)


class Study:
    """Fitted candidates with their scores; ``best`` transforms rows into predictions."""

    def __init__(self, features: PipelineModel, label: Transformer | None, models: dict[str, Transformer], scores: DataFrame, best: str):
        self.features, self.label, self.models, self.scores, self.best = features, label, models, scores, best

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` with ``_prediction`` and, for classifiers that have it, ``_probability`` as an array."""
        out = self.models[name or self.best].transform(self._labelled(prepared(self.features, df)))
        extra = [F.col(LABEL)] if LABEL in out.columns else []
        if PROBABILITY in out.columns:
            extra.append(vector_to_array(F.col(PROBABILITY)).alias(PROBABILITY))
        return out.select(*[q(c) for c in df.columns], F.col(PREDICTION), *extra)

    def _labelled(self, df: DataFrame) -> DataFrame:
        if self.label is None or self.label.getInputCol() not in df.columns:
            return df
        return self.label.transform(df)


def classification_study(
    train: DataFrame, test: DataFrame, target: str, mode: str = "all", exclude: Sequence[str] = (),
    minimum: float | None = None, folds: int = 3, seed: int = 0, candidates: Sequence[str] | None = None,
) -> Study:
    """Cross-validated candidates, scored on the test rows by accuracy, F1 and log loss. Below ``minimum`` F1 the study fails.

    Test rows of classes without a training row count as wrong; only the AUC, which ranks two known classes, leaves them out.
    """
    train, test = train.where(q(target).isNotNull()), test.where(q(target).isNotNull())
    features = fit_features(train, [target, *exclude])
    label = StringIndexer(inputCol=target, outputCol=LABEL, handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    classes = len(label.labels)
    names = list(candidates or (("linear_model",) if mode == "linear" else ("linear_model", "forest", "xgb")))
    width = len(feature_names(features))
    ready = label.transform(prepared(features, train)).select(FEATURES, LABEL)
    metric = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="f1")
    models, found = {}, []
    # classes that no training row has get a label of their own, which no prediction can match
    check = materialize(label.transform(prepared(features, test)).select(FEATURES, LABEL))
    ready = materialize(ready)
    for name in names:
        fitted, cross = _fit(classifier(name, classes, width, seed), ready, metric, folds, seed)
        models[name] = fitted
        scored = fitted.transform(check)
        # four metrics read the predictions, so they are made once; kept as they lie
        scored = scored.select(*[c for c in (LABEL, PREDICTION, PROBABILITY) if c in scored.columns]).persist()
        rows = {"f1": metric.evaluate(scored), "accuracy": metric.evaluate(scored, {metric.metricName: "accuracy"})}
        if cross is not None:
            rows["cross_validated_f1"] = cross
        if PROBABILITY in scored.columns:
            rows["log_loss"] = _log_loss(scored)
            if classes == 2:
                known = scored.where(F.col(LABEL) < classes)
                rows["auc"] = auc(known.withColumn("_s", vector_to_array(F.col(PROBABILITY))[1]), "_s", LABEL)
        scored.unpersist()
        found += [(name, m, float(v)) for m, v in rows.items()]
    return _study(train, features, label, models, found, "f1", max, minimum)


def _log_loss(scored: DataFrame) -> float:
    p = F.get(vector_to_array(F.col(PROBABILITY)), F.col(LABEL).cast("int"))
    return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("x")).first()["x"]


def regression_study(
    train: DataFrame, test: DataFrame, target: str, mode: str = "all", exclude: Sequence[str] = (),
    minimum: float | None = None, folds: int = 3, seed: int = 0, candidates: Sequence[str] | None = None,
) -> Study:
    """Cross-validated candidates, scored on the test rows by R2, RMSE and MAE. Below ``minimum`` R2 the study fails."""
    train, test = train.where(q(target).isNotNull()), test.where(q(target).isNotNull())
    features = fit_features(train, [target, *exclude])
    names = list(candidates or (("linear_model",) if mode == "linear" else ("linear_model", "forest", "xgb")))
    label = q(target).cast("double").alias(LABEL)
    ready = materialize(prepared(features, train).select(FEATURES, label))
    check = materialize(prepared(features, test).select(FEATURES, label))
    metric = RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="r2")
    models, found = {}, []
    for name in names:
        fitted, cross = _fit(regressor(name, seed), ready, metric, folds, seed)
        models[name] = fitted
        scored = fitted.transform(check)
        rows = {m: metric.evaluate(scored, {metric.metricName: m}) for m in ("r2", "rmse", "mae")}
        if cross is not None:
            rows["cross_validated_r2"] = cross
        found += [(name, m, float(v)) for m, v in rows.items()]
    return _study(train, features, None, models, found, "r2", max, minimum)


def _fit(estimator, ready: DataFrame, metric, folds: int, seed: int) -> tuple[Transformer, float | None]:
    if folds < 2:
        return estimator.fit(ready), None
    validated = CrossValidator(
        estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=metric, numFolds=folds, seed=seed
    ).fit(ready)
    return validated.bestModel, float(validated.avgMetrics[0])


def _study(df, features, label, models, found, metric: str, pick: Callable, minimum: float | None) -> Study:
    scores = constants(df, found, ["model", "metric", "value"], ["string", "string", "double"])
    by_model = {m: v for m, name, v in found if name == metric}
    best = pick(by_model, key=by_model.get)
    if minimum is not None and by_model[best] < minimum:
        raise ValueError(f"best {metric} {by_model[best]:.4f} is below the required {minimum}")
    return Study(features, label, models, scores, best)


def survival_study(
    train: DataFrame, test: DataFrame, time: str, event: str, exclude: Sequence[str] = (), minimum: float | None = None
) -> Study:
    """Accelerated failure time model, scored by the concordance index of predicted and observed times."""
    # the fits and the score read the rows many times, so a join behind them is made once per table
    train, test = materialize(train.drop(*exclude)), materialize(test.drop(*exclude))
    features = fit_features(train, [time, event, *exclude])

    def ready(frame: DataFrame) -> DataFrame:
        known = prepared(features, frame).where(q(time).isNotNull() & (q(time) > 0) & q(event).isNotNull())
        return known.withColumns({LABEL: q(time).cast("double"), "_event": q(event).cast("double")})

    fitted = AFTSurvivalRegression(
        featuresCol=FEATURES, labelCol=LABEL, censorCol="_event", predictionCol=PREDICTION
    ).fit(ready(train))
    scored = materialize(fitted.transform(ready(test)).select(LABEL, "_event", (-F.col(PREDICTION)).alias("risk")))
    found = [("aft", "concordance", concordance(scored, LABEL, F.col("_event") > 0, "risk").first()["concordance"])]
    return _study(train, features, None, {"aft": fitted}, found, "concordance", max, minimum)


def concordance(df: DataFrame, time: str, event: Column, risk: str) -> DataFrame:
    """``(comparable, concordant, tied, concordance)``: exact concordance index without forming pairs.

    A row with the event is compared with every row of a later time. Times get dense ranks; at each bit of
    the rank, blocks of equal higher bits split into an earlier and a later half, and one running count over the
    risk order per block counts the pairs that part at this bit. That is one ordered pass per bit.
    """
    rows = df.select(q(time).alias("t"), event.alias("e"), q(risk).cast("double").alias("s")).where("t is not null and s is not null")
    # rows collapse to one per time and risk before the join, so no time is hot in it
    pairs = materialize(rows.groupBy("t", "s").agg(F.count_if("e").alias("d"), F.count("*").alias("n")))
    times = running(pairs.select("t").distinct().withColumn("one", F.lit(1)), [], ["t"], ["one"])
    coded = materialize(pairs.join(times.select("t", (F.col("cum_one") - 1).alias("code")), "t").select("code", "s", "d", "n"))
    highest = coded.agg(F.max("code").alias("m")).first()["m"] or 0
    levels = []
    for bit in range(int(highest).bit_length()):
        side = F.shiftright("code", bit).bitwiseAND(F.lit(1))
        block = coded.groupBy(F.shiftright("code", bit + 1).alias("block"), "s").agg(
            F.sum(F.when(side == 0, F.col("d")).otherwise(0)).alias("early"),
            F.sum(F.when(side == 1, F.col("n")).otherwise(0)).alias("late"),
        )
        ordered = running(block, ["block"], ["s"], ["late"])
        totals = block.groupBy("block").agg(F.sum("late").alias("total"))
        levels.append(
            ordered.join(totals, "block").agg(
                F.sum(F.col("early") * F.col("total")).alias("comparable"),
                F.sum(F.col("early") * (F.col("cum_late") - F.col("late"))).alias("concordant"),
                F.sum(F.col("early") * F.col("late")).alias("tied"),
            )
        )
    if not levels:
        return constants(df, [(0, 0, 0, None)], ["comparable", "concordant", "tied", "concordance"], ["long", "long", "long", "double"])
    total = union_all(levels).agg(*[F.sum(c).alias(c) for c in ("comparable", "concordant", "tied")])
    index = F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("comparable"))
    return total.withColumn("concordance", index)


# conformal prediction


def order_statistic(df: DataFrame, column: str, rank: int) -> float:
    """The ``rank``-th smallest value, counted from 1; infinity beyond the last."""
    counts = df.where(q(column).isNotNull()).groupBy(q(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ordered = running(counts, [], ["v"], ["n"])
    found = ordered.where((F.col("cum_n") >= rank) & (F.col("cum_n") - F.col("n") < rank)).select("v").first()
    return math.inf if found is None else float(found["v"])


def conformal_limit(calibration: DataFrame, score: str, alpha: float = ALPHA) -> float:
    """Order statistic ``ceil((n + 1) (1 - alpha))`` of the calibration scores."""
    n = calibration.where(q(score).isNotNull()).count()
    return order_statistic(calibration, score, math.ceil((n + 1) * (1 - alpha) - 1e-12))


def conformal_intervals(
    calibration: DataFrame, df: DataFrame, prediction: str, target: str, alpha: float = ALPHA
) -> DataFrame:
    """Adds ``lower`` and ``upper`` around the prediction (Lei et al. 2018)."""
    scored = calibration.select(F.abs(q(target) - q(prediction)).alias("_score"))
    limit = conformal_limit(scored, "_score", alpha)
    return df.withColumns({"lower": q(prediction) - F.lit(limit), "upper": q(prediction) + F.lit(limit)})


def conformal_sets(
    calibration: DataFrame, df: DataFrame, probabilities: str, label: str, alpha: float = ALPHA
) -> DataFrame:
    """Adds ``prediction_set``: the class indexes whose probability is within the calibrated limit."""
    scored = calibration.select((1 - F.get(q(probabilities), q(label).cast("int"))).alias("_score"))
    limit = conformal_limit(scored, "_score", alpha)
    classes = F.sequence(F.lit(0), F.size(q(probabilities)) - 1)
    return df.withColumn("prediction_set", F.filter(classes, lambda i: 1 - F.get(q(probabilities), i) <= F.lit(limit)))


def weighted_limits(calibration: DataFrame, score: str, weight: str, tail: float, times: str | None = None) -> tuple[float, float]:
    """``(low, high)``: scores that leave at most ``tail`` of the weight beyond them on either side.

    The row to come counts with the largest weight of all, placed beyond each limit in turn. A limit that this puts beyond all
    scores is minus or plus infinity. ``times`` names a column that says how many rows a row stands for.
    """
    often = F.lit(1) if times is None else q(times)
    masses = calibration.where(q(score).isNotNull() & q(weight).isNotNull()).groupBy(q(score).cast("double").alias("s"))
    masses = materialize(masses.agg(F.sum(q(weight) * often).alias("w"), F.max(q(weight)).alias("most")))
    total, most = masses.agg(F.sum("w"), F.max("most")).first()
    if total is None:
        return -math.inf, math.inf
    need = (1 - tail) * (total + most) * (1 - 1e-12)
    ordered = running(masses, [], ["s"], ["w"])
    above = F.lit(total) - F.col("cum_w") + F.col("w")
    low, high = ordered.agg(F.max(F.when(above >= need, F.col("s"))), F.min(F.when(F.col("cum_w") >= need, F.col("s")))).first()
    return -math.inf if low is None else float(low), math.inf if high is None else float(high)


def conformal_survival(calibration: DataFrame, df: DataFrame, prediction: str, time: str, event: Column, alpha: float = ALPHA) -> DataFrame:
    """Adds ``lower`` and ``upper``, an interval for the time of the event around the predicted one.

    The score of a calibration row is its time over its prediction. Only rows with the event have one; each stands for those
    censored before it by one over the chance of being seen that long (inverse probability of censoring weights). ``alpha`` is split
    evenly over both sides. The lower end is 0 and the upper one infinite where the calibration rows cannot tell. Predictions must be positive;
    rows without a positive prediction, time or event are no calibration rows.
    """
    rows = calibration.where((q(prediction) > 0) & q(time).isNotNull() & event.isNotNull())
    weights = survival.censoring_weights(rows, time, event)
    scores = rows.where(event).groupBy(q(time).alias("time"), (q(time) / q(prediction)).alias("score")).agg(F.count("*").alias("n"))
    low, high = weighted_limits(scores.join(weights, "time"), "score", "weight", alpha / 2, "n")
    return df.withColumns({"lower": q(prediction) * F.lit(max(low, 0.0)), "upper": q(prediction) * F.lit(high)})


# evaluation of predictions


def auc(df: DataFrame, score: str, label: str) -> float | None:
    """Area under the ROC curve from running counts over distinct scores; ties count half."""
    return auc_by_group(df.withColumn("_group", F.lit("all")), "_group", score, q(label) == 1).first()["auc"]


def auc_by_group(df: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    counts = df.groupBy(q(group).alias("g"), q(score).cast("double").alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ordered = running(counts, ["g"], ["s"], ["neg"])
    below = F.col("cum_neg") - F.col("neg") / 2
    area = F.try_divide(F.sum(F.col("pos") * below), F.sum("pos") * F.sum("neg"))
    return ordered.groupBy("g").agg(area.alias("auc")).withColumnRenamed("g", group)


def classification_by_subgroup(
    df: DataFrame, group: str, label: str, prediction: str, score: str | None = None, positive=1
) -> DataFrame:
    """``(group, rows, accuracy, precision, recall, f1[, auc])`` for a binary target."""
    truth, said = q(label) == positive, q(prediction) == positive
    counted = df.groupBy(q(group)).agg(
        F.count("*").alias("rows"), F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"), F.count_if(q(label) == q(prediction)).alias("right"),
    )
    tp = F.col("tp")
    out = counted.select(
        group, "rows", (F.col("right") / F.col("rows")).alias("accuracy"),
        F.try_divide(tp, tp + F.col("fp")).alias("precision"), F.try_divide(tp, tp + F.col("fn")).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    )
    return out if score is None else join_on(out, auc_by_group(df, group, score, truth), [group])


def regression_by_subgroup(df: DataFrame, group: str, label: str, prediction: str) -> DataFrame:
    """``(group, rows, rmse, mae, r2)``."""
    y, error = q(label).cast("double"), q(label).cast("double") - q(prediction)
    counted = df.groupBy(q(group)).agg(
        F.count("*").alias("rows"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("v"),
    )
    return counted.select(group, "rows", "rmse", "mae", (1 - F.try_divide(F.pow(F.col("rmse"), 2), F.col("v"))).alias("r2"))


# permutations of rows


def ranked_rows(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, int]:
    """``(_rank, key)``: rows in seeded hash order, from 0, and their number."""
    n = df.count()
    narrow = df.select(F.xxhash64(F.lit(seed), q(key)).alias("_h"), q(key).alias("_key"), F.lit(1).alias("_one"))
    ranked = running(narrow, [], ["_h", "_key"], ["_one"], upper_bound=n)
    return ranked.select((F.col("cum__one") - 1).alias("_rank"), "_key"), n


def permuted(df: DataFrame, key: str, columns: Sequence[str], seed: int, prefix: str = "_p_") -> DataFrame:
    """Adds ``<prefix><c>``: the cells of another row, the same one for all columns, by a permutation of the rows.

    Rows are numbered in hash order once and matched with the row a seeded distance further on.
    """
    ranked, n = ranked_rows(df, key, seed)
    ranked = materialize(ranked)
    return _shifted(df, ranked, n, key, columns, seed, prefix)


def _shifted(df, ranked, n: int, key: str, columns, seed: int, prefix: str) -> DataFrame:
    shift = 1 + (seed * 2_654_435_761 + 40_503) % max(n - 1, 1)
    values = df.select(q(key).alias("_key"), *[q(c).alias(f"{prefix}{c}") for c in columns])
    donors = ranked.join(values, "_key").select(F.pmod(F.col("_rank") + shift, F.lit(n)).alias("_rank"), *[f"{prefix}{c}" for c in columns])
    return df.join(ranked.join(donors, "_rank").drop("_rank").withColumnRenamed("_key", key), key)


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame], df: DataFrame, key: str, features: Sequence[str],
    metric: Callable[[DataFrame], float], repeats: int = 1, seed: int = 0,
) -> DataFrame:
    """``(feature, importance)``: how far ``metric`` falls when one feature is permuted, averaged over repeats."""
    base = metric(predict(df))
    drops: dict[str, list[float]] = {c: [] for c in features}
    for repeat in range(repeats):
        mixed = materialize(permuted(df, key, features, seed + repeat))
        for c in features:
            swapped = mixed.withColumn(c, F.col(f"_p_{c}")).select(*df.columns)
            drops[c].append(base - metric(predict(swapped)))
    rows = [(c, sum(v) / len(v)) for c, v in drops.items()]
    return constants(df, rows, ["feature", "importance"], ["string", "double"])


def shapley_ranking(
    score: Callable[[DataFrame], DataFrame], rows: DataFrame, key: str, features: Sequence[str], rounds: int = 20, seed: int = 0
) -> DataFrame:
    """``(feature, mean_abs_attribution)``: Monte-Carlo Shapley values (Strumbelj and Kononenko 2014).

    ``score`` adds a numeric column ``score``. Each round pairs every row with a random other row and walks one random order of
    the features from the other row to the row itself; a feature's attribution is the mean change at its step.
    """
    k = len(features)
    other = [c for c in rows.columns if c not in features]
    parts = []
    ranked, n = ranked_rows(rows, key, seed)
    ranked = materialize(ranked)
    for number in range(rounds):
        paired = _shifted(rows, ranked, n, key, features, seed + number * 31 + 1, "_z_")
        order = F.array_sort(
            F.array(*[F.struct(uniform(seed + number * 1009 + i, key).alias("u"), F.lit(i).alias("i")) for i in range(k)])
        )
        walked = paired.withColumns({"_round": F.lit(number), "_order": F.transform(order, lambda s: s["i"])})
        parts.append(walked)
    walks = union_all(parts).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(k))))
    place = {c: F.array_position("_order", F.lit(i)) for i, c in enumerate(features)}
    kinds = dict(rows.dtypes)
    hybrid = walks.select(
        *[q(c) for c in other if c != key], q(key), "_round", "_step", "_order",
        *[F.when(place[c] <= F.col("_step"), q(c)).otherwise(F.col(f"_z_{c}")).cast(kinds[c]).alias(c) for c in features],
    )
    scored = score(hybrid).select(q(key), "_round", "_step", F.get("_order", F.col("_step") - 1).alias("_i"), "score")
    # the walks of a row stay together up to its averages, and a task gets a bounded number of them
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * rounds * (k + 1) // WALKED_ROWS + 1)
    walk = W.partitionBy(key, "_round").orderBy("_step")
    steps = scored.repartition(parts, q(key)).withColumn("_gain", F.col("score") - F.lag("score").over(walk)).where(F.col("_step") > 0)
    per_row = steps.groupBy(q(key), "_i").agg(F.avg("_gain").alias("_a"))
    names = constants(rows, list(enumerate(features)), ["_i", "feature"], ["int", "string"])
    return (
        per_row.groupBy("_i").agg(F.avg(F.abs("_a")).alias("mean_abs_attribution"))
        .join(F.broadcast(names), "_i")
        .select("feature", "mean_abs_attribution")
    )


# feature selection


def select_features(
    df: DataFrame, target: str, key: str, task: str = "classification", rounds: int = 12, keep: Sequence[str] = (), seed: int = 0,
    level: float = 0.05,
) -> DataFrame:
    """``(feature, hits, rounds, selected)`` after Boruta (Kursa and Rudnicki 2010).

    Shadow features are the cells of a permuted row; a feature scores a hit when its forest importance beats every
    shadow. It is selected when its hits are too many for chance at ``level`` (with the number of features).
    """
    features = fit_features(df, [target, key])
    names = feature_names(features)
    vector = vector_to_array(F.col(FEATURES))
    base = prepared(features, df.where(q(target).isNotNull()))
    columns = [f"f{i}" for i in range(len(names))]
    wide = base.select(q(key), q(target), *[vector[i].alias(c) for i, c in enumerate(columns)])
    wide = materialize(wide)
    ranked, n = ranked_rows(wide, key, seed)
    ranked = materialize(ranked)
    hits = [0] * len(names)
    if task == "classification":
        label = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(wide)
        wide = label.transform(wide)
    else:
        wide = wide.withColumn(LABEL, q(target).cast("double"))
    for number in range(rounds):
        mixed = _shifted(wide, ranked, n, key, columns, seed + number * 97 + 1, "s_")
        vectors = VectorAssembler(inputCols=columns + [f"s_{c}" for c in columns], outputCol=FEATURES).transform(mixed)
        # the forest reads its rows several times, so they are joined once; kept as they lie, since its samples follow the partitions
        vectors = vectors.select(FEATURES, LABEL).persist()
        kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
        forest = kind(featuresCol=FEATURES, labelCol=LABEL, numTrees=20, maxDepth=5, seed=seed + number, maxBins=MAX_LEVELS + 2)
        importance = forest.fit(vectors).featureImportances.toArray()
        vectors.unpersist()
        best_shadow = importance[len(names) :].max()
        hits = [h + int(importance[i] > best_shadow) for i, h in enumerate(hits)]
    rows = []
    for name, h in zip(names, hits):
        tail = sum(math.comb(rounds, j) for j in range(h, rounds + 1)) / 2**rounds
        rows.append((name, h, rounds, bool(tail * len(names) <= level or name in keep)))
    return constants(df, rows, ["feature", "hits", "rounds", "selected"], ["string", "int", "int", "boolean"])


def drop_unselected(selection: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """The same unimportant columns dropped from every frame."""
    dropped = [r["feature"] for r in selection.where(~F.col("selected")).select("feature").collect()]
    return [frame.drop(*dropped) for frame in frames]


# hardness of samples


def sample_hardness(
    df: DataFrame, target: str, key: str, exclude: Sequence[str] = (), checkpoints: int = 10, seed: int = 0
) -> DataFrame:
    """``(key, confidence, aleatoric, hardness)``: mean probability of the true class and mean
    ``p (1 - p)`` over training checkpoints.

    The growing ensembles of a boosted model are the training checkpoints. With several classes one model per class is
    fitted and the one of the true class is used.
    """
    known = df.where(q(target).isNotNull())
    features = fit_features(known, [target, key, *exclude])
    label = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(known)
    ready = materialize(label.transform(prepared(features, known)).select(q(key), FEATURES, LABEL))
    classes = len(label.labels)
    frames = []
    for c in range(classes) if classes > 2 else (1,):
        binary = ready.withColumn("_y", (F.col(LABEL) == c).cast("double"))
        model = GBTClassifier(
            featuresCol=FEATURES, labelCol="_y", maxIter=checkpoints, seed=seed, maxBins=MAX_LEVELS + 2
        ).fit(binary.select(FEATURES, "_y"))
        out = binary if classes == 2 else binary.where(F.col("_y") == 1)
        for t, tree in enumerate(model.trees):
            out = tree.setPredictionCol(f"_t{t}").transform(out)
        margin, probabilities = F.lit(0.0), []
        for t, weight in enumerate(model.treeWeights):
            margin = margin + F.lit(float(weight)) * F.col(f"_t{t}")
            p = 1 / (1 + F.exp(-2 * margin))
            probabilities.append(F.when(F.col("_y") == 1, p).otherwise(1 - p))
        frames.append(out.select(q(key), F.array(*probabilities).alias("_p")))
    p = union_all(frames)
    mean = lambda f: F.aggregate("_p", F.lit(0.0), lambda a, x: a + f(x)) / F.size("_p")
    scored = materialize(p.select(q(key), mean(lambda x: x).alias("confidence"), mean(lambda x: x * (1 - x)).alias("aleatoric")))
    middle = quantile_map(scored, ["aleatoric"], [0.5])["aleatoric"][0]
    sure = F.col("aleatoric") <= F.lit(middle)
    grade = (
        F.when((F.col("confidence") >= EASY_CONFIDENCE) & sure, "easy")
        .when((F.col("confidence") <= HARD_CONFIDENCE) & sure, "hard")
        .otherwise("ambiguous")
    )
    return scored.withColumn("hardness", grade)


def filter_hard(df: DataFrame, hardness: DataFrame, key: str, share: float) -> DataFrame:
    """Training rows without the given share of ambiguous and hard ones, least confident first."""


    flagged = hardness.where(F.col("hardness") != "easy").withColumn("_doubt", 1 - F.col("confidence"))
    return drop_worst(df, flagged, key, "_doubt", share)


def hardness_effect(
    train: DataFrame, test: DataFrame, target: str, key: str, share: float, candidates: Sequence[str] = ("linear_model",), seed: int = 0
) -> DataFrame:
    """``(data, model, metric, value)``: the study before and after the hard samples are filtered."""
    hardness = sample_hardness(train, target, key, seed=seed)
    kept = filter_hard(train, hardness, key, share)
    parts = []
    for name, frame in (("all", train), ("filtered", kept)):
        study = classification_study(frame, test, target, exclude=[key], folds=0, seed=seed, candidates=candidates)
        parts.append(study.scores.withColumn("data", F.lit(name)))
    return union_all(parts).select("data", "model", "metric", "value")


def weak_regions(
    train: DataFrame, test: DataFrame, key: str, columns: Sequence[str] | None = None, alpha: float = ALPHA, seed: int = 0
) -> DataFrame:
    """``(key, violations, width)``: test rows ranked by how many features fall outside conformal intervals predicted from
    the other features, then by the mean relative interval width.

    Residuals are divided by a second model of their size, so each row has intervals of its own width.
    """
    columns = [c for c in (columns if columns is not None else numeric_columns(train)) if c != key]
    filled = train.agg(*[F.avg(q(c)).alias(c) for c in columns]).first()
    spread = train.agg(*[F.stddev_pop(q(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()

    def cells(frame: DataFrame) -> DataFrame:
        return frame.select(q(key), *[F.coalesce(q(c).cast("double"), F.lit(float(filled[c] or 0.0))).alias(f"_{i}") for i, c in enumerate(columns)])

    split = uniform(seed, key) < 0.5
    proper, calibration = materialize(cells(train.where(split))), materialize(cells(train.where(~split)))
    out = materialize(cells(test))
    flags, widths = [], []
    for i in range(len(columns)):
        others = VectorAssembler(inputCols=[f"_{j}" for j in range(len(columns)) if j != i], outputCol="_f")
        model = LinearRegression(featuresCol="_f", labelCol=f"_{i}", predictionCol=f"_g{i}", regParam=1e-6).fit(others.transform(proper))
        size = F.abs(F.col(f"_{i}") - F.col(f"_g{i}"))
        sized = model.transform(others.transform(proper)).withColumn("_e", size)
        typical = float(sized.agg(F.avg("_e")).first()[0] or 0.0)
        spreads = LinearRegression(featuresCol="_f", labelCol="_e", predictionCol=f"_h{i}", regParam=1e-6).fit(sized)
        scale = F.greatest(F.col(f"_h{i}"), F.lit(max(LEAST_SPREAD * typical, 1e-12)))
        scored = spreads.transform(model.transform(others.transform(calibration))).select((size / scale).alias("_s"))
        limit = conformal_limit(scored, "_s", alpha)
        out = spreads.transform(model.transform(others.transform(out))).drop("_f")
        flags.append((size / scale > F.lit(limit)).cast("int"))
        widths.append(2 * F.lit(limit) * scale / (spread[f"_{i}"] or 1.0))
    violations, width = reduce(lambda a, b: a + b, flags), reduce(lambda a, b: a + b, widths) / len(widths)
    ranked = out.select(q(key), violations.alias("violations"), width.alias("width"))
    return ranked.orderBy(F.desc("violations"), F.desc("width"), key)


# train on one table, test on another


def utility_scores(
    train: DataFrame, test: DataFrame, target: str, task: str = "classification", exclude: Sequence[str] = (),
    names: Sequence[str] = ("linear_model", "mlp", "xgb"), seed: int = 0,
) -> DataFrame:
    """``(metric, value)``: score on ``test`` of each model trained on ``train``; F1 or R2. Regression has no ``mlp``."""
    if task == "classification":
        study = classification_study(train, test, target, exclude=exclude, folds=0, seed=seed, candidates=names)
        kept = "f1"
    else:
        study = regression_study(train, test, target, exclude=exclude, folds=0, seed=seed, candidates=[n for n in names if n != "mlp"])
        kept = "r2"
    return study.scores.where(F.col("metric") == kept).select(F.col("model").alias("metric"), "value")


def importances(df: DataFrame, target: str, task: str, exclude: Sequence[str], seed: int) -> dict[str, float]:
    features = fit_features(df, [target, *exclude])
    ready = prepared(features, df.where(q(target).isNotNull()))
    if task == "classification":
        ready = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(ready).transform(ready)
        forest = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=20, seed=seed, maxBins=MAX_LEVELS + 2)
    else:
        ready = ready.withColumn(LABEL, q(target).cast("double"))
        forest = RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=20, seed=seed, maxBins=MAX_LEVELS + 2)
    found = forest.fit(ready.select(FEATURES, LABEL)).featureImportances.toArray()
    return dict(zip(feature_names(features), found.tolist()))


def rank_distance(first: Mapping[str, float], second: Mapping[str, float]) -> float:
    """Kendall's tau of two rankings of the same features."""
    names = [n for n in first if n in second]
    agree = 0
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = first[a] - first[b], second[a] - second[b]
            agree += (x * y > 0) - (x * y < 0)
    pairs = len(names) * (len(names) - 1) / 2
    return agree / pairs if pairs else 1.0


def performance(
    real: DataFrame, syn: DataFrame, test: DataFrame, target: str, task: str = "classification", exclude: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """``(metric, gt, syn)``: models trained on real and on synthetic rows, both tested on held-out real rows, and the
    agreement of the feature rankings."""
    gt = utility_scores(real, test, target, task, exclude, seed=seed).withColumnRenamed("value", "gt")
    made = utility_scores(syn, test, target, task, exclude, seed=seed).withColumnRenamed("value", "syn")
    agreement = rank_distance(importances(real, target, task, exclude, seed), importances(syn, target, task, exclude, seed))
    extra = constants(real, [("feat_rank_distance", 1.0, agreement)], ["metric", "gt", "syn"], ["string", "double", "double"])
    return gt.join(made, "metric").unionByName(extra)


def augmentation_performance(
    real: DataFrame, augmentation: DataFrame, test: DataFrame, target: str, task: str = "classification", exclude: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """``(metric, gt, augmented)``: trained on real rows against real plus augmentation rows."""
    gt = utility_scores(real, test, target, task, exclude, seed=seed).withColumnRenamed("value", "gt")
    both = real.unionByName(augmentation, allowMissingColumns=True)
    made = utility_scores(both, test, target, task, exclude, seed=seed).withColumnRenamed("value", "augmented")
    return gt.join(made, "metric").withColumn("metric", F.concat("metric", F.lit("_augmentation")))
