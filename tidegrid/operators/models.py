"""Classifiers on feature frames, their calibration and bootstrap uncertainty, by pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import metrics
from tidegrid.operators.splits import resampled
from tidegrid.session import with_row

#: Feature names of the three configurations (those a frame lacks are skipped).
BASELINE = (
    "glucose_current", "glucose_roc_5m", "glucose_roc_15m", "glucose_roc_30m", "glucose_mean_30m", "glucose_std_30m", "glucose_min_30m", "glucose_max_30m",
    "insulin_recent_sum", "carbs_recent_sum", "time_since_meal", "time_since_bolus", "patient_glucose_baseline", "hour_of_day", "steps_available",
)
TWIN = (
    "twin_glucose_current", "twin_insulin_action", "twin_insulin_state", "twin_meal_state", "twin_context_state", "twin_glucose_t5", "twin_glucose_t15",
    "twin_glucose_t30", "twin_glucose_t60", "twin_slope_30m", "twin_slope_60m", "twin_delta_15m", "twin_delta_30m", "twin_delta_60m",
    "twin_residual_current", "twin_has_long_gap", "twin_has_missing_glucose", "twin_uncertainty_calibrated",
)
CONFIGURATIONS = {"baseline": BASELINE, "twin_only": TWIN, "hybrid": BASELINE + TWIN}


#: Trees without a lower validation loss after which training counts as finished.
PATIENCE = 20
#: Rows of a training partition, at least: every level of every tree is a job, so tiny partitions cost more than they spread.
PARTITION_ROWS = 50_000
#: Models trained at the same time.
AT_ONCE = 5


def compact(df: DataFrame) -> DataFrame:
    """df in no more partitions than its rows need (it is counted)."""
    return df.coalesce(max(1, -(-df.count() // PARTITION_ROWS)))


def together(make: Callable, what: Sequence) -> list:
    """make of each, several at a time: their many small jobs share the executors."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(make, what))


def features_of(df: DataFrame, configuration: str) -> list[str]:
    return [c for c in CONFIGURATIONS[configuration] if c in df.columns]


def prepared(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with a known label, features without NULL (0 instead), and weights that balance the classes."""
    df = df.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")).fillna(0.0, list(features))
    share = df.agg(F.avg("label").alias("p")).first()["p"]
    if share in (None, 0.0, 1.0):
        return df.withColumn("weight", F.lit(1.0))
    return df.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def boosted(train: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 5, rate: float = 0.05, seed: int = 42, validation: str | None = None, stop: DataFrame | None = None):
    """Gradient-boosted trees. With rows to stop by, the model has the trees up to their least loss before PATIENCE trees without a lower one;
    with `validation`, training itself stops, at the first tree that gains too little on rows where that column is true."""
    stages = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    if validation:
        stages = stages.setValidationIndicatorCol(validation)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), stages]).fit(compact(train))
    if stop is None or stop.isEmpty():
        return model
    stop = compact(stop)
    assembler, grown = model.stages
    return PipelineModel([assembler, first_trees(grown, best_size(grown.evaluateEachIteration(assembler.transform(stop))))])


def best_size(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Number of trees of the least loss, as far as training with that patience would have come."""
    best = 0
    for k, loss in enumerate(losses):
        if k - best > patience:
            break
        if loss < losses[best]:
            best = k
    return best + 1


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first n trees. Columns have their default names."""
    if n >= model.getNumTrees:
        return model
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    jvm, grown = gateway.jvm, java.trees()
    trees, weights = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = grown[k], float(model.treeWeights[k])
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, model.numFeatures))


def scored(model, df: DataFrame) -> DataFrame:
    """df with score, the probability of class 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def evaluate(df: DataFrame, threshold: float) -> DataFrame:
    """One row of metrics of scored rows."""
    d = metrics.confusion(df, threshold, single_class=True).select("tp", "tn", "fp", "fn", "precision", "recall", "f1")
    for other in (metrics.roc_auc(df), metrics.average_precision(df), metrics.brier(df)):
        d = with_row(d, other)
    return d


def compared(df: DataFrame, label: str, configurations: Sequence[str] = tuple(CONFIGURATIONS), **training) -> DataFrame:
    """Metrics on the test rows of each configuration, trained on train rows and stopped by validation rows; the threshold is that of the best F1 on the validation
    rows. df has a split column."""

    def one(name: str) -> DataFrame:
        features = features_of(df, name)
        rows = prepared(df, features, label)
        validation = rows.where(F.col("split") == "validation")
        model = boosted(rows.where(F.col("split") == "train"), features, stop=validation, **training)
        threshold = metrics.best_f1_threshold(scored(model, validation)).first()["best_threshold"]
        return evaluate(scored(model, rows.where(F.col("split") == "test")), threshold).select(F.lit(name).alias("configuration"), F.lit(len(features)).alias("n_features"), F.lit(threshold).alias("threshold"), "*")

    return reduce(DataFrame.unionByName, together(one, configurations))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def isotonic(validation: DataFrame, df: DataFrame) -> DataFrame:
    """calibrated: score mapped by isotonic regression on validation rows, clipped to what they hold."""
    model = IsotonicRegression(featuresCol="score", labelCol="label").fit(validation.select("score", "label"))
    return model.transform(df).withColumnRenamed("prediction", "calibrated")


def platt(validation: DataFrame, df: DataFrame) -> DataFrame:
    """calibrated: score mapped by a logistic curve on validation rows, lightly regularised."""
    n = max(1, validation.count())
    stages = [VectorAssembler(inputCols=["score"], outputCol="score_vector"), LogisticRegression(featuresCol="score_vector", labelCol="label", regParam=1.0 / n, standardization=False, probabilityCol="calibrated_vector", rawPredictionCol="calibrated_raw", predictionCol="calibrated_class")]
    out = Pipeline(stages=stages).fit(validation).transform(df)
    return out.withColumn("calibrated", vector_to_array("calibrated_vector")[1]).drop("score_vector", "calibrated_vector", "calibrated_raw", "calibrated_class")


def calibrated(validation: DataFrame, df: DataFrame, enough: int = 1000) -> DataFrame:
    """Isotonic where there are enough validation rows, else Platt."""
    return isotonic(validation, df) if validation.count() >= enough else platt(validation, df)


def bootstrap(train: DataFrame, df: DataFrame, features: Sequence[str], key: Sequence[str] = ("subject_id", "us"), members: int = 10, seed: int = 42, **training) -> DataFrame:
    """Mean, 5th and 95th percentile and deviation of the scores of members trained on resamples."""

    def one(member: int) -> DataFrame:
        model = boosted(resampled(train, member, seed), features, seed=seed + member, **training)
        return scored(model, df).select(*key, F.lit(member).alias("member"), "score")

    return metrics.ensemble_stats(reduce(DataFrame.unionByName, together(one, range(members))), key)
