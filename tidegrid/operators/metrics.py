"""Classification, ranking, calibration and forecast metrics as aggregates.

Frames of scored rows have `label` (1 or 0) and `score`; `keys` are columns to group by. Rows with a NULL label or score are left out.
Rank metrics first aggregate by distinct score, so that what is sorted is the distinct scores only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.session import checkpointed, with_row

#: Most ordered buckets of scores for running sums, and distinct scores of one on average.
BUCKETS, BUCKET_SCORES = 4096, 16_384
#: Accuracy of the quantiles that bracket a median.
ACCURACY = 10_000


def known(df: DataFrame) -> DataFrame:
    return df.where(F.col("label").isNotNull() & F.col("score").isNotNull())


def ratio(a: Column, b: Column, empty: Column | None = None) -> Column:
    return F.when(b > 0, a / b).otherwise(empty if empty is not None else F.lit(0.0))


def shares(d: DataFrame, single_class: bool) -> DataFrame:
    """Adds what follows from the counts tp, tn, fp, fn; a share with an empty denominator is 0. Where the labels have one class only,
    all but the prevalence are NULL unless single_class."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    told = F.lit(True) if single_class else (tp + fn > 0) & (tn + fp > 0)
    d = d.select("*", *(F.when(told, x).alias(name) for x, name in ((ratio(tp, tp + fp), "precision"), (ratio(tp, tp + fn), "recall"), (ratio(2 * tp, 2 * tp + fp + fn), "f1"), (ratio(tn, tn + fp), "specificity"))))
    return d.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def confusion(df: DataFrame, threshold: float | str = 0.5, keys: Sequence[str] = (), single_class: bool = False) -> DataFrame:
    """Confusion counts and what follows from them: precision, recall, f1, specificity, balanced_accuracy (see shares) and prevalence."""
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    y, p = F.col("label") == 1, F.col("score") >= cut
    d = known(df).groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    positive = F.col("tp") + F.col("fn")
    return shares(d, single_class).withColumn("prevalence", ratio(positive, positive + F.col("tn") + F.col("fp")))


def by_score(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return known(df).groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"))


def running(d: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds n_before and p_before: rows and positives of the scores before each (lower, or higher if descending).

    Scores fall into at most BUCKETS ordered buckets between approximate quantiles of the distinct scores; running sums inside a bucket and of
    the buckets' totals add up, so no task sorts all scores of a group. d (see by_score) is read several times.
    """
    wanted = min(BUCKETS, d.count() // BUCKET_SCORES + 1)
    borders = d.agg(F.percentile_approx("score", F.array(*(F.lit(i / wanted) for i in range(1, wanted))), F.lit(4 * BUCKETS)).alias("b")).first()["b"] if wanted > 1 else []
    splits = [-float("inf"), *sorted({float(b) for b in borders or [] if abs(b) != float("inf")}), float("inf")]
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="score", outputCol="bucket", handleInvalid="keep").transform(d).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        d = d.withColumn("bucket", F.lit(0))
    d = d.withColumn("bucket", -F.col("bucket") if descending else F.col("bucket"))
    order = F.desc("score") if descending else F.asc("score")
    inside = Window.partitionBy(*keys, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "bucket", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_offset") for c in ("n", "p")))
    offsets = offsets if keys else F.broadcast(offsets)  # without keys at most BUCKETS + 1 rows
    d = d.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in ("n", "p")))
    for key in keys:
        d = d.where(F.col(key).isNotNull())
    d = d.join(offsets, [*keys, "bucket"])
    return d.select("*", *((F.col(f"{c}_inside") + F.col(f"{c}_offset")).alias(f"{c}_before") for c in ("n", "p")))


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """roc_auc by rank sums with ties averaged; NULL with a single class. Rows with a NULL key are left out."""
    return roc_of(checkpointed(by_score(df, keys)), keys)


def roc_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = running(counts, keys).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
    d = d.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"))
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg")))
    return d.select(*keys, auc.alias("roc_auc"))


def average_precision(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """pr_auc: precision at every distinct score, weighted by the recall gained there; NULL with a single class."""
    return precision_of(checkpointed(by_score(df, keys)), keys)


def precision_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = running(counts, keys, descending=True)
    d = d.withColumn("precision", (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n")))
    d = d.groupBy(*keys).agg(F.sum(F.col("p") * F.col("precision")).alias("s"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return d.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("s") / F.col("pos")).alias("pr_auc"))


def brier(df: DataFrame, keys: Sequence[str] = (), single_class: bool = True) -> DataFrame:
    """Mean squared distance of score and label; NULL with a single class unless single_class."""
    value = F.avg(F.pow(F.col("score") - F.col("label"), 2))
    both = F.countDistinct("label") > 1
    return known(df).groupBy(*keys).agg((value if single_class else F.when(both, value)).alias("brier"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), single_class: bool = False) -> DataFrame:
    """Confusion counts and metrics at each threshold; no rows where the labels have one class only, unless single_class. Rows are
    first counted by score, so the list of thresholds meets the distinct scores only."""
    counts = by_score(df, keys).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    hit = F.col("score") >= F.col("threshold")
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    total = lambda w, c: F.sum(F.when(w, c).otherwise(0))
    d = counts.groupBy(*keys, "threshold").agg(total(hit, pos).alias("tp"), total(~hit, neg).alias("tn"), total(hit, neg).alias("fp"), total(~hit, pos).alias("fn"))
    return shares(d, single_class).where(F.col("f1").isNotNull())


def best_f1_threshold(df: DataFrame, n: int = 50, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(best_threshold, best_f1): the lowest of n even thresholds with the largest F1; 0.5 if every F1 is 0."""
    grid = [low + (high - low) * i / (n - 1) for i in range(n)]
    best = threshold_sweep(df, grid, single_class=True).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f"))
    return best.select(F.when(F.col("f") > 0, F.col("t")).otherwise(F.lit(0.5)).alias("best_threshold"), F.coalesce("f", F.lit(0.0)).alias("best_f1"))


def reliability(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share_positive) of the non-empty ones of n even bins; a score on an edge falls to the lower bin."""
    bin_ = reduce(lambda a, b: a + b, ((F.col("score") > F.lit(i / n_bins)).cast("int") for i in range(1, n_bins)))
    return known(df).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("share_positive"))


def subject_metrics(df: DataFrame, threshold: float = 0.5, key: str = "subject_id") -> DataFrame:
    """Per subject: windows, positives and negatives, rank metrics (NULL with a single class), recall (NULL without positives), precision,
    F1 and Brier score."""
    counts = checkpointed(by_score(df, [key]))  # what follows only sees distinct scores
    hit, pos, neg = F.col("score") >= threshold, F.col("p"), F.col("n") - F.col("p")
    d = counts.groupBy(key).agg(
        F.sum("n").alias("windows"), F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        (F.sum(F.col("n") * F.col("score") * F.col("score") - 2 * F.col("score") * pos + pos) / F.sum("n")).alias("brier"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    base = d.select(key, "windows", "positives", "negatives", F.when(F.col("positives") > 0, tp / F.col("positives")).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, tp + fp + F.col("positives")).alias("f1"), "brier")
    return base.join(roc_of(counts, [key]), key).join(precision_of(counts, [key]), key)


#: Edges of the glucose and rate bins and their names, and the order of the outcomes.
GLUCOSE_EDGES = ((54, "<54"), (70, "54-70"), (90, "70-90"), (120, "90-120"), (180, "120-180"), (250, "180-250"), (600, ">250"))
ROC_EDGES = ((-2.0, "<<-2"), (-1.0, "-2..-1"), (-0.5, "-1..-0.5"), (0.5, "stable"), (1.0, "0.5..1"), (2.0, "1..2"), (float("inf"), ">>2"))
OUTCOMES = ("TN", "FP", "FN", "TP")


def binned(value: Column, edges, low: float | None = None) -> Column:
    """Name of the right-closed bin; the first also holds its lower edge `low`; NULL outside."""
    out = F.when(value < low, None) if low is not None else F.when(F.lit(False), None)
    for edge, name in edges:
        out = out.when(value <= edge, name)
    return out


def outcome(threshold: float = 0.5) -> Column:
    y, p = F.col("label") == 1, F.col("score") >= threshold
    return F.when(y & p, "TP").when(y, "FN").when(p, "FP").otherwise("TN")


#: Dimension of the error tables by name: the column it is of and its values.
DIMENSIONS = {
    "glucose": lambda: binned(F.col("glucose_current"), GLUCOSE_EDGES, 0),
    "roc": lambda: binned(F.col("glucose_roc_5m"), ROC_EDGES),
    "night": lambda: F.col("is_night_clock_based").cast("string"),
    "bolus": lambda: F.coalesce(F.col("bolus_insulin_recent") > 0, F.lit(False)).cast("int").cast("string"),
    "carbs": lambda: F.coalesce(F.col("carbs_recent") > 0, F.lit(False)).cast("int").cast("string"),
    "gap": lambda: F.coalesce(F.col("minutes_since_last_glucose") > 15, F.lit(False)).cast("int").cast("string"),
}


def error_crosstab(df: DataFrame, dimension: str, threshold: float = 0.5) -> DataFrame:
    """Counts of each outcome by a dimension's bins; rows outside every bin are left out."""
    rows = known(df).select(DIMENSIONS[dimension]().alias("bin"), outcome(threshold).alias("outcome")).where(F.col("bin").isNotNull())
    return rows.groupBy("bin").pivot("outcome", list(OUTCOMES)).count().fillna(0, list(OUTCOMES))


def error_rows(df: DataFrame, threshold: float = 0.5, context: Sequence[str] = ("glucose_current", "glucose_roc_5m", "insulin_bolus_last_30m", "carbs_last_30m", "is_night_clock_based")) -> DataFrame:
    """False positives and negatives with the context columns that exist."""
    rows = known(df).withColumn("error_type", outcome(threshold)).where(F.col("error_type").isin("FP", "FN"))
    keys = [c for c in ("subject_id", "us") if c in df.columns]
    return rows.select(*keys, "error_type", F.col("label").cast("int").alias("true_label"), (F.col("score") >= threshold).cast("int").alias("predicted_label"), *(c for c in context if c in df.columns))


def persistence(low: float = schema.LOW) -> Column:
    """Score of the rule of thumb: high when already low, less when just above and falling; 0 otherwise."""
    g, roc = F.col("glucose_current"), F.col("glucose_roc_5m")
    close = (g >= low) & (g < low + 15)
    return F.when(g < low, 0.9).when(close & (roc < -1.0), 0.7).when(close & (roc >= -1.0) & (roc < 0), 0.4).otherwise(0.0)


def forecast_error(df: DataFrame, predicted: str, observed: str, keys: Sequence[str] = ()) -> DataFrame:
    """(n_valid, mae, rmse, median_ae, bias) over the pairs without NULL or NaN, by the keys (without NULL)."""
    p, o = F.col(predicted), F.col(observed)
    e = checkpointed(df.select(*keys, F.when(~F.isnan(p) & ~F.isnan(o), p - o).alias("e")))
    size = F.abs("e")
    d = e.groupBy(*keys).agg(F.count("e").alias("n_valid"), F.avg(size).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))
    middle = median(e.select(*keys, size.alias("size")), "size", keys)
    d = d.join(middle, list(keys), "left") if keys else with_row(d, middle)
    return d.select(*keys, "n_valid", "mae", "rmse", F.col("median").alias("median_ae"), "bias")


def median(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, median) without NULL values: exact, interpolated between two middle ones. df is read twice.

    Approximate quantiles bracket the median, so that only about 1 in 1,000 rows, counted by value, meet in the window of a key.
    """
    df = df.where(F.col(value).isNotNull())
    beside = [F.lit(0.5 - 3 / ACCURACY), F.lit(0.5 + 3 / ACCURACY)]
    around = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*beside), F.lit(ACCURACY)).alias("_q"), F.count("*").alias("_n"))
    around = around.select(*keys, F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"), "_n")
    d = df.join(around, list(keys)) if keys else with_row(df, around)
    place = F.when(F.col(value) >= F.col("_low"), F.col(value))  # what lies below counts together
    d = d.where(F.col(value) <= F.col("_high")).groupBy(*keys, "_n", place.alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    return d.groupBy(*keys).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2).alias("median"))


def ensemble_stats(df: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Over the members of each key: mean, 5th and 95th percentile (interpolated) and population deviation."""
    return df.groupBy(*key).agg(F.avg(score).alias("mean_prob"), F.percentile(score, 0.05).alias("lower_5pct"), F.percentile(score, 0.95).alias("upper_95pct"), F.stddev_pop(score).alias("std"))
