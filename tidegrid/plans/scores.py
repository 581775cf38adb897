"""Queries on scored rows: the rule of thumb against the half-hour label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators import metrics
from tidegrid.plans.common import SCORED_SQL, rounded, scored

THRESHOLDS = (0.1, 0.3, 0.5, 0.7, 0.9)


def persistence_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("subject_id", "us", "score", "label")


def _crosstab(dimension: str):
    return lambda spark, folder: metrics.error_crosstab(scored(spark, folder), dimension)


QUERIES = {
    "persistence_scores": persistence_scores,
    "confusion_metrics": lambda s, d: rounded(metrics.confusion(scored(s, d)), 9),
    "roc_auc": lambda s, d: rounded(metrics.roc_auc(scored(s, d)), 9),
    "average_precision": lambda s, d: rounded(metrics.average_precision(scored(s, d)), 9),
    "brier": lambda s, d: rounded(metrics.brier(scored(s, d)), 9),
    "threshold_sweep": lambda s, d: rounded(metrics.threshold_sweep(scored(s, d), THRESHOLDS), 9),
    "best_f1_threshold": lambda s, d: rounded(metrics.best_f1_threshold(scored(s, d)), 9),
    "calibration_curve": lambda s, d: rounded(metrics.reliability(scored(s, d)), 9),
    "subject_metrics": lambda s, d: rounded(metrics.subject_metrics(scored(s, d)), 9),
    "error_rows": lambda s, d: rounded(metrics.error_rows(scored(s, d)).drop("insulin_bolus_last_30m", "carbs_last_30m"), 6),
} | {f"error_crosstab_{name}": _crosstab(name) for name in metrics.DIMENSIONS}

_Y, _P = "label = 1", "score >= 0.5"


def _counts(p: str = _P) -> str:
    return f"count(*) FILTER (label = 1 AND {p}) AS tp, count(*) FILTER (label = 0 AND NOT {p}) AS tn, count(*) FILTER (label = 0 AND {p}) AS fp, count(*) FILTER (label = 1 AND NOT {p}) AS fn"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


_PRECISION, _RECALL, _F1 = _share("tp", "tp + fp"), _share("tp", "tp + fn"), _share("2 * tp", "2 * tp + fp + fn")
_AUC = """(SELECT k, (sum(r) FILTER (label = 1) - pos * (pos + 1) / 2.0) / (pos * neg) AS roc_auc FROM (
  SELECT {key} AS k, label, (rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0)::DOUBLE AS r,
    (count(*) FILTER (label = 1) OVER (PARTITION BY {key}))::DOUBLE AS pos, (count(*) FILTER (label = 0) OVER (PARTITION BY {key}))::DOUBLE AS neg FROM known)
  WHERE pos > 0 AND neg > 0 GROUP BY k, pos, neg)"""
_AP = """(SELECT k, sum(p * cp::DOUBLE / cn) / max(cp) AS pr_auc FROM (
  SELECT k, p, sum(p) OVER (PARTITION BY k ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY k ORDER BY score DESC) AS cn FROM (
    SELECT {key} AS k, score, count(*) AS n, count(*) FILTER (label = 1) AS p FROM known GROUP BY ALL)) GROUP BY k HAVING max(cp) > 0 AND max(cn) > max(cp))"""


def _bins(value: str, edges, low: str | None = None) -> str:
    cases = (f"WHEN {value} < {low} THEN NULL " if low else "") + " ".join(f"WHEN {value} <= {'1e308' if edge == float('inf') else edge} THEN '{name}'" for edge, name in edges)
    return f"CASE {cases} END"


_DIMENSIONS = {
    "glucose": _bins("glucose_current", metrics.GLUCOSE_EDGES, "0"),
    "roc": _bins("glucose_roc_5m", metrics.ROC_EDGES),
    "night": "CAST(is_night_clock_based AS VARCHAR)",
    "bolus": "CASE WHEN bolus_insulin_recent > 0 THEN '1' ELSE '0' END",
    "carbs": "CASE WHEN carbs_recent > 0 THEN '1' ELSE '0' END",
    "gap": "CASE WHEN minutes_since_last_glucose > 15 THEN '1' ELSE '0' END",
}
_CONFUSION = f"""SELECT *, {_PRECISION} AS precision, {_RECALL} AS recall, {_F1} AS f1, {_share('tn', 'tn + fp')} AS specificity, {_share('tp + fn', 'tp + tn + fp + fn')} AS prevalence,
  ({_RECALL} + {_share('tn', 'tn + fp')}) / 2 AS balanced_accuracy FROM (SELECT {_counts()} FROM known)"""


def _round(columns: str, source: str, digits: int = 9, keep: str = "") -> str:
    return f"SELECT {keep}{', ' if keep else ''}{', '.join(f'round({c}, {digits}) AS {c}' for c in columns.split())} FROM ({source})"


_SWEEP = "SELECT t AS threshold, {counts} FROM known CROSS JOIN thresholds GROUP BY t".format(counts=_counts("score >= t"))

SQL = {
    "persistence_scores": f"WITH {SCORED_SQL} SELECT subject_id, us, score, label FROM scored",
    "confusion_metrics": f"WITH {SCORED_SQL} " + _round("precision recall f1 specificity prevalence balanced_accuracy", _CONFUSION, keep="tp, tn, fp, fn"),
    "roc_auc": f"WITH {SCORED_SQL} SELECT round(roc_auc, 9) AS roc_auc FROM {_AUC.format(key='0')}",
    "average_precision": f"WITH {SCORED_SQL} SELECT round(pr_auc, 9) AS pr_auc FROM {_AP.format(key='0')}",
    "brier": f"WITH {SCORED_SQL} SELECT round(avg((score - label) * (score - label)), 9) AS brier FROM known",
    "threshold_sweep": f"WITH {SCORED_SQL}, thresholds(t) AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[])) " + _round("precision recall f1 specificity balanced_accuracy", f"SELECT *, {_PRECISION} AS precision, {_RECALL} AS recall, {_F1} AS f1, {_share('tn', 'tn + fp')} AS specificity, ({_RECALL} + {_share('tn', 'tn + fp')}) / 2 AS balanced_accuracy FROM ({_SWEEP}) WHERE tp + fn > 0 AND tn + fp > 0", keep="threshold, tp, tn, fp, fn"),
    "best_f1_threshold": f"WITH {SCORED_SQL}, thresholds(t) AS (SELECT 0.05::DOUBLE + 0.9::DOUBLE * i / 49 FROM range(50) r(i)), f AS (SELECT threshold, {_F1} AS f1 FROM ({_SWEEP}))"
    " SELECT round(CASE WHEN (SELECT max(f1) FROM f) > 0 THEN (SELECT min(threshold) FROM f WHERE f1 = (SELECT max(f1) FROM f)) ELSE 0.5 END, 9) AS best_threshold, (SELECT round(max(f1), 9) FROM f) AS best_f1",
    "calibration_curve": f"WITH {SCORED_SQL} SELECT {' + '.join(f'CAST(score > {i}::DOUBLE / 10 AS INTEGER)' for i in range(1, 10))} AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS share_positive FROM known GROUP BY 1",
    "subject_metrics": f"""WITH {SCORED_SQL},
c AS (SELECT subject_id, {_counts()}, avg((score - label) * (score - label)) AS b FROM known GROUP BY subject_id)
SELECT subject_id, tp + tn + fp + fn AS windows, tp + fn AS positives, tn + fp AS negatives, round(CASE WHEN tp + fn > 0 THEN {_RECALL} END, 9) AS recall, round({_PRECISION}, 9) AS precision, round({_F1}, 9) AS f1,
  round(a.roc_auc, 9) AS roc_auc, round(p.pr_auc, 9) AS pr_auc, round(b, 9) AS brier
FROM c LEFT JOIN {_AUC.format(key='subject_id')} a ON a.k = subject_id LEFT JOIN {_AP.format(key='subject_id')} p ON p.k = subject_id""",
    "error_rows": f"WITH {SCORED_SQL} SELECT subject_id, us, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_type, label AS true_label, CAST({_P} AS INTEGER) AS predicted_label, round(glucose_current, 6) AS glucose_current, round(glucose_roc_5m, 6) AS glucose_roc_5m, is_night_clock_based FROM known WHERE (label = 1) <> ({_P})",
} | {
    f"error_crosstab_{name}": f"""WITH {SCORED_SQL} SELECT bin, count(*) FILTER (label = 0 AND NOT {_P}) AS "TN", count(*) FILTER (label = 0 AND {_P}) AS "FP", count(*) FILTER (label = 1 AND NOT {_P}) AS "FN", count(*) FILTER (label = 1 AND {_P}) AS "TP"
FROM (SELECT *, {bin_} AS bin FROM known) WHERE bin IS NOT NULL GROUP BY bin"""
    for name, bin_ in _DIMENSIONS.items()
}
