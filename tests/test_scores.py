import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import metrics, models
from tidegrid.plans import simulation
from tidegrid.sources import generated


def frame(spark, seed=0, n=400, ties=True):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1)
    s = np.round(s, 1) if ties else s
    return y, s, spark.createDataFrame([(int(a), float(b), "ab"[i % 2]) for i, (a, b) in enumerate(zip(y, s))] + [(None, 0.5, "a"), (1, None, "a")], "label int, score double, g string")


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def brute_ap(y, s):
    total, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - before) * y[hit].mean()
        before = recall
    return total


@pytest.mark.parametrize("ties", [True, False])
def test_rank_metrics(spark, ties):
    y, s, d = frame(spark, ties=ties)
    assert metrics.roc_auc(d).first().roc_auc == pytest.approx(brute_auc(y, s))
    assert metrics.average_precision(d).first().pr_auc == pytest.approx(brute_ap(y, s))
    by = {r.g: r.roc_auc for r in metrics.roc_auc(d, ["g"]).collect()}
    assert by["a"] == pytest.approx(brute_auc(y[::2], s[::2])) and by["b"] == pytest.approx(brute_auc(y[1::2], s[1::2]))


def test_thresholds_and_calibration(spark):
    y, s, d = frame(spark)
    row = metrics.confusion(d, 0.5).first()
    assert (row.tp, row.fp) == (int(((s >= 0.5) & (y == 1)).sum()), int(((s >= 0.5) & (y == 0)).sum()))
    assert metrics.brier(d).first().brier == pytest.approx(np.mean((s - y) ** 2))
    best = metrics.best_f1_threshold(d).first()
    f1 = lambda t: 2 * ((s >= t) & (y == 1)).sum() / max(1, (s >= t).sum() + y.sum())
    grid = np.linspace(0.05, 0.95, 50)
    assert best.best_f1 == pytest.approx(max(map(f1, grid))) and best.best_threshold == pytest.approx(grid[int(np.argmax([f1(t) for t in grid]))])
    bins = metrics.reliability(d).orderBy("bin").collect()
    assert sum(b.n for b in bins) == len(y) and bins[0].mean_score <= bins[-1].mean_score
    assert metrics.best_f1_threshold(d.where("label = 0")).first().best_threshold == 0.5


def test_single_class_and_empty(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.roc_auc(one).first().roc_auc is None and metrics.average_precision(one).first().pr_auc is None
    assert metrics.brier(one, single_class=False).first().brier is None
    none = one.limit(0)
    assert metrics.roc_auc(none).first().roc_auc is None and metrics.confusion(none).first().f1 is None and metrics.confusion(none, single_class=True).first().f1 == 0
    row = metrics.confusion(one).first()
    assert (row.tp, row.precision, row.recall, row.specificity, row.balanced_accuracy, row.prevalence) == (2, None, None, None, None, 1.0)
    assert metrics.threshold_sweep(one, [0.3, 0.6]).count() == 0 and metrics.threshold_sweep(one, [0.3, 0.6], single_class=True).count() == 2
    assert metrics.reliability(none).count() == 0


def test_bins(spark):
    d = spark.createDataFrame([(float(v),) for v in (0, 54, 54.1, 70, 90, 600, 601, -1)], "v double")
    got = [r[0] for r in d.select(metrics.binned(F.col("v"), metrics.GLUCOSE_EDGES, 0)).collect()]
    assert got == ["<54", "<54", "54-70", "54-70", "70-90", ">250", None, None]


def test_forecast_error(spark):
    d = spark.createDataFrame(list(zip([120.0, 99.0, 101.5, 88.0, 93.0, 140.0, None, float("nan")], [118.0, 102.0, 101.0, 92.0, 93.0, 137.0, 1.0, 1.0])), "p double, o double")
    row = metrics.forecast_error(d, "p", "o").first()
    assert row.n_valid == 6 and row.mae == pytest.approx(12.5 / 6) and row.bias == pytest.approx(-1.5 / 6) and row.median_ae == 2.5
    empty = metrics.forecast_error(d.limit(0), "p", "o").first()
    assert empty.n_valid == 0 and empty.mae is None and empty.median_ae is None


def test_median_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 5001)] + [("b", float(v)) for v in rng.integers(0, 3, 4000)] + [("c", 1.0), ("d", None), ("e", 4.0), ("e", 5.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in metrics.median(d, "v", ["g"]).collect()}
    want = {g: float(np.median([v for k, v in rows if k == g and v is not None])) for g in "abce"}
    assert got == want and metrics.median(d, "v").first()["median"] == float(np.median([v for _, v in rows if v is not None]))


def test_buckets_of_scores_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 3000), np.round(rng.beta(0.3, 3, 3000), 3)
    d = spark.createDataFrame(list(zip(y.tolist(), s.tolist(), ["a", "b", "b"] * 1000)), "label int, score double, g string")
    result = lambda: [sorted(map(tuple, f(d, k).collect())) for f in (metrics.roc_auc, metrics.average_precision) for k in ((), ("g",))]
    whole = result()
    monkeypatch.setattr(metrics, "BUCKET_SCORES", 7)
    for a, b in zip(whole, result()):
        assert [x[:-1] for x in a] == [x[:-1] for x in b] and [x[-1] for x in a] == pytest.approx([x[-1] for x in b], abs=1e-12)


def test_models(spark):
    names = ["glucose_current", "glucose_roc_5m"]
    rows = models.prepared(generated.modelling_frame(spark, 1500), names, "future_hypoglycemia_30m").withColumn("split", F.when(F.rand(1) < 0.6, "train").when(F.rand(2) < 0.5, "validation").otherwise("test")).persist()
    model = models.boosted(rows.where("split = 'train'"), names, trees=5, depth=3)
    scored = models.scored(model, rows.where("split = 'test'"))
    assert metrics.roc_auc(scored).first().roc_auc > 0.9
    assert [n for n, _ in models.importances(model, names)][0] in names
    validation = models.scored(model, rows.where("split = 'validation'"))
    raw = metrics.brier(scored).first().brier
    for method in (models.isotonic, models.platt, models.calibrated):
        out = method(validation, scored).withColumn("score", F.col("calibrated"))
        row = out.agg(F.min("score"), F.max("score")).first()
        assert 0 <= row[0] <= row[1] <= 1 and metrics.brier(out).first().brier < raw + 0.05
    band = models.bootstrap(rows.where("split = 'train'"), rows.where("split = 'test'").limit(50), names, members=2, trees=3, depth=2)
    assert band.where("lower_5pct <= mean_prob and mean_prob <= upper_95pct and std >= 0").count() == band.count() == 50
    rows.unpersist()


def test_model_queries_are_the_whole_job(spark, monkeypatch):
    asked, whole = [], models.boosted
    frame = generated.modelling_frame(spark, 300).withColumn("split", F.when(F.rand(1) < 0.6, "train").when(F.rand(2) < 0.5, "validation").otherwise("test")).persist()

    def small(*args, **training):
        call = inspect.signature(whole).bind(*args, **training)
        call.apply_defaults()
        asked.append((call.arguments["trees"], call.arguments["depth"], call.arguments["stop"] is not None))
        return whole(*args, **training | {"trees": 1, "depth": 1})

    monkeypatch.setattr(models, "boosted", small)
    monkeypatch.setattr(simulation, "hybrid_frame", lambda s, d: frame)
    for name, calls in {"model_abc": 3, "feature_importance": 1, "calibrate_isotonic": 1, "calibrate_platt": 1, "bootstrap_uncertainty": 10}.items():
        asked.clear()
        monkeypatch.setattr(models, "CONFIGURATIONS", dict.fromkeys(("baseline", "twin_only", "hybrid"), ("glucose_current", "glucose_roc_5m")))
        simulation.QUERIES[name](spark, "")
        assert asked == [(100, 5, name != "bootstrap_uncertainty")] * calls, name
    frame.unpersist()


def test_training_is_stopped_by_validation_rows(spark):
    assert models.best_size([3.0, 2.0, 2.5, 1.0]) == 4 and models.best_size([2.0] + [3.0] * 21 + [1.0]) == 1 and models.best_size([2.0] + [3.0] * 19 + [1.0]) == 21
    names = ["glucose_current", "glucose_roc_5m"]
    rows = models.prepared(generated.modelling_frame(spark, 300), names, "future_hypoglycemia_30m").persist()
    wrong = rows.withColumn("label", 1 - F.col("label"))
    stopped, short = models.boosted(rows, names, trees=4, depth=2, stop=wrong), models.boosted(rows, names, trees=1, depth=2)
    assert stopped.stages[-1].getNumTrees == 1
    result = lambda m: sorted(r.score for r in models.scored(m, rows).select("score").collect())
    assert result(stopped) == result(short) and len(models.importances(stopped, names)) == 2
    assert models.boosted(rows, names, trees=4, depth=2, stop=rows.limit(0)).stages[-1].getNumTrees == 4
    rows.unpersist()
