from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import leaderboard as L, memberships as H, metrics as M, sampling as G
from tracefold.protocol import PRIORITY, SEVERITY, LabelScheme
from tracefold.sources.stores import ResultStore


def test_metrics_use_two_class_lists(spark):
    pairs = spark.createDataFrame([("T", "A", "A"), ("T", "B", "A")], "task string, y_true string, y_pred string")
    orders = {"T": ("A", "B", "C")}
    cells = M.confusion_counts(pairs, ["task"])
    classes = M.per_class(cells, ["task"], orders)
    got = M.scalar_metrics(classes, ["task"]).first()
    assert got["macro_f1"] == pytest.approx((2 / 3) / 3)
    assert got["balanced_accuracy"] == pytest.approx(0.5)
    assert {r["class"]: r["support"] for r in classes.collect()}["C"] == 0
    matrix = M.matrix_rows(M.confusion_matrix(cells, ["task"], orders), ["task"], orders).first()
    assert matrix["confusion_matrix"] == [[1, 0, 0], [1, 0, 0], [0, 0, 0]]
    bad = pairs.withColumn("y_pred", F.lit("Z"))
    assert M.foreign_predictions(bad, orders).count() == 2


def brute_areas(data):
    points, pos = [(0.0, 1.0)], sum(p for _, p in data)
    for cut in sorted({s for s, _ in data}, reverse=True):
        tp = sum(p for s, p in data if s >= cut)
        n = sum(1 for s, _ in data if s >= cut)
        points.append((tp / pos, tp / n))
    pr = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    good, bad = [s for s, p in data if p], [s for s, p in data if not p]
    roc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    return pr, roc


def test_ranking_areas(spark):
    schema = "score double, positive boolean"
    easy = spark.createDataFrame([(0.9, True), (0.2, False), (0.8, True), (0.1, False)], schema)
    assert tuple(M.ranking_areas(easy).first()) == (1.0, 1.0)
    rng = random.Random(3)
    data = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(500)]
    got = M.ranking_areas(spark.createDataFrame(data, schema)).first()
    assert tuple(got) == pytest.approx(brute_areas(data))


def _fits(spark, rows):
    return spark.createDataFrame(
        rows,
        "stage string, task string, representation string, classifier string, class_weight string, fold long, status string, "
        "macro_f1 double, balanced_accuracy double, accuracy double, weighted_f1 double, feature_count long, configuration_id string",
    )


def test_rankings_and_their_tie_breaks(spark):
    def fit(rep, fold, macro, features=10, status="SUCCESS", stage="S1", config=None):
        return (stage, "S3", rep, "LINEARSVC", "NONE", fold, status, macro, 0.5, 0.5, 0.5, features, config or rep)

    fits = _fits(spark, [fit(r, f, 0.4) for r in ("WORD", "CHAR") for f in (1, 2, 3)]
                 + [fit("BROKEN", f, 0.9, status="FAILED" if f == 3 else "SUCCESS") for f in (1, 2, 3)])
    board = L.rank_lexical(L.fold_summary(fits, ["task", "representation", "classifier", "class_weight"])).collect()
    assert [(r["representation"], r["rank_within_task"]) for r in sorted(board, key=lambda r: r["rank_within_task"])] == [("CHAR", 1), ("WORD", 2)]
    assert board[0]["fold_macro_f1"] == "|".join(["0.4000000000"] * 3) and board[0]["std_macro_f1"] == 0.0
    staged = _fits(spark, [fit("w", f, m, 50, config="wide") for f, m in ((1, 0.3), (2, 0.5), (3, 0.4))]
                   + [fit("s", f, 0.4, 100, config="stable-big") for f in (1, 2, 3)]
                   + [fit("s", f, 0.4, 50, config="stable-small") for f in (1, 2, 3)])
    keys = ["stage", "task", "configuration_id"]
    ranked = {r["configuration_id"]: r["rank"] for r in L.rank_staged(L.fold_summary(staged, keys)).collect()}
    assert ranked == {"stable-small": 1, "stable-big": 2, "wide": 3}
    gaps = {(r["task"], r["fold"]) for r in L.matrix_gaps(fits.filter("representation = 'WORD' and fold < 3"), ("S3",)).collect()}
    assert gaps == {("S3", 3)}


def test_comparison_of_two_systems(spark):
    schema = "task string, fold_macro_f1 string, mean_macro_f1 double"
    now = spark.createDataFrame([("S3", "0.5|0.6|0.7", 0.6)], schema)
    then = spark.createDataFrame([("S3", "0.4|0.5|0.6", 0.5)], schema)
    got = L.compare_with_baseline(now, then).first()
    assert got["fold_deltas"] == "0.1000000000|0.1000000000|0.1000000000"
    assert got["absolute_delta"] == pytest.approx(0.1) and got["relative_delta_percent"] == pytest.approx(20.0)
    assert (got["fold_wins"], got["new_winner"]) == (3, "YES")


def test_samples(spark):
    ids = spark.createDataFrame([(f"P:{i:03d}", "HIGH" if i % 5 == 0 else "LOW", i % 9 + 1) for i in range(100)],
                                "stable_id string, label string, n long")
    first, second = (sorted(r["stable_id"] for r in G.stratified_sample(ids.repartition(k), 50, "label", "s").collect()) for k in (1, 3))
    assert first == second and len(first) == 50
    got = {r["label"]: r["n"] for r in ids.join(spark.createDataFrame([(i,) for i in first], "stable_id string"), "stable_id")
           .groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"HIGH": 10, "LOW": 40}
    batches = G.length_batches(ids.limit(23), "n", 4).collect()
    assert len({r["stable_id"] for r in batches}) == 23 and {r["batch"] for r in batches} == set(range(6))
    lengths = {}
    for r in batches:
        lengths.setdefault(r["batch"], []).append(r["n"])
    assert all(max(lengths[b]) <= min(lengths[b + 1]) for b in range(5))
    late = ids.withColumn("label", F.when(F.col("stable_id") == "P:099", "RARE").otherwise("COMMON"))
    cover = [r["label"] for r in G.covering_slice(late, 3, "label", ("RARE", "COMMON")).collect()]
    assert cover[:2] == ["RARE", "COMMON"]
    prefix = G.prefix_until(ids.select("stable_id", "n"), [F.col("stable_id")], "n", 10)
    assert [r["n"] for r in prefix.orderBy("stable_id").collect()] == [1, 2, 3, 4]
    weights = {r["class"]: r for r in G.balanced_weights(spark.createDataFrame([("LOW",)] * 3 + [("HIGH",)], "y string"), "y", ("HIGH", "LOW")).collect()}
    assert weights["HIGH"]["weight"] == 2.0 and sum(w["weight_mean_one"] for w in weights.values()) == pytest.approx(2.0)
    with pytest.raises(ValueError, match="NONE"):
        G.balanced_weights(spark.createDataFrame([("LOW",)], "y string"), "y", ("LOW", "NONE"))


def test_label_schemes():
    assert SEVERITY.problems() == [] and PRIORITY.problems() == []
    broken = LabelScheme(targets={"A": {"x": "1", "y": "2"}, "B": {"x": "1"}}, orders={"A": ("1",), "B": ("1",)}, excluded=("x",))
    assert len(broken.problems()) == 3
    assert SEVERITY.fingerprint() != PRIORITY.fingerprint()


def test_result_store_resumes_and_refuses_drift(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    grid = spark.createDataFrame([("a",), ("b",)], "experiment_id string")
    assert {r[0] for r in store.pending(grid, "p1").collect()} == {"a", "b"}
    store.append([{"experiment_id": "a", "task": "S2", "fold": 1, "status": "SUCCESS", "provenance": "p1", "classifier": "LOGREG"}])
    assert [r[0] for r in store.pending(grid, "p1").collect()] == ["b"]
    with pytest.raises(RuntimeError, match="provenance"):
        store.pending(grid, "p2")
    flat = store.read().withColumn("macro_f1", F.lit(0.5))
    methods = spark.createDataFrame([("S2", "LINEARSVC")], "task string, classifier string")
    failed = H.failing_checks(H.result_checks(flat, {"provenance": "p1"}, methods), ["experiment_id"]).collect()
    assert [r["check"] for r in failed] == ["classifier_matches"]


def test_finalise_checks_and_reports_stored_results(spark, tmp_path):
    from tracefold.plans.modelling import finalise

    store = ResultStore(spark, str(tmp_path / "results"))
    store.append([
        {"experiment_id": f"e{fold}", "stage": "FUSION", "task": "S2", "fold": fold, "status": "SUCCESS", "provenance": "p",
         "classifier": "LOGREG", "metrics": (0.5 + fold / 10, 0.5, 0.6, 0.7), "fit_seconds": 1.5, "prediction_seconds": 0.5,
         "reused": False, "warnings": [], "per_class": [("HIGH_IMPACT", 0.5, 0.5, 0.5, 3)]}
        for fold in (1, 2, 3)
    ])
    methods = spark.createDataFrame([("S2", "LOGREG")], "task string, classifier string")
    before = spark.createDataFrame([("S2", "0.5|0.8|0.7", 0.6)], "task string, fold_macro_f1 string, mean_macro_f1 double")
    systems = before.withColumn("system", F.lit("old"))
    made = finalise(store.read(), ("S2",), {"provenance": "p"}, methods, before, systems)
    got = made["comparison"].first()
    assert got["current_folds"] == "0.6000000000|0.7000000000|0.8000000000"
    assert (got["fold_wins"], got["new_winner"]) == (2, "YES")
    assert made["systems"].first()["absolute_delta"] == pytest.approx(0.1)
    assert {r["task"]: r["fit_seconds"] for r in made["runtime"].collect()} == {"S2": 4.5, "TOTAL": 4.5}
    assert made["per_class"].count() == 3
    with pytest.raises(RuntimeError, match="matrix"):
        finalise(store.read().filter("fold < 3"), ("S2",), {"provenance": "p"}, methods, before, systems)
    with pytest.raises(RuntimeError, match="checks"):
        finalise(store.read(), ("S2",), {"provenance": "other"}, methods, before, systems)
