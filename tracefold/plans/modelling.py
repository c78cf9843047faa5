"""Model grids: lexical benchmark, staged search, dense and fused grids, held-out scoring.

A grid is driven from the driver like any model selection: features of a (fold,
representation) are written once, all fits that share them are trained in joint passes over that
table, and their results are appended to a store, so an interrupted grid resumes with what is
missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from tracefold.functions.ids import experiment_key
from tracefold.functions.text import text_for_view
from tracefold.operators import features as X, fingerprints as P, leaderboard as L, linear, metrics as M, models as N
from tracefold.operators.eligibility import require_empty
from tracefold.operators.memberships import common_ids, missing_ids, require_exact_membership
from tracefold.protocol import STUDY_SEED, IntegrityError, LabelScheme
from tracefold.sources.stores import ResultStore


@dataclass(frozen=True)
class Corpus:
    """Development rows (stable_id, summary, description, text_combined, targets) and folds."""

    rows: DataFrame
    folds: DataFrame
    scheme: LabelScheme
    family: str = "pooled"
    dense: DataFrame | None = None
    dimension: int = 0
    tasks: tuple[str, ...] = ()

    def task_names(self) -> tuple[str, ...]:
        return self.tasks or self.scheme.tasks


@dataclass(frozen=True)
class Experiment:
    stage: str
    task: str
    fold: int
    classifier: str
    class_weight: str = "NONE"
    c: float = 1.0
    representation: str = "NONE"
    text_view: str = "SUMMARY_DESCRIPTION"
    fused: bool = False
    max_iter: int | None = None

    @property
    def configuration_id(self) -> str:
        return "-".join(
            [self.representation, self.classifier, self.class_weight, f"C{self.c:g}", self.text_view]
            + (["FUSED"] if self.fused else [])
        )

    def key(self, provenance: str) -> str:
        return experiment_key(self.stage, self.task, self.configuration_id, self.fold, provenance)


def fold_rows(corpus: Corpus, fold: int, role: str) -> DataFrame:
    """Rows of one membership; a member without a row is an error."""
    members = corpus.folds.filter(
        (F.col("family") == corpus.family) & (F.col("fold") == fold) & (F.col("role") == role)
    ).select("stable_id")
    require_empty(missing_ids(members, corpus.rows), "fold members without a row")
    return corpus.rows.join(members, "stable_id", "left_semi")


def require_disjoint_fold(corpus: Corpus, fold: int) -> None:
    train, validation = (fold_rows(corpus, fold, r) for r in ("TRAIN", "VALIDATION"))
    require_empty(common_ids(train, validation), "fold membership overlap")


def _texts(rows: DataFrame, view: str) -> DataFrame:
    text = text_for_view(F.lit(view), F.col("summary"), F.col("description"))
    return rows.withColumn("text", text)


def fold_features(
    corpus: Corpus, fold: int, representation: str, view: str, fused: bool
) -> tuple[DataFrame, DataFrame, int]:
    """(train, validation, width): sparse rows of a fold, fitted on its training rows."""
    targets = [f"target_{t.lower()}" for t in corpus.task_names()]
    train, validation = (
        _texts(fold_rows(corpus, fold, role), view).select("stable_id", "text", *targets)
        for role in ("TRAIN", "VALIDATION")
    )
    dense, dimension = (corpus.dense, corpus.dimension) if fused else (None, 0)
    if representation == "NONE":
        parts = [X.sparse_rows(d, None, 0, dense, dimension) for d in (train, validation)]
        return parts[0], parts[1], dimension
    fitted = X.fit_features(train, X.REPRESENTATIONS[representation])
    parts = [
        X.sparse_rows(d, fitted.rows(d), fitted.width, dense, dimension)
        for d in (train, validation)
    ]
    return parts[0], parts[1], fitted.width + dimension


def run_grid(
    corpus: Corpus, experiments: Sequence[Experiment], store: ResultStore, provenance: str,
    keep: str | None = None,
) -> DataFrame:
    """Fit what the store lacks; features and passes are shared inside (fold, representation, view).

    ``keep``: folder to which the predictions of the fits are appended.
    """
    spark = corpus.rows.sparkSession
    grid = spark.createDataFrame([(e.key(provenance),) for e in experiments], "experiment_id string")
    wanted = {r["experiment_id"] for r in store.pending(grid, provenance).collect()}
    groups: dict[tuple, list[Experiment]] = {}
    for e in experiments:
        if e.key(provenance) in wanted:
            groups.setdefault((e.fold, e.representation, e.text_view, e.fused), []).append(e)
    for (fold, representation, view, fused), members in groups.items():
        if fused:
            require_exact_membership(corpus.dense, corpus.rows)
        train, validation, width = fold_features(corpus, fold, representation, view, fused)
        sizes = (train.count(), validation.count())
        targets = {t: f"target_{t.lower()}" for t in corpus.task_names()}
        specs = [
            linear.Spec(e.key(provenance), e.task, e.classifier, e.class_weight, e.c, e.max_iter) for e in members
        ]
        rows, predictions = N.fit_and_score(train, validation, width, targets, corpus.scheme.orders, specs)
        if predictions is not None and keep is not None:
            predictions.write.mode("append").parquet(keep)
        store.append([_result(e, provenance, width, sizes, rows[e.key(provenance)]) for e in members])
    return store.read().join(grid, "experiment_id", "left_semi")


def _result(e: Experiment, provenance: str, width: int, sizes: tuple[int, int], row: dict) -> dict:
    metrics = row.get("metrics")
    classes = row.get("per_class") or []
    return {
        "experiment_id": e.key(provenance),
        "stage": e.stage, "task": e.task, "configuration_id": e.configuration_id,
        "representation": e.representation, "classifier": e.classifier,
        "class_weight": e.class_weight, "c": e.c, "text_view": e.text_view, "fold": e.fold,
        "feature_count": width, "training_rows": sizes[0], "validation_rows": sizes[1],
        "status": row["status"], "exception": row.get("exception"),
        "fit_seconds": row.get("fit_seconds"), "prediction_seconds": row.get("prediction_seconds"),
        "reused": False, "warnings": row["warnings"],
        "metrics": tuple(metrics[k] for k in M.SCALARS) if metrics else None,
        "per_class": [
            (c["class"], c["precision"], c["recall"], c["f1"], c["support"]) for c in classes
        ],
        "confusion_matrix": row.get("confusion_matrix"), "provenance": provenance,
    }


def flat_results(results: DataFrame) -> DataFrame:
    return results.select(
        *[c for c in results.columns if c not in ("metrics", "per_class", "confusion_matrix")],
        *[F.col(f"metrics.{m}").alias(m) for m in M.SCALARS],
    )


def class_results(results: DataFrame) -> DataFrame:
    return results.select("experiment_id", F.explode("per_class").alias("c")).select(
        "experiment_id", "c.*"
    )


def benchmark_experiments(
    tasks: Iterable[str], folds: Iterable[int] = (1, 2, 3),
    representations: Iterable[str] = ("WORD", "CHAR", "WORD_CHAR"),
    classifiers: Iterable[str] = ("LOGREG", "LINEARSVC"),
    weights: Iterable[str] = ("NONE", "BALANCED"), stage: str = "COMPETITIVE",
) -> list[Experiment]:
    """The full lexical grid: with three tasks and folds, 108 fits."""
    return [
        Experiment(stage, task, fold, classifier, weight, representation=representation)
        for fold in folds for representation in representations for task in tasks
        for classifier in classifiers for weight in weights
    ]


def dense_experiments(
    tasks: Iterable[str], folds: Iterable[int] = (1, 2, 3), stage: str = "DENSE"
) -> list[Experiment]:
    return [
        Experiment(stage, task, fold, classifier, weight, fused=True)
        for fold in folds for task in tasks
        for classifier in ("LOGREG", "LINEARSVC") for weight in ("NONE", "BALANCED")
    ]


def fusion_experiments(
    methods: dict[str, tuple[str, str, str, float]], folds: Iterable[int] = (1, 2, 3), stage: str = "FUSION"
) -> list[Experiment]:
    """One frozen (representation, classifier, weight, c) per task, fused with vectors."""
    return [
        Experiment(stage, task, fold, classifier, weight, c, representation, fused=True)
        for task, (representation, classifier, weight, c) in methods.items() for fold in folds
    ]


def benchmark_leaderboard(results: DataFrame) -> DataFrame:
    fits = flat_results(results).filter("stage = 'COMPETITIVE'")
    return L.rank_lexical(L.fold_summary(fits, ["task", "representation", "classifier", "class_weight"]))


_STAGED = ["stage", "task", "configuration_id", "c", "representation", "text_view", "classifier", "class_weight"]


def staged_board(results: DataFrame) -> DataFrame:
    return L.rank_staged(L.fold_summary(flat_results(results), _STAGED))


def _winner(board: DataFrame, stage: str, task: str):
    return board.filter((F.col("stage") == stage) & (F.col("task") == task) & (F.col("rank") == 1)).first()


def staged_search(
    corpus: Corpus,
    store: ResultStore,
    provenance: str,
    *,
    start: dict[str, tuple[str, str, str]],
    c_grid: Sequence[float],
    representations: Sequence[str] | dict[str, Sequence[str]],
    folds: Sequence[int] = (1, 2, 3),
    max_iter: int | None = None,
) -> DataFrame:
    """C grid, then representation, then text view; each stage starts from the winner before.

    ``representations``: names of ``features.REPRESENTATIONS``, for all tasks or per task (the
    variants ``S6-R1`` to ``S2-R6`` among them).
    ``start``: (representation, classifier, weight) per task.  The combined text view
    equals the winner of stage two and is copied, not fitted again.
    """
    first = [
        Experiment("S1", task, fold, clf, weight, c, rep, max_iter=max_iter)
        for task, (rep, clf, weight) in start.items() for c in c_grid for fold in folds
    ]
    tried = representations if isinstance(representations, dict) else dict.fromkeys(start, representations)
    board = staged_board(run_grid(corpus, first, store, provenance))
    best_c = {t: _winner(board, "S1", t)["c"] for t in start}
    second = [
        Experiment("S2", task, fold, clf, weight, best_c[task], rep, max_iter=max_iter)
        for task, (_, clf, weight) in start.items() for rep in tried[task] for fold in folds
    ]
    results = run_grid(corpus, second, store, provenance)
    board = staged_board(results)
    winners = {
        t: Experiment("S2", t, 0, start[t][1], start[t][2], best_c[t],
                      _winner(board, "S2", t)["representation"], max_iter=max_iter)
        for t in start
    }
    third, copies = [], []
    for base in winners.values():
        for fold in folds:
            copies.append((replace(base, stage="S3", fold=fold), replace(base, fold=fold)))
            third += [
                replace(base, stage="S3", fold=fold, text_view=view)
                for view in ("SUMMARY_ONLY", "DESCRIPTION_ONLY")
            ]
    _reuse(results, copies, store, provenance)
    run_grid(corpus, third, store, provenance)
    everything = first + second + third + [c for c, _ in copies]
    spark = corpus.rows.sparkSession
    keys = spark.createDataFrame([(e.key(provenance),) for e in everything], "experiment_id string")
    return staged_board(store.read().join(keys, "experiment_id", "left_semi"))


def _reuse(results: DataFrame, copies, store: ResultStore, provenance: str) -> None:
    """Append stored results under a new stage; one row per reused fit."""
    stored = {r["experiment_id"] for r in store.read().select("experiment_id").collect()}
    wanted = {old.key(provenance): new for new, old in copies if new.key(provenance) not in stored}
    if not wanted:
        return
    rows = results.filter(F.col("experiment_id").isin(*wanted)).collect()
    store.append(
        [
            r.asDict() | {
                "experiment_id": wanted[r["experiment_id"]].key(provenance),
                "stage": "S3", "reused": True,
            }
            for r in rows
        ]
    )


def dummy_baselines(corpus: Corpus, fold: int, task: str, seed: int = STUDY_SEED) -> DataFrame:
    """Metrics of the majority and the stratified baseline of one fold and task."""
    target = F.col(f"target_{task.lower()}").alias("y_true")
    train, validation = (
        fold_rows(corpus, fold, role).select("stable_id", target) for role in ("TRAIN", "VALIDATION")
    )
    guesses = N.majority_predictions(train, validation).withColumn(
        "classifier", F.lit("DUMMY_MOST_FREQUENT")
    ).unionByName(
        N.stratified_predictions(train, validation, seed).withColumn(
            "classifier", F.lit("DUMMY_STRATIFIED")
        )
    ).withColumn("task", F.lit(task))
    keys = ["task", "classifier"]
    cells = M.confusion_counts(guesses, keys)
    return M.scalar_metrics(M.per_class(cells, keys, corpus.scheme.orders), keys)


@dataclass(frozen=True)
class FinalPart:
    """Fitted features of one representation and the classifiers of the tasks that use it."""

    features: X.FittedFeatures
    models: tuple[linear.Fitted, ...]
    dense_dimension: int = 0


@dataclass(frozen=True)
class FinalModel:
    """Everything that is needed for new text; ``plans.bundles`` stores and loads it."""

    parts: tuple[FinalPart, ...]


def train_final(
    rows: DataFrame,
    scheme: LabelScheme,
    methods: dict[str, tuple[str, str, float]],
    representation: str | dict[str, str],
    dense: DataFrame | None = None,
    dimension: int = 0,
) -> FinalModel:
    """Refit on all development rows: (classifier, weight, c) per task.

    ``representation``: one for all tasks, or one per task; tasks that share one are trained in joint
    passes.
    """
    chosen = representation if isinstance(representation, dict) else dict.fromkeys(methods, representation)
    parts = []
    for name in dict.fromkeys(chosen[t] for t in methods):
        targets = {t: f"target_{t.lower()}" for t in methods if chosen[t] == name}
        docs = rows.select("stable_id", F.col("text_combined").alias("text"), *targets.values())
        fitted = X.fit_features(docs, X.REPRESENTATIONS[name])
        data = X.sparse_rows(docs, fitted.rows(docs), fitted.width, dense, dimension)
        specs = [linear.Spec(t, t, *methods[t]) for t in targets]
        models = linear.train(data, fitted.width + dimension, targets, scheme.orders, specs)
        parts.append(FinalPart(fitted, tuple(models), dimension))
    return FinalModel(tuple(parts))


def predict_final(
    final: FinalModel, texts: DataFrame, dense: DataFrame | None = None, positive: dict[str, str] | None = None
) -> DataFrame:
    """Predictions of every task for (stable_id, text_combined), no label in sight."""
    docs = texts.select("stable_id", F.col("text_combined").alias("text"))
    out = None
    for part in final.parts:
        width = part.features.width
        for m in part.models:
            if m.coefficients.shape[1] != width + part.dense_dimension + 1:
                raise IntegrityError(f"{m.spec.task}: feature width differs from the fitted width")
        rows = X.sparse_rows(docs, part.features.rows(docs), width, dense, part.dense_dimension)
        found = linear.predict(rows, part.models, positive=positive).select("stable_id", "y_pred", "score", "task")
        out = found if out is None else out.unionByName(found)
    return out


def score_final(
    predictions: DataFrame, labels: DataFrame, scheme: LabelScheme, positive: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Join labels after predicting; metrics, per-class table, areas and fingerprints."""
    tasks = [r["task"] for r in predictions.select("task").distinct().collect()]
    long = F.explode(
        F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"target_{t.lower()}").alias("y_true")) for t in tasks])
    )
    truth = labels.select("stable_id", long.alias("l")).select("stable_id", "l.*")
    on = ["stable_id", "task"]
    require_empty(predictions.join(truth, on, "left_anti").select(*on), "predictions without a label")
    require_empty(truth.join(predictions, on, "left_anti").select(*on), "labels without a prediction")
    pairs = predictions.join(truth, on)
    require_empty(M.foreign_predictions(pairs, scheme.orders), "predictions outside the class list")
    cells = M.confusion_counts(pairs, ["task"])
    classes = M.per_class(cells, ["task"], scheme.orders)
    out = {
        "metrics": M.scalar_metrics(classes, ["task"]),
        "per_class": classes,
        "fingerprints": P.prediction_digest(predictions, ["task"]),
    }
    for task, label in (positive or {}).items():
        scored = pairs.filter((F.col("task") == task) & F.col("score").isNotNull()).select(
            "task", "score", (F.col("y_true") == label).alias("positive")
        )
        areas = M.ranking_areas(scored, ["task"])
        out["areas"] = areas if "areas" not in out else out["areas"].unionByName(areas)
    return out


def finalise(
    results: DataFrame, tasks: Sequence[str], expected: dict, methods: DataFrame,
    baseline: DataFrame, systems: DataFrame,
) -> dict[str, DataFrame]:
    """Reports from stored results without refitting, after every stored fit checked out."""
    from tracefold.operators.memberships import failing_checks, result_checks

    fits = flat_results(results)
    require_empty(L.matrix_gaps(fits, tasks), "task x fold matrix")
    checks = result_checks(fits, expected, methods)
    require_empty(failing_checks(checks, ["experiment_id", "task", "fold"]), "stored result checks")
    summary = L.fold_summary(fits, ["task"])
    return {
        "fold_metrics": fits.select("task", "fold", *M.SCALARS),
        "task_summary": summary,
        "per_class": class_results(results),
        "comparison": L.compare_with_baseline(summary, baseline),
        "systems": L.compare_with_systems(summary, systems),
        "runtime": L.runtime_summary(fits, ["task"]),
    }
