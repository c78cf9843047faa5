"""Metrics, leaderboards and comparisons over prediction tables.

Predictions are expressions over the labelled vectors: eight configurations err on
different rows, three folds split the rows, and two tasks read the same label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.functions.ids import experiment_id, provenance_digest
from tracefold.functions.scores import argmax_label
from tracefold.operators import fingerprints as P, leaderboard as L, memberships as H, metrics as M
from tracefold.operators.models import majority_predictions, stratified_predictions
from tracefold.queries.registry import query, rounded
from tracefold.queries.sql import STRUCTURED, digest, ordered_digest, with_
from tracefold.session import materialize
from tracefold.sources import bindings as B

LABELS = tuple(f"L{i}" for i in range(10))
ORDERS = {"S10": LABELS, "S2": ("HIGH", "LOW")}
CONFIG = ("task", "representation", "classifier", "class_weight")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task x configuration x fold predictions for every vector."""
    rows = B.vectors(spark, sf_dir).select(
        "stable_id", "vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    )
    wrong = (F.col("vec_id") + 3 * F.col("k")) % (5 + F.col("k")) == 0
    guess = F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    wide = rows.select(
        "stable_id",
        (F.col("vec_id") % 3 + 1).alias("fold"),
        F.when(F.col("k") % 2 == 0, "WORD").otherwise("CHAR").alias("representation"),
        F.when(F.expr("k div 2 % 2 = 0"), "LOGREG").otherwise("LINEARSVC").alias("classifier"),
        F.when(F.expr("k div 4 = 0"), "NONE").otherwise("BALANCED").alias("class_weight"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("true_s10"),
        F.concat(F.lit("L"), guess.cast("string")).alias("pred_s10"),
        F.when(F.col("label") < 3, "HIGH").otherwise("LOW").alias("true_s2"),
        F.when(guess < 3, "HIGH").otherwise("LOW").alias("pred_s2"),
    )
    keys = ["stable_id", "fold", "representation", "classifier", "class_weight"]
    return M.unpivot_tasks(
        wide, keys, {"S10": ("true_s10", "pred_s10"), "S2": ("true_s2", "pred_s2")}
    )


def fit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scalar metrics per fit, per-class metrics per fit)."""
    keys = [*CONFIG, "fold"]
    cells = M.confusion_counts(predictions(spark, sf_dir), keys)
    identity = experiment_id(*[F.col(k).cast("string") for k in keys])
    classes = materialize(
        M.per_class(cells, keys, ORDERS).withColumn("experiment_id", identity), "per-class"
    )
    fits = M.scalar_metrics(classes, [*keys, "experiment_id"]).withColumn("status", F.lit("SUCCESS"))
    return materialize(fits, "fits"), classes


_PREDICTIONS = """
p as (
  select 'L' || label || ':' || vec_id as stable_id, vec_id % 3 + 1 as fold, label, k,
    case when k % 2 = 0 then 'WORD' else 'CHAR' end as representation,
    case when k // 2 % 2 = 0 then 'LOGREG' else 'LINEARSVC' end as classifier,
    case when k // 4 = 0 then 'NONE' else 'BALANCED' end as class_weight,
    case when (vec_id + 3 * k) % (5 + k) = 0 then (label + 1) % 10 else label end as guess
  from embeddings, (select unnest(range(0, 8)) as k)),
pairs as (
  select stable_id, fold, representation, classifier, class_weight, 'S10' as task, 'L' || label as y_true, 'L' || guess as y_pred from p
  union all
  select stable_id, fold, representation, classifier, class_weight, 'S2', case when label < 3 then 'HIGH' else 'LOW' end,
    case when guess < 3 then 'HIGH' else 'LOW' end from p),
classes(task, class) as (values ('S10','L0'),('S10','L1'),('S10','L2'),('S10','L3'),('S10','L4'),('S10','L5'),
  ('S10','L6'),('S10','L7'),('S10','L8'),('S10','L9'),('S2','HIGH'),('S2','LOW')),
keys as (select distinct task, representation, classifier, class_weight, fold from pairs),
per_class as (
  select k.*, c.class,
    (select count(*) from pairs x where (x.task, x.representation, x.classifier, x.class_weight, x.fold, x.y_true) = (k.task, k.representation, k.classifier, k.class_weight, k.fold, c.class)) as support,
    (select count(*) from pairs x where (x.task, x.representation, x.classifier, x.class_weight, x.fold, x.y_pred) = (k.task, k.representation, k.classifier, k.class_weight, k.fold, c.class)) as guessed,
    (select count(*) from pairs x where (x.task, x.representation, x.classifier, x.class_weight, x.fold, x.y_true, x.y_pred) = (k.task, k.representation, k.classifier, k.class_weight, k.fold, c.class, c.class)) as hits
  from keys k join classes c on k.task = c.task),
scored as (
  select *, case when guessed = 0 then 0 else hits / guessed end as precision,
    case when support = 0 then 0 else hits / support end as recall,
    case when guessed + support = 0 then 0 else 2 * hits / (guessed + support) end as f1 from per_class),
fits as (
  select task, representation, classifier, class_weight, fold, avg(f1) as macro_f1,
    avg(recall) filter (support > 0) as balanced_accuracy, sum(hits) / sum(support) as accuracy,
    sum(f1 * support) / sum(support) as weighted_f1, sum(support)::bigint as rows
  from scored group by 1, 2, 3, 4, 5),
summary as (
  select task, representation, classifier, class_weight,
    string_agg(printf('%.10f', macro_f1), '|' order by fold) as fold_macro_f1, avg(macro_f1) as mean_macro_f1,
    min(macro_f1) as min_fold_macro_f1, stddev_pop(macro_f1) as std_macro_f1,
    avg(balanced_accuracy) as mean_balanced_accuracy, avg(accuracy) as mean_accuracy, avg(weighted_f1) as mean_weighted_f1
  from fits group by 1, 2, 3, 4 having count(*) = 3)
"""
_P = with_(_PREDICTIONS)


@query(
    "confusion_matrix",
    _P + """
select k.*, a.class as y_true, b.class as y_pred, count(x.y_true) as n
from keys k join classes a on a.task = k.task join classes b on b.task = k.task
left join pairs x on (x.task, x.representation, x.classifier, x.class_weight, x.fold) = (k.task, k.representation, k.classifier, k.class_weight, k.fold)
  and x.y_true = a.class and x.y_pred = b.class
group by all
""",
)
def confusion_matrix(spark, sf_dir):
    keys = [*CONFIG, "fold"]
    cells = M.confusion_counts(predictions(spark, sf_dir), keys)
    return M.confusion_matrix(cells, keys, ORDERS)


@query(
    "confusion_matrix_rows",
    with_(_PREDICTIONS) + """
, cells as (select a.task, a.class as t, b.class as g, count(x.y_true) as n from classes a join classes b on a.task = b.task
  left join pairs x on x.task = a.task and x.y_true = a.class and x.y_pred = b.class group by 1, 2, 3),
lines as (select task, t, string_agg(cast(n as varchar), ',' order by g) as line from cells group by 1, 2)
select task, string_agg(line, ';' order by t) as matrix from lines group by 1
""",
)
def confusion_matrix_rows(spark, sf_dir):
    pairs = predictions(spark, sf_dir)
    cells = M.confusion_counts(pairs, ["task"])
    rows = M.matrix_rows(M.confusion_matrix(cells, ["task"], ORDERS), ["task"], ORDERS)
    text = F.array_join(
        F.transform("confusion_matrix", lambda r: F.array_join(r.cast("array<string>"), ",")), ";"
    )
    return rows.select("task", text.alias("matrix"))


@query(
    "per_class_metrics",
    _P + """
select task, representation, classifier, class_weight, fold, class, round(precision, 8) as precision, round(recall, 8) as recall,
  round(f1, 8) as f1, support, hits from scored
""",
)
def per_class_metrics(spark, sf_dir):
    keys = [*CONFIG, "fold"]
    cells = M.confusion_counts(predictions(spark, sf_dir), keys)
    return rounded(M.per_class(cells, keys, ORDERS))


@query(
    "scalar_metrics",
    _P + """
select task, representation, classifier, class_weight, fold, round(macro_f1, 8) as macro_f1, round(balanced_accuracy, 8) as balanced_accuracy,
  round(accuracy, 8) as accuracy, round(weighted_f1, 8) as weighted_f1, rows from fits
""",
)
def scalar_metrics(spark, sf_dir):
    keys = [*CONFIG, "fold"]
    cells = M.confusion_counts(predictions(spark, sf_dir), keys)
    return rounded(M.scalar_metrics(M.per_class(cells, keys, ORDERS), keys))


@query(
    "order_status_metrics",
    with_(STRUCTURED) + """
, q as (select target_s3 as t, case when num % 7 = 0 then 'LOW' when num % 11 = 0 then 'MEDIUM' else target_s3 end as g from eligible),
c(class) as (values ('HIGH'), ('MEDIUM'), ('LOW')),
s as (select class, (select count(*) from q where t = class) as support, (select count(*) from q where g = class) as guessed,
       (select count(*) from q where t = class and g = class) as hits from c)
select 'S3' as task, round(avg(2 * hits / (guessed + support)), 8) as macro_f1, round(avg(hits / support), 8) as balanced_accuracy,
  round(sum(hits) / sum(support), 8) as accuracy, round(sum(2 * hits / (guessed + support) * support) / sum(support), 8) as weighted_f1,
  sum(support)::bigint as rows from s
""",
)
def order_status_metrics(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir)
    n = F.col("issue_id").cast("long")
    guess = F.when(n % 7 == 0, "LOW").when(n % 11 == 0, "MEDIUM").otherwise(F.col("target_s3"))
    pairs = rows.select(F.lit("S3").alias("task"), F.col("target_s3").alias("y_true"), guess.alias("y_pred"))
    orders = {"S3": ("HIGH", "MEDIUM", "LOW")}
    cells = M.confusion_counts(pairs, ["task"])
    return rounded(M.scalar_metrics(M.per_class(cells, ["task"], orders), ["task"]))


@query(
    "foreign_predictions",
    "select 'S10' as task, 'L' || (label + 5) as y_pred, count(*) as rows from embeddings where label + 5 > 9 group by 1, 2",
)
def foreign_predictions(spark, sf_dir):
    pairs = B.vectors(spark, sf_dir).select(
        F.lit("S10").alias("task"), F.concat(F.lit("L"), (F.col("label") + 5).cast("string")).alias("y_pred")
    )
    return M.foreign_predictions(pairs, ORDERS).groupBy("task", "y_pred").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "argmax_labels",
    """
select label, class, count(*) as rows from (
  select label, 'C' || list_position(embedding, list_max(embedding)) as class from embeddings)
group by 1, 2
""",
)
def argmax_labels(spark, sf_dir):
    classes = tuple(f"C{i}" for i in range(1, 65))
    return B.vectors(spark, sf_dir).select(
        "label", argmax_label(F.col("embedding"), classes).alias("class")
    ).groupBy("label", "class").agg(F.count(F.lit(1)).alias("rows"))


_AREAS = """
, g as (select {key} score, (count(*) filter (positive)) as pos, (count(*) filter (not positive)) as neg from s group by {key} score),
w as (select *, sum(pos) over (partition by {part} order by score desc) as tp, sum(neg) over (partition by {part} order by score desc) as fp,
  sum(pos) over (partition by {part}) as tot_p, sum(neg) over (partition by {part}) as tot_n from g)
select {key} round(sum(pos / tot_p * (tp / (tp + fp) + case when tp - pos + fp - neg > 0 then (tp - pos) / (tp - pos + fp - neg) else 1 end) / 2), 8) as pr_auc,
  round(sum(neg * (tp - pos + pos / 2) / (tot_p * tot_n)), 8) as roc_auc from w {by}
"""


@query(
    "ranking_areas",
    "with s as (select quality = 1 as positive, n_chars % 97 as score from labels join documents using (doc_id))"
    + _AREAS.format(key="", part="1", by=""),
)
def ranking_areas(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    scored = B.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        (F.col("quality") == 1).alias("positive"), (F.col("n_chars") % 97).cast("double").alias("score")
    )
    return rounded(M.ranking_areas(scored))


@query(
    "ranking_areas_by_type",
    "with s as (select event_type, user_id % 3 = 0 as positive, value as score from events)"
    + _AREAS.format(key="event_type,", part="event_type", by="group by 1"),
)
def ranking_areas_by_type(spark, sf_dir):
    scored = B.table(spark, sf_dir, "events").select(
        "event_type", (F.col("user_id") % 3 == 0).alias("positive"), F.col("value").alias("score")
    )
    return rounded(M.ranking_areas(scored, ["event_type"]))


_SUMMARY_COLUMNS = """fold_macro_f1, round(mean_macro_f1, 8) as mean_macro_f1, round(min_fold_macro_f1, 8) as min_fold_macro_f1,
  round(std_macro_f1, 8) as std_macro_f1, round(mean_balanced_accuracy, 8) as mean_balanced_accuracy,
  round(mean_accuracy, 8) as mean_accuracy, round(mean_weighted_f1, 8) as mean_weighted_f1"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, _ = fit_tables(spark, sf_dir)
    return materialize(L.fold_summary(fits, CONFIG), "summary")


@query(
    "lexical_leaderboard",
    _P + f"""
select task, representation, classifier, class_weight, {_SUMMARY_COLUMNS}, row_number() over (partition by task order by
  mean_macro_f1 desc, mean_balanced_accuracy desc, mean_weighted_f1 desc, representation, classifier, class_weight) as rank_within_task
from summary
""",
)
def lexical_leaderboard(spark, sf_dir):
    return rounded(L.rank_lexical(summary(spark, sf_dir)))


def _with_configuration(board: DataFrame) -> DataFrame:
    return board.withColumns(
        {
            "configuration_id": F.concat_ws("-", "representation", "classifier", "class_weight"),
            "stage": F.when(F.col("class_weight") == "NONE", "A").otherwise("B"),
            "mean_feature_count": F.length("classifier").cast("double"),
        }
    )


_CONFIGURED = """
, configured as (select *, representation || '-' || classifier || '-' || class_weight as configuration_id,
  case class_weight when 'NONE' then 'A' else 'B' end as stage, length(classifier)::double as mean_feature_count from summary),
staged as (select *, row_number() over (partition by stage, task order by mean_macro_f1 desc, min_fold_macro_f1 desc,
  mean_balanced_accuracy desc, mean_feature_count, configuration_id) as rank from configured)
"""


@query(
    "staged_leaderboard",
    _P + _CONFIGURED + f"select stage, task, configuration_id, {_SUMMARY_COLUMNS}, mean_feature_count, rank from staged",
)
def staged_leaderboard(spark, sf_dir):
    board = L.rank_staged(_with_configuration(summary(spark, sf_dir)))
    return rounded(board.drop("representation", "classifier", "class_weight"))


@query(
    "stage_winners",
    _P + _CONFIGURED + "select stage, task, configuration_id, round(mean_macro_f1, 8) as mean_macro_f1 from staged where rank = 1",
)
def stage_winners(spark, sf_dir):
    board = L.winners(L.rank_staged(_with_configuration(summary(spark, sf_dir))))
    return rounded(board.select("stage", "task", "configuration_id", "mean_macro_f1"))


@query(
    "dense_leaderboard",
    _P + _CONFIGURED + """
select task, configuration_id, round(mean_macro_f1, 8) as mean_macro_f1, row_number() over (partition by task order by mean_macro_f1 desc,
  min_fold_macro_f1 desc, mean_balanced_accuracy desc, configuration_id) as rank_within_task from configured
""",
)
def dense_leaderboard(spark, sf_dir):
    board = L.rank_dense(_with_configuration(summary(spark, sf_dir)))
    return rounded(board.select("task", "configuration_id", "mean_macro_f1", "rank_within_task"))


@query(
    "positive_class_guard",
    _P + """
select task, representation, classifier, class_weight, round(avg(precision), 8) as positive_precision, round(avg(recall), 8) as positive_recall,
  round(avg(f1), 8) as positive_f1, case when avg(precision) >= 0.30 then 'PASS' else 'FAIL' end as precision_guard
from scored where task = 'S2' and class = 'HIGH' group by 1, 2, 3, 4
""",
)
def positive_class_guard(spark, sf_dir):
    fits, classes = fit_tables(spark, sf_dir)
    return rounded(
        L.positive_class_summary(fits, classes.select("experiment_id", "class", "precision", "recall", "f1"),
                                 CONFIG, "S2", "HIGH")
    )


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, _ = fit_tables(spark, sf_dir)
    return fits.withColumns(
        {
            "fit_seconds": F.col("rows") / 100.0,
            "prediction_seconds": F.col("rows") / 1000.0,
            "reused": (F.col("class_weight") == "BALANCED") & (F.col("fold") == 2),
        }
    )


@query(
    "runtime_summary",
    _P + """
, e as (select * from fits where not (class_weight = 'BALANCED' and fold = 2))
select representation, count(*) as fit_count, round(sum(rows / 100.0), 6) as fit_seconds, round(sum(rows / 1000.0), 6) as prediction_seconds from e group by 1
union all select 'TOTAL', count(*), round(sum(rows / 100.0), 6), round(sum(rows / 1000.0), 6) from e
""",
)
def runtime_summary(spark, sf_dir):
    return rounded(L.runtime_summary(_timed(spark, sf_dir), ["representation"]), 6)


@query(
    "family_metric_means",
    _P + """
select representation || '-' || classifier || '-' || class_weight as family, task, round(avg(macro_f1), 8) as macro_f1_mean, round(avg(balanced_accuracy), 8) as balanced_accuracy_mean,
  round(avg(accuracy), 8) as accuracy_mean, round(avg(weighted_f1), 8) as weighted_f1_mean,
  string_agg(printf('%.10f', macro_f1), '|' order by fold) as macro_f1_folds
from fits group by 1, 2
""",
)
def family_metric_means(spark, sf_dir):
    fits, _ = fit_tables(spark, sf_dir)
    family = F.concat_ws("-", "representation", "classifier", "class_weight")
    return rounded(L.family_summary(fits.withColumn("family", family)))


@query(
    "flattened_fits",
    _P + """
select task, representation, classifier, class_weight, fold, round(macro_f1, 8) as macro_f1, round(balanced_accuracy, 8) as balanced_accuracy,
  round(accuracy, 8) as accuracy, round(weighted_f1, 8) as weighted_f1, (case when fold = 3 then 2 else 0 end)::bigint as warning_count,
  case when fold = 3 then 'slow | no convergence' else '' end as warning_messages from fits
""",
)
def flattened_fits(spark, sf_dir):
    fits, _ = fit_tables(spark, sf_dir)
    notes = F.when(F.col("fold") == 3, F.array(F.lit("slow"), F.lit("no convergence"))).otherwise(
        F.array().cast("array<string>")
    )
    nested = fits.select(*CONFIG, "fold", notes.alias("warnings"), F.struct(*M.SCALARS).alias("metrics"))
    return rounded(L.flatten_fits(nested))


_VERSUS = """
, cur as (select * from summary where representation = 'WORD' and classifier = 'LOGREG' and class_weight = 'BALANCED'),
bas as (select * from summary where representation = 'CHAR' and classifier = 'LINEARSVC' and class_weight = 'NONE'),
d as (select c.task, c.fold_macro_f1 as current_folds, b.fold_macro_f1 as baseline_folds, c.mean_macro_f1 as cm, b.mean_macro_f1 as bm,
  list_transform(string_split(c.fold_macro_f1, '|'), lambda x: cast(x as double)) as cf,
  list_transform(string_split(b.fold_macro_f1, '|'), lambda x: cast(x as double)) as bf from cur c join bas b using (task))
"""


@query(
    "baseline_comparison",
    _P + _VERSUS + """
select task, current_folds, baseline_folds, printf('%.10f', cf[1] - bf[1]) || '|' || printf('%.10f', cf[2] - bf[2]) || '|' || printf('%.10f', cf[3] - bf[3]) as fold_deltas,
  round(cm, 8) as current_mean, round(bm, 8) as baseline_mean, round(cm - bm, 8) as absolute_delta,
  round((cm - bm) / bm * 100, 8) as relative_delta_percent,
  ((cf[1] > bf[1])::int + (cf[2] > bf[2])::int + (cf[3] > bf[3])::int)::bigint as fold_wins,
  case when cm - bm > 0 then 'YES' else 'NO' end as new_winner from d
""",
)
def baseline_comparison(spark, sf_dir):
    board = summary(spark, sf_dir)
    current = board.filter("representation = 'WORD' and classifier = 'LOGREG' and class_weight = 'BALANCED'")
    baseline = board.filter("representation = 'CHAR' and classifier = 'LINEARSVC' and class_weight = 'NONE'")
    return rounded(L.compare_with_baseline(current, baseline))


@query(
    "system_comparison",
    _P + """
, b as (select *, row_number() over (partition by representation, task order by mean_macro_f1 desc, mean_balanced_accuracy desc,
         mean_weighted_f1 desc, classifier, class_weight) as r from summary),
s as (select representation as system, task, mean_macro_f1 from b where r = 1),
c as (select * from summary where representation = 'WORD' and classifier = 'LOGREG' and class_weight = 'BALANCED')
select s.task, s.system, round(s.mean_macro_f1, 8) as system_mean, round(c.mean_macro_f1, 8) as current_mean,
  round(c.mean_macro_f1 - s.mean_macro_f1, 8) as absolute_delta,
  round((c.mean_macro_f1 - s.mean_macro_f1) / s.mean_macro_f1 * 100, 8) as relative_delta_percent from s join c using (task)
""",
)
def system_comparison(spark, sf_dir):
    board = summary(spark, sf_dir)
    order = [F.desc("mean_macro_f1"), F.desc("mean_balanced_accuracy"), F.desc("mean_weighted_f1"),
             F.col("classifier"), F.col("class_weight")]
    ranked = L.ranked(board, ["representation", "task"], order, "r")
    systems = None
    for name in ("WORD", "CHAR"):
        best = L.best_per_task(ranked.filter(F.col("representation") == name), "r", ["mean_macro_f1"])
        tagged = best.withColumn("system", F.lit(name))
        systems = tagged if systems is None else systems.unionByName(tagged)
    current = board.filter("representation = 'WORD' and classifier = 'LOGREG' and class_weight = 'BALANCED'")
    return rounded(L.compare_with_systems(current, systems))


@query(
    "result_matrix_gaps",
    _P + """
, e as (select t.task, f.fold::bigint as fold, 1 as expected from (values ('S10'), ('S2'), ('S3')) t(task), (values (1), (2), (3)) f(fold)),
r as (select task, fold, count(*) as seen from fits where representation = 'WORD' and classifier = 'LOGREG' and (class_weight = 'NONE' or fold = 1) group by 1, 2)
select task, fold, coalesce(expected, 0)::bigint as expected, coalesce(seen, 0)::bigint as seen from e full outer join r using (task, fold)
where coalesce(expected, 0) <> coalesce(seen, 0)
""",
)
def result_matrix_gaps(spark, sf_dir):
    fits, _ = fit_tables(spark, sf_dir)
    chosen = fits.filter(
        "representation = 'WORD' and classifier = 'LOGREG' and (class_weight = 'NONE' or fold = 1)"
    )
    gaps = L.matrix_gaps(chosen, ("S10", "S2", "S3"))
    return gaps.withColumns({c: F.col(c).cast("long") for c in ("expected", "seen")})


@query(
    "result_check_failures",
    _P + """
select task, fold, 'classifier_matches' as "check" from fits where representation = 'WORD' and class_weight = 'NONE' and classifier = 'LINEARSVC'
union all
select task, fold, 'protocol_matches' from fits where representation = 'WORD' and class_weight = 'NONE' and fold = 2
""",
)
def result_check_failures(spark, sf_dir):
    fits, _ = fit_tables(spark, sf_dir)
    stored = fits.filter("representation = 'WORD' and class_weight = 'NONE'").withColumn(
        "protocol", F.when(F.col("fold") == 2, "old").otherwise("p1")
    )
    methods = stored.select("task").distinct().withColumn("classifier", F.lit("LOGREG"))
    checked = H.result_checks(stored, {"protocol": "p1"}, methods)
    return H.failing_checks(checked, ["experiment_id", "task", "fold"]).drop("experiment_id")


@query(
    "pending_experiments",
    _P + """
select task, fold, substr(sha256(task || '|' || representation || '|' || classifier || '|' || class_weight || '|' || fold), 1, 20) as experiment_id
from fits where class_weight = 'BALANCED'
""",
)
def pending_experiments(spark, sf_dir):
    """Grid = every fit; the unweighted ones are already stored."""
    fits, _ = fit_tables(spark, sf_dir)
    stored = fits.filter("class_weight = 'NONE'")
    return fits.join(stored.select("experiment_id"), "experiment_id", "left_anti").select(
        "task", "fold", "experiment_id"
    )


@query(
    "provenance_digests",
    """
select source as project, sha256('{"documents":' || count(*) || ',"longest":' || max(n_chars) || ',"project":"' || source || '"}') as provenance
from documents group by source
""",
)
def provenance_digests(spark, sf_dir):
    found = B.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project")).agg(
        F.count(F.lit(1)).alias("documents"), F.max("n_chars").alias("longest")
    )
    return found.select(
        "project", provenance_digest(F.struct("documents", "longest", "project")).alias("provenance")
    )


@query(
    "prediction_digests",
    _P.rstrip() + "\n" + digest("stable_id || chr(9) || y_pred", "pairs", "task, representation, fold"),
)
def prediction_digests(spark, sf_dir):
    return P.prediction_digest(predictions(spark, sf_dir), ["task", "representation", "fold"])


@query(
    "ordered_prediction_digests",
    _P.rstrip() + "\n" + ordered_digest("stable_id || chr(9) || y_pred", "stable_id", "pairs", ", ".join([*CONFIG, "fold"])),
)
def ordered_prediction_digests(spark, sf_dir):
    return P.ordered_predictions(predictions(spark, sf_dir), "stable_id", [*CONFIG, "fold"])


@query(
    "majority_baseline",
    with_(STRUCTURED) + """
, top as (select target_s4 as c from eligible where num % 5 <> 0 group by 1 order by count(*) desc, 1 limit 1)
select target_s4 as y_true, (select c from top) as y_pred, count(*) as rows from eligible where num % 5 = 0 group by 1
""",
)
def majority_baseline(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir).withColumn("y_true", F.col("target_s4"))
    fifth = F.col("issue_id").cast("long") % 5 == 0
    guessed = majority_predictions(rows.filter(~fifth), rows.filter(fifth))
    return guessed.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stratified_baseline",
    with_(STRUCTURED) + """
, cum as (select c, sum(n) over (order by c) as upto, sum(n) over () as total from (select target_s4 as c, count(*) as n from eligible where num % 5 <> 0 group by 1)),
d as (select target_s4 as y_true, cast(('0x' || substr(sha256('20260809|' || stable_id), 1, 8)) as bigint)::hugeint as draw from eligible where num % 5 = 0)
select y_true, (select c from cum where draw * total < upto * 4294967296 order by upto limit 1) as y_pred, count(*) as rows from d group by 1, 2
""",
)
def stratified_baseline(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir).withColumn("y_true", F.col("target_s4"))
    fifth = F.col("issue_id").cast("long") % 5 == 0
    guessed = stratified_predictions(rows.filter(~fifth), rows.filter(fifth), 20260809)
    return guessed.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("rows"))
