from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.operators import features as X, linear, models as N, vectors as V
from tracefold.plans import bundles, encoding, modelling as G
from tracefold.protocol import SEVERITY, IntegrityError
from tracefold.sources.stores import ResultStore
from tracefold.streaming import incremental_audit as I

TRAIN = ["Training token a bb", "training token token", "été ab_1 x été", "other words here", "other  here\nab", "a"]
CHAR = X.TermSpec("char_wb", 3, 5, 1, 10_000, "char")
WORD = X.TermSpec("word", 1, 2, 1, 10_000, "word")


def docs(spark, texts, prefix="d"):
    return spark.createDataFrame([(f"{prefix}{i}", t) for i, t in enumerate(texts)], "stable_id string, text string")


def char_terms(text):
    """Character n-grams inside padded words, derived by walking each word."""
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            out += [padded[i : i + n] for i in range(max(len(padded) - n + 1, 1))]
            if len(padded) <= n:
                break
    return Counter(out)


def word_terms(text):
    import re

    tokens = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])


@pytest.mark.parametrize("spec,count", [(CHAR, char_terms), (WORD, word_terms)])
def test_tfidf_matches_a_direct_computation(spark, spec, count):
    per_doc = [count(t) for t in TRAIN]
    df = Counter(term for c in per_doc for term in c)
    fitted = X.fit_features(docs(spark, TRAIN), (spec,))
    got = {}
    for r in fitted.transform(docs(spark, TRAIN)).collect():
        got[(r["stable_id"], r["term"])] = r["weight"]
    expected = {}
    for i, c in enumerate(per_doc):
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(TRAIN)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        expected.update({(f"d{i}", t): v / length for t, v in raw.items()})
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_vocabulary_comes_from_training_rows_only(spark):
    fitted = X.fit_features(docs(spark, ["training token", "training token"]), (X.TermSpec("word", 1, 1, 2, 1, "w"),))
    assert [r["term"] for r in fitted.vocabularies[0].collect()] == ["token"]
    assert fitted.transform(docs(spark, ["validationonly"], "v")).count() == 0


def test_vectors_and_block_norms(spark):
    both = X.fit_features(docs(spark, TRAIN), (WORD, CHAR))
    table = docs(spark, TRAIN + ["!!"])
    dense = table.select("stable_id", F.array(*[F.lit(x) for x in (0.6, 0.8)]).alias("embedding"))
    rows = {r["stable_id"]: r["features"] for r in
            X.as_vectors(table, both.transform(table), both.width, dense, 2).collect()}
    assert len(rows) == len(TRAIN) + 1 and rows["d0"].size == both.width + 2
    assert rows["d0"].norm(2) == pytest.approx(math.sqrt(3), rel=1e-6)
    assert np.linalg.norm(rows["d6"].toArray()[-2:]) == pytest.approx(1.0)
    fused = X.fuse_long(both.transform(table), dense, both.width).filter("stable_id = 'd0'").agg(F.sum(F.col("weight") * F.col("weight"))).first()[0]
    assert fused == pytest.approx(3.0)


def test_pooling_and_vector_rules(spark):
    chunks = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [0.0, 0.0, 1.0])], "stable_id int, embedding array<float>")
    got = {r["stable_id"]: r["embedding"] for r in V.mean_pool(chunks).collect()}
    assert got[0] == pytest.approx([2**-0.5, 2**-0.5, 0.0]) and got[1] == pytest.approx([0, 0, 1])
    bad = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("c", [1.0]), ("d", [2.0, 0.0]), ("e", None)], "stable_id string, embedding array<float>")
    rules = {r["stable_id"]: r["rule"] for r in V.vector_violations(bad, 2).collect()}
    assert rules == {"b": "non_finite", "c": "dimension", "d": "norm", "e": "dimension"}


def test_encoding_halves_batches_and_resumes(spark, tmp_path):
    base = V.hashing_encoder(8)

    def fragile(texts):
        if len(texts) > 2:
            raise MemoryError
        return base(texts)

    table = docs(spark, [f"text number {i} " * (i + 1) for i in range(9)])
    table = table.withColumns({"source_project": F.lit("A"), "issue_id": F.col("stable_id"), "stable_id": F.concat(F.lit("A:"), F.col("stable_id"))})
    path, who = str(tmp_path / "cache"), {"model": "hash"}
    encoding.build_cache(table.limit(4), fragile, 8, path, who)

    def only_new(texts):
        assert not any(t.startswith("text number 0 ") for t in texts)
        return base(texts)

    vectors, manifest = encoding.build_cache(table, only_new, 8, path, who)
    assert vectors.count() == 9 and manifest.first()["row_count"] == 9
    encoding.verify_cache(vectors, manifest, who, 8)
    with pytest.raises(IntegrityError):
        encoding.verify_cache(vectors, manifest.withColumn("row_count", F.lit(8)), who, 8)
    with pytest.raises(IntegrityError):
        encoding.build_cache(table.limit(3), base, 8, path, who)
    long = V.encode_long_documents(table.select("stable_id", "text"), base, length=5, step=4).collect()
    assert len(long) == 9 and all(np.linalg.norm(r["embedding"]) == pytest.approx(1.0, abs=1e-5) for r in long)


@pytest.fixture(scope="module")
def corpus(spark):
    words = {"major": "crash freeze broken", "normal": "typo label colour", "minor": "spacing margin icon"}
    rows = []
    for i in range(60):
        label = ("major", "normal", "minor")[i % 3]
        rows.append((f"A:{i}", f"{words[label]} item{i % 7}", f"details {words[label]}", label))
    df = spark.createDataFrame(rows, "stable_id string, summary string, description string, label string")
    t = SEVERITY.targets
    for task in t:
        df = df.withColumn(f"target_{task.lower()}", F.create_map(*[F.lit(x) for kv in t[task].items() for x in kv])[F.col("label")])
    df = df.withColumn("text_combined", F.concat("summary", F.lit("\n\n"), "description"))
    folds = [("pooled", fold, "TRAIN" if i < 15 * fold else "VALIDATION", f"A:{i}")
             for fold in (1, 2, 3) for i in range(60) if i < 15 * (fold + 1)]
    members = spark.createDataFrame(folds, "family string, fold long, role string, stable_id string")
    dense = V.encode_documents(df.select("stable_id", F.col("text_combined").alias("text")), V.hashing_encoder(16))
    return G.Corpus(df, members, SEVERITY, dense=dense, dimension=16)


def test_grid_resumes_ranks_and_searches(spark, corpus, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    G.require_disjoint_fold(corpus, 1)
    start = {"S2": ("WORD", "LOGREG", "BALANCED")}
    board = G.staged_search(corpus, store, "p", start=start, c_grid=(0.5,), representations=("WORD",), max_iter=5)
    got = {(r["stage"], r["text_view"]): r["rank"] for r in board.collect()}
    assert set(got) == {("S1", "SUMMARY_DESCRIPTION"), ("S2", "SUMMARY_DESCRIPTION"), ("S3", "SUMMARY_DESCRIPTION"),
                        ("S3", "SUMMARY_ONLY"), ("S3", "DESCRIPTION_ONLY")}
    stored = store.read()
    assert stored.count() == 15 and stored.filter("status = 'SUCCESS'").count() == 15
    assert stored.filter("reused").count() == 3
    before = stored.count()
    G.staged_search(corpus, store, "p", start=start, c_grid=(0.5,), representations=("WORD",), max_iter=5)
    assert store.read().count() == before
    with pytest.raises(RuntimeError, match="without a row"):
        G.fold_rows(G.Corpus(corpus.rows.limit(3), corpus.folds, SEVERITY), 1, "TRAIN")


def test_multiclass_fits_and_failures(spark, corpus):
    train, validation, width = G.fold_features(corpus, 3, "NONE", "SUMMARY_DESCRIPTION", True)
    assert width == 16
    targets = {t: f"target_{t.lower()}" for t in SEVERITY.tasks}
    specs = [linear.Spec(f"{t}-{c}", t, c, "BALANCED", 10.0) for t in ("S3", "S2") for c in ("LOGREG", "LINEARSVC")]
    rows, predictions = N.fit_and_score(train, validation, width, targets, SEVERITY.orders, specs)
    for row in rows.values():
        assert row["status"] == "SUCCESS", row
        assert row["metrics"]["macro_f1"] > 0.5
        assert sum(map(sum, row["confusion_matrix"])) == validation.count()
    assert predictions.count() == 4 * validation.count()
    failed, none = N.fit_and_score(train, validation, width, targets, SEVERITY.orders, [linear.Spec("x", "S3", "OTHER")])
    assert failed["x"]["status"] == "FAILED" and none is None
    dummies = {r["classifier"]: r["accuracy"] for r in G.dummy_baselines(corpus, 3, "S3").collect()}
    assert set(dummies) == {"DUMMY_MOST_FREQUENT", "DUMMY_STRATIFIED"}


def test_grid_metrics_and_board_follow_from_the_predictions(spark, corpus, tmp_path):
    """Every scalar and the board, recomputed by another engine from the written predictions."""
    import duckdb

    grid = G.dense_experiments(SEVERITY.tasks, folds=(1, 2)) + G.fusion_experiments(
        {"S3": ("WORD", "LOGREG", "NONE", 1.0)}, folds=(2,)
    )
    store, keep = ResultStore(spark, str(tmp_path / "results")), str(tmp_path / "predictions")
    results = G.run_grid(corpus, grid, store, "p", keep)
    assert results.count() == len(grid) == 25
    orders = [(t, c) for t, labels in SEVERITY.orders.items() for c in labels]
    want = {r[0]: r[1:] for r in duckdb.sql(f"""
with p as (select * from read_parquet('{keep}/*.parquet')),
classes(task, class) as (values {", ".join(map(str, orders))}),
s as (select f.fit, c.class, (select count(*) from p where p.fit = f.fit and y_true = c.class) as support,
  (select count(*) from p where p.fit = f.fit and y_pred = c.class) as guessed,
  (select count(*) from p where p.fit = f.fit and y_true = c.class and y_pred = c.class) as hits
  from (select distinct fit, task from p) f join classes c using (task))
select fit, avg(case when support + guessed > 0 then 2 * hits / (support + guessed) else 0 end), avg(hits / support) filter (support > 0),
  sum(hits) / sum(support) from s group by 1""").fetchall()}
    got = {r["experiment_id"]: (r["macro_f1"], r["balanced_accuracy"], r["accuracy"]) for r in G.flat_results(results).collect()}
    assert set(got) == set(want)
    for key, values in got.items():
        assert values == pytest.approx(want[key], abs=1e-9)


def test_final_model_is_published_loaded_and_used_once(spark, corpus, tmp_path):
    train = corpus.rows.filter("cast(substring(stable_id, 3, 9) as int) < 45")
    test = corpus.rows.join(train.select("stable_id"), "stable_id", "left_anti")
    methods = {"S6": ("LINEARSVC", "BALANCED", 0.5), "S3": ("LOGREG", "NONE", 1.0), "S2": ("LOGREG", "BALANCED", 1.0)}
    kinds = {"S6": "S6-R3", "S3": "WORD", "S2": "WORD"}
    final = G.train_final(train, SEVERITY, methods, kinds, corpus.dense, corpus.dimension)
    root, identity = str(tmp_path / "final"), {"protocol": "p"}
    with pytest.raises(IntegrityError, match="no published model"):
        bundles.load(spark, root)
    bundles.publish(spark, final, root, identity)
    name = bundles.publish(spark, final, root, identity)
    loaded = bundles.load(spark, root, identity)
    before = {(r["stable_id"], r["task"]): (r["y_pred"], r["score"]) for r in G.predict_final(final, test, corpus.dense).collect()}
    after = {(r["stable_id"], r["task"]): (r["y_pred"], r["score"]) for r in G.predict_final(loaded, test, corpus.dense).collect()}
    assert before == after and len(after) == 45
    with pytest.raises(IntegrityError, match="another identity"):
        bundles.load(spark, root, {"protocol": "q"})

    positive, receipts = {"S2": "HIGH_IMPACT"}, str(tmp_path / "receipts")
    texts = test.select("stable_id", "text_combined")
    scored = bundles.score_once(spark, root, receipts, identity, texts, test, SEVERITY, positive, corpus.dense)
    assert {r["task"]: r["rows"] for r in scored["metrics"].collect()} == {"S6": 15, "S3": 15, "S2": 15}
    assert scored["areas"].first()["roc_auc"] == pytest.approx(1.0)
    assert bundles.HeldOutAccess(spark, receipts).state() == "COMPLETED"
    with pytest.raises(IntegrityError, match="accessed before"):
        bundles.score_once(spark, root, receipts, identity, texts, test, SEVERITY, positive, corpus.dense)
    half = bundles.HeldOutAccess(spark, str(tmp_path / "half"))
    half.start(identity)
    with pytest.raises(IntegrityError, match="accessed before"):
        half.start(identity)
    predictions = G.predict_final(loaded, texts, corpus.dense, positive)
    with pytest.raises(IntegrityError, match="without a label"):
        G.score_final(predictions, test.limit(5), SEVERITY)

    part = next((tmp_path / "final" / name / "coefficients").glob("part-*.parquet"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(IntegrityError, match="files differ"):
        bundles.load(spark, root, identity)


def test_stream_reads_only_new_files(spark, tmp_path):
    schema = ("source_project string, record_number long, issue_id string, severity string, creation_time string, "
              "summary string, description string")
    src, check, sink = (str(tmp_path / n) for n in ("src", "check", "sink"))

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)

    add(("A", 1, "1", "major", "2020-01-01T00:00:00Z", "<b>x</b>", ""), ("A", 2, "2", " ", "bad", "", ""))
    got = I.audit_issue_stream(spark, src, spark.read.parquet(src).schema, check, sink).first()
    assert (got["rows"], got["has_html"], got["both_unavailable"], got["time_failed"], got["severity_blank"]) == (2, 1, 1, 1, 1)
    add(("A", 3, "3", "minor", "2020-01-05T00:00:00Z", "t", "d"), ("B", 1, "1", "minor", "", "t", "d"))
    again = {r["source_project"]: r["rows"] for r in I.audit_issue_stream(spark, src, spark.read.parquet(src).schema, check, sink).collect()}
    assert again == {"A": 3, "B": 1}


@pytest.mark.parametrize("size", [1, 40, 55, 120, 121])
def test_most_frequent_terms_go_by_total_then_term(spark, size):
    rows = [(f"t{i * 37 % 120:03d}", 2, 50 - i // 30 if i < 90 else 3 + i % 2) for i in range(120)]
    found = X.most_frequent(spark.createDataFrame(rows, "term string, df long, total long").repartition(5), size)
    want = sorted(rows, key=lambda r: (-r[2], r[0]))[:size]
    assert sorted(map(tuple, found.collect())) == sorted(want)
