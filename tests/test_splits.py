from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.functions.ids import duplicate_reference
from tracefold.operators import duplicates as D, fingerprints as P, memberships as H, ordering as O, split as S
from tracefold.operators.components import connected_components
from tracefold.plans import prepare as Prep
from tracefold.protocol import SEVERITY, IntegrityError, LockedDataError
from tracefold.sources import stores

START = datetime(2020, 1, 1)
SCHEMA = ("stable_id string, source_project string, issue_id string, creation_time timestamp, severity_raw string, "
          "target_s6 string, target_s3 string, target_s2 string, dupe_of string, exact_text_hash string")


def row(project, issue, day, text=None, dupe="", label="major"):
    t = SEVERITY.targets
    return (f"{project}:{issue}", project, issue, START + timedelta(days=day), label,
            t["S6"][label], t["S3"][label], t["S2"][label], dupe, text or f"h-{project}-{issue}")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ties_go_by_numeric_id(spark):
    rows = frame(spark, [row("A", i, 0) for i in ("10", "2", "1", "3", "4")])
    out = {r["issue_id"]: r for r in S.chronological_split(rows).collect()}
    assert {k for k, r in out.items() if r["partition"] == S.DEVELOPMENT} == {"1", "2", "3", "4"}
    assert out["10"]["boundary"] == 4 and out["10"]["block"] is None


def test_components_and_reasons(spark):
    rows = frame(spark, [
        row("A", "1", 0, "x"), row("A", "2", 1, "y", dupe="1"), row("B", "3", 9, "x"),
        row("A", "4", 2), row("A", "5", 3), row("A", "6", 9, "z", dupe="https://t/show_bug.cgi?id=2"),
        row("A", "7", 4, dupe="7"), row("A", "8", 5, dupe="99"), row("A", "9", 5, dupe="x?id=1 y?id=2"),
        row("B", "9", 0), row("A", "11", 6, dupe="9"),
    ])
    links = D.resolve_links(rows)
    outcome = {r["stable_id"]: r["outcome"] for r in links.collect()}
    assert outcome == {
        "A:2": "resolved", "A:6": "resolved", "A:7": "self_reference",
        "A:8": D.REASON_EXTERNAL, "A:9": D.REASON_AMBIGUOUS_TEXT, "A:11": D.REASON_AMBIGUOUS_TARGET,
    }
    comp = {r["stable_id"]: r["component"] for r in D.with_components(rows, links).collect()}
    assert {k for k, v in comp.items() if v == "A:1"} == {"A:1", "A:2", "B:3", "A:6"}
    split = D.with_components(rows, links).withColumns({
        "partition": F.when(F.col("stable_id").isin("B:3", "A:6"), S.CANDIDATE).otherwise(S.DEVELOPMENT),
        "block": F.when(~F.col("stable_id").isin("B:3", "A:6"), F.lit(1)),
    })
    reasons = {r["stable_id"]: r["locked_reason"] for r in S.purge_reasons(split).collect() if r["locked_reason"]}
    assert reasons == {"B:3": S.EXACT, "A:6": S.LINKED}
    none = D.unresolved_links(links.filter("outcome = 'resolved'")).collect()
    assert [tuple(r) for r in none] == [("ALL", "none", 0)]


def test_fold_of_eight_rows(spark):
    rows = frame(spark, [row("A", str(i), i, text="same" if i in (1, 2) else None) for i in range(1, 11)])
    placed = D.with_components(rows)
    out = S.final_partition(S.purge_reasons(S.chronological_split(placed)))
    sizes = {(r["family"], r["fold"]): r for r in S.fold_sizes(out).collect()}
    for family in ("pooled", "within_project"):
        assert sizes[(family, 1)]["training_rows"] == 2
        assert sizes[(family, 1)]["validation_candidate_rows"] == 2
        assert sizes[(family, 1)]["validation_removed_exact_text"] == 0
    shifted = frame(spark, [row("A", str(i), i, text="same" if i in (2, 3) else None) for i in range(1, 11)])
    out = S.final_partition(S.purge_reasons(S.chronological_split(D.with_components(shifted))))
    one = [r for r in S.fold_sizes(out).collect() if r["fold"] == 1 and r["family"] == "pooled"][0]
    assert (one["training_rows"], one["validation_candidate_rows"], one["validation_removed_exact_text"],
            one["validation_final_rows"]) == (2, 2, 1, 1)


def brute_force(rows):
    """Union-find, set-based split and folds, written independently of the operators."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[max(find(a), find(b))] = min(find(a), find(b))

    by_hash, by_issue = defaultdict(list), defaultdict(list)
    for r in rows:
        by_hash[r[9]].append(r[0])
        by_issue[r[2]].append(r[0])
    for members in by_hash.values():
        for m in members:
            join(members[0], m)
    for r in rows:
        target = by_issue.get(r[8].strip(), [])
        if r[8] and len(target) == 1:
            join(r[0], target[0])
    roots = {r[0]: find(r[0]) for r in rows}
    text = {r[0]: r[9] for r in rows}
    block, dev, cand = {}, set(), set()
    for project in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == project), key=lambda r: (r[3], int(r[2])))
        cut = len(ordered) * 4 // 5
        for i, r in enumerate(ordered):
            (dev if i < cut else cand).add(r[0])
            if i < cut:
                block[r[0]] = sum(i >= cut * k // 4 for k in range(4))
    def reasons(early, late):
        eroots, etext = {roots[e] for e in early}, {text[e] for e in early}
        return {x: "exact_text" if text[x] in etext else "explicit_dupe_link" for x in late if roots[x] in eroots}

    locked = reasons(dev, cand)
    project_of = {r[0]: r[1] for r in rows}
    pooled, within = {}, {}
    for fold in (1, 2, 3):
        train = {x for x in dev if block[x] <= fold}
        late = {x for x in dev if block[x] == fold + 1}
        pooled.update(reasons(train, late))
        for p in set(project_of.values()):
            within.update(reasons({x for x in train if project_of[x] == p}, {x for x in late if project_of[x] == p}))
    return roots, dev, cand, block, locked, pooled, within


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        project = "HOT" if rng.random() < 0.5 else rng.choice("XYZ")
        text = "hot" if rng.random() < 0.3 and seed == 2 else f"t{rng.randrange(330)}"
        dupe = str(rng.randrange(400)) if rng.random() < 0.25 else ""
        rows.append(row(project, str(i), rng.randrange(60), text, dupe, rng.choice(list(SEVERITY.accepted))))
    roots, dev, cand, block, locked, pooled, within = brute_force(rows)
    df, links = Prep.split_rows(frame(spark, rows))
    out = {r["stable_id"]: r for r in df.collect()}
    assert {k: r["component"] for k, r in out.items()} == roots
    assert {k for k, r in out.items() if r["block"] is not None} == dev
    assert {k: r["block"] for k, r in out.items() if k in dev} == block
    assert {k: r["locked_reason"] for k, r in out.items() if r["locked_reason"]} == locked
    assert {k: r["pooled_reason"] for k, r in out.items() if r["pooled_reason"]} == pooled
    assert {k: r["within_reason"] for k, r in out.items() if r["within_reason"]} == within
    folds = S.fold_memberships(df)
    clean = H.fold_violations(folds, df).collect()
    assert len(clean) == 6
    assert all(v == 0 for r in clean for k, v in r.asDict().items() if k not in ("family", "fold"))
    dirty = S.fold_memberships(df.withColumn("pooled_reason", F.lit(None).cast("string")))
    if pooled:
        leaks = H.fold_violations(dirty, df).filter("family = 'pooled'").agg(F.sum("component_leaks")).first()[0]
        assert leaks > 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)] + [("z1", "z2")], "u string, v string")
    found = connected_components(edges).collect()
    assert {r["component"] for r in found} == {"n0000", "z1"} and len(found) == 203
    assert connected_components(edges.limit(0)).count() == 0


def test_positions_and_running_sums_with_a_hot_group(spark):
    rng = random.Random(5)
    data = [("HOT" if i % 3 else f"g{i % 5}", i, rng.randrange(10)) for i in range(1000)]
    df = spark.createDataFrame(data, "g string, k long, w long")
    got = {(r["g"], r["k"]): (r["position"], r["group_rows"]) for r in O.with_position(df, ["g"], [F.col("w"), F.col("k")]).collect()}
    sums = {(r["g"], r["k"]): (r["w_through"], r["w_total"]) for r in O.with_running_sums(df, ["g"], [F.col("w"), F.col("k")], ["w"]).collect()}
    groups = defaultdict(list)
    for g, k, w in data:
        groups[g].append((w, k))
    for g, items in groups.items():
        total = 0
        for i, (w, k) in enumerate(sorted(items)):
            total += w
            assert got[(g, k)] == (i, len(items))
            assert sums[(g, k)] == (total, sum(x for x, _ in items))


def test_membership_fingerprints(spark, monkeypatch):
    import hashlib

    ids = [f"P:{i}" for i in range(50)]
    one = spark.createDataFrame([(i,) for i in ids], "stable_id string")
    two = spark.createDataFrame([(i,) for i in reversed(ids)], "stable_id string").repartition(3)
    digest = lambda d: P.membership_digest(d, F.col("stable_id")).first()["fingerprint"]
    assert digest(one) == digest(two) != digest(one.limit(49))
    doubled = one.unionByName(one.limit(1))
    assert digest(doubled) != digest(one)

    def tree(lines, width):
        for _ in range(4):
            blocks = [lines[i : i + width] for i in range(0, len(lines), width)]
            lines = [hashlib.sha256("".join(x + "\n" for x in b).encode()).hexdigest() for b in blocks]
        return lines[0]

    assert tuple(P.ordered_memberships(two).first()) == (50, tree(sorted(ids), P.BLOCK_LINES))
    monkeypatch.setattr(P, "BLOCK_BITS", 2)
    assert tuple(P.ordered_memberships(two).first()) == (50, tree(sorted(ids), 4))
    assert P.ordered_memberships(two.limit(0)).count() == 0
    pairs = spark.createDataFrame([("P:1", "A", 1), ("P:2", "B", 2)], "stable_id string, y_pred string, n int")
    swapped = spark.createDataFrame([("P:1", "B", 1), ("P:2", "A", 2)], "stable_id string, y_pred string, n int")
    first = lambda d: P.prediction_digest(d).first()["fingerprint"]
    assert first(pairs) != first(swapped)
    line = P.ordered_predictions(pairs, "n").first()["fingerprint"]
    assert line == tree(["P:1\tA", "P:2\tB"], 4)


def issue(project, n, day, text, label="major", dupe=""):
    stamp = (START + timedelta(days=day)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return (project, n, str(n), label, stamp, text, f"body {n % 7}", dupe)


RAW = ("source_project string, record_number long, issue_id string, severity string, creation_time string, "
       "summary string, description string, dupe_of string")


def test_prepare_publish_and_regenerate(spark, tmp_path):
    labels = list(SEVERITY.accepted)
    raw = spark.createDataFrame(
        [issue(p, n, n, f"{p} title {n % 17}", labels[n % 6], str(n - 3) if n % 10 == 0 else "")
         for p in ("A", "B") for n in range(1, 61)], RAW)
    paths = {k: str(tmp_path / k) for k in ("processed", "development", "locked", "manifests")}
    made = Prep.prepare(raw, SEVERITY, **paths, expected={"raw_rows": 120, "eligible_rows": 120})
    with pytest.raises(IntegrityError, match="drift"):
        Prep.prepare(raw, SEVERITY, expected={"raw_rows": 121})
    frozen = Prep.fingerprints(made)
    assert frozen.count() == len({r["membership"] for r in made.rows.select("membership").distinct().collect()}) + 13
    development = stores.read_development(spark, paths["development"])
    assert development.count() == made.rows.filter("membership = 'DEVELOPMENT'").count()
    with pytest.raises(LockedDataError):
        stores.read_locked_texts(spark, paths["locked"], None, "OPEN")
    texts = stores.read_locked_texts(spark, paths["locked"], "OPEN", "OPEN")
    labels_ = stores.read_locked_labels(spark, paths["locked"], "OPEN", "OPEN")
    assert H.set_differences(texts, labels_).count() == 0
    keys = P.membership_digest(made.folds, F.col("stable_id"), ["family", "fold", "role"])
    got = stores.read_membership(spark, paths["manifests"], family="pooled", fold=1, role="train", fingerprints=keys, project="A")
    assert got.count() > 0 and {r["source_project"] for r in got.collect()} == {"A"}
    wrong = keys.withColumn("fingerprint", F.lit("x"))
    with pytest.raises(IntegrityError):
        stores.read_membership(spark, paths["manifests"], family="pooled", fold=1, role="TRAIN", fingerprints=wrong)
    with pytest.raises(IntegrityError):
        stores.read_membership(spark, paths["manifests"], family="other", fold=1, role="TRAIN")
    manifest = stores.artifact_manifest(spark, paths["processed"])
    rows = stores.read_split_rows(spark, paths["processed"], manifest)
    compared = Prep.regenerate_folds(rows, frozen, S.fold_sizes(made.rows), str(tmp_path / "again"))
    assert {r["status"] for r in compared.collect()} == {"MATCH"}
    with pytest.raises(IntegrityError, match="membership drift"):
        Prep.regenerate_folds(rows.limit(100), frozen, S.fold_sizes(made.rows), str(tmp_path / "third"))
    with pytest.raises(IntegrityError, match="artifact drift"):
        stores.read_split_rows(spark, paths["processed"], manifest.withColumn("sha256", F.lit("x")))


def test_reference_expression_is_used(spark):
    assert spark.createDataFrame([("5",)], "r string").select(duplicate_reference(F.col("r"))).first()[0] == "5"


def test_cache_membership_rules(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "stable_id string")
    H.require_exact_membership(ids("P:1", "P:2"), ids("P:2", "P:1"), ids("P:9"))
    with pytest.raises(IntegrityError):
        H.require_exact_membership(ids("P:1", "P:2"), ids("P:1", "P:3"))
    with pytest.raises(IntegrityError):
        H.require_exact_membership(ids("P:1", "P:1"), ids("P:1"))
    with pytest.raises(IntegrityError):
        H.require_exact_membership(ids("P:1"), ids("P:1"), ids("P:1"))
