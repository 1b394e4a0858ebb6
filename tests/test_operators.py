"""Operators on small worlds, against direct computation."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from matchloom.operators import candidates as C
from matchloom.operators import decisions as D
from matchloom.operators import features as X
from matchloom.operators import lists as L
from matchloom.operators import metrics as M
from matchloom.operators import models, sampling
from matchloom.sources import records as R
from matchloom.streaming.resumable import Workspace


def f05(tp, k, truth):
    if truth == 0:
        return float(k == 0)
    return 1.25 * tp / (k + 0.25 * truth) if tp else 0.0


def world(spark, seed, lists=40):
    """Random scored pairs with ties, gold outside the lists and empty lists."""
    rng = random.Random(seed)
    pairs, entities = [], []
    for s in range(lists):
        hits = 0
        for t in range(rng.randint(0, 6)):
            label = int(rng.random() < 0.4)
            hits += label
            pairs.append((f"q{s}", f"t{rng.randint(0, 60)}-{t}", round(rng.random(), 1), label))
        entities.append((f"q{s}", hits + int(rng.random() < 0.25)))
    return (
        spark.createDataFrame(pairs, "s1_id string, t_id string, score double, label int"),
        spark.createDataFrame(entities, "s1_id string, truth_len long"),
        pairs,
        dict(entities),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_equals_direct_evaluation(spark, seed):
    pairs, entities, rows, truth = world(spark, seed)
    curve = {r.threshold: r.macro_f05 for r in D.sweep(entities, pairs).collect()}
    for t, value in curve.items():
        k = {s: [r for r in rows if r[0] == s and r[2] >= t] for s in truth}
        want = sum(f05(sum(r[3] for r in k[s]), len(k[s]), truth[s]) for s in truth) / len(truth)
        assert abs(value - want) < 1e-8
    assert set(curve) == {r[2] for r in rows} | {D.NOTHING}
    best = D.best_threshold(D.sweep(entities, pairs)).first()
    assert best.macro_f05 == max(curve.values())
    assert best.threshold == max(t for t, v in curve.items() if v == best.macro_f05)


def test_f05_goldens(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (0, 0, 0), (0, 1, 0), (0, 0, 2)], "tp long, k long, t long")
    got = [r.x for r in df.select(D.f05(F.col("tp"), F.col("k"), F.col("t")).alias("x")).collect()]
    assert got == pytest.approx([1.25 / 1.75, 1.25 / 2.25, 1, 0, 0])


def test_expected_f_equals_enumeration(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(12):
        p = sorted((round(rng.random(), 2) for _ in range(rng.randint(1, 5))), reverse=True)
        rows += [(f"q{s}", f"t{s}-{i}", x) for i, x in enumerate(p)]
        best = (-1.0, 0)
        for k in range(len(p) + 1):
            e = 0.0
            for bits in itertools.product((0, 1), repeat=len(p)):
                weight = 1.0
                for b, x in zip(bits, p):
                    weight *= x if b else 1 - x
                e += weight * f05(sum(bits[:k]), k, sum(bits))
            e = round(e, 9)
            if e > best[0] + 1e-12:
                best = (e, k)
        want[f"q{s}"] = best
    got = {r.s1_id: r for r in D.expected_f_sizes(spark.createDataFrame(rows, "s1_id string, t_id string, score double")).collect()}
    for s, (e, k) in want.items():
        assert abs(got[s].expected_f05 - e) < 1e-6 and got[s].k_star == k


def test_one_owner_ties(spark):
    rows = [("a", "t1", 0.9, 1), ("b", "t1", 0.9, 0), ("c", "t2", 0.5, 1), ("c", "t1", 0.4, 0)]
    df = spark.createDataFrame(rows, "s1_id string, t_id string, score double, label int")
    assert {(r.s1_id, r.t_id) for r in D.one_owner(df).collect()} == {("a", "t1"), ("c", "t2")}
    stats = D.owner_stats(df).first()
    assert (stats.claims, stats.targets_in_conflict, stats.claims_dropped, stats.dropped_true, stats.dropped_false) == (4, 1, 2, 0, 2)


def test_siblings(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", None), ("a", "w", 0.7), ("b", "x", 1.0)]
    got = {(r.s1_id, r.t_id): r.siblings for r in L.siblings(spark.createDataFrame(rows, "s1_id string, t_id string, score double"), "score", 2).collect()}
    assert got == {("a", "x"): ["y", "w"], ("a", "y"): ["x", "w"], ("a", "z"): ["x", "y"], ("a", "w"): ["x", "y"], ("b", "x"): []}


def test_top_k_puts_missing_scores_last(spark):
    rows = [("a", "x", None), ("a", "y", 0.1), ("a", "z", 0.1)]
    assert [r.t_id for r in L.keep_top(spark.createDataFrame(rows, "s1_id string, t_id string, score double"), "score", 2).orderBy("t_id").collect()] == ["y", "z"]


def test_auc(spark):
    df = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.9, 0), ("a", "z", 0.1, 0), ("b", "x", 0.5, 1)], "s1_id string, t_id string, score double, label int")
    assert D.pair_auc(df).first().auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_records_round_trip(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme "x"\t\tUS\nS2-5\t"a ""b"""\tMain\tUS\n', encoding="utf-8")
    got = {r.entity_id: r for r in R.read_records(spark, str(path)).collect()}
    assert got["S1-1"].address == "" and got["S2-5"].name == 'a "b"' and got["S2-5"].source == 2
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tc\nS1-1\ta\tb\tc\n", encoding="utf-8")
    with pytest.raises(ValueError):
        R.read_records(spark, str(path))


def test_truth_lists(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n", encoding="utf-8")
    truth = R.read_truth(spark, str(path))
    assert {r.s1_id: r.matched for r in truth.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    assert {r.s1_id: r.truth_len for r in R.entities(truth).collect()} == {"S1-1": 2, "S1-2": 0}
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\n", encoding="utf-8")
    with pytest.raises(PySparkException):
        R.read_truth(spark, str(path)).collect()


def test_match_lists_and_validation(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1", 0), ("S1-2", 1)], "s1_id string, row int")
    predicted = spark.createDataFrame([("S1-1", "S2-9", 2), ("S1-1", "S3-1", 1)], "s1_id string, t_id string, rank int")
    lists = R.match_lists(ids, predicted, "rank")
    assert {r.s1_id: r.matched_entity_ids for r in lists.collect()} == {"S1-1": "S3-1,S2-9", "S1-2": ""}
    targets = spark.createDataFrame([("S2-9",), ("S3-1",)], "t_id string")
    assert R.validate_matches(lists, ids, predicted, targets) == []
    assert R.validate_matches(lists, ids, predicted.where("rank = 1"), targets.where("t_id = 'S3-1'")) == ["an id does not exist", "a match is not among the candidates"]
    R.write_matches(lists, str(tmp_path / "out"), "row")
    assert {r.s1_id: r.matched for r in R.read_truth(spark, str(tmp_path / "out")).collect()} == {"S1-1": ["S3-1", "S2-9"], "S1-2": []}
    assert R.empty_matches(ids).where("matched_entity_ids <> ''").isEmpty()


def test_hard_negatives(spark):
    rows = [("a", f"t{i}", i, int(i == 7)) for i in range(12)]
    got = sampling.hard_negatives(spark.createDataFrame(rows, "s1_id string, t_id string, r int, label int"), "r", 2, 3).collect()
    assert sum(x.label for x in got) == 1 and len(got) == 6
    assert {x.t_id for x in got} >= {"t7", "t0", "t1"}
    assert sum(x.weight for x in got) == pytest.approx(12)


def test_folds(spark):
    truth = spark.createDataFrame([("S1-1", ["x"]), ("S1-2", ["y"])], "s1_id string, matched array<string>")
    assert sampling.make_folds(truth).count() == 2
    with pytest.raises(ValueError):
        sampling.make_folds(spark.createDataFrame([("S1-1", ["x"]), ("S1-2", ["x"])], "s1_id string, matched array<string>"))
    ids = spark.range(1000).select(F.col("id").cast("string").alias("i"))
    placed = sampling.split_positions(ids, "i", {"train": (0, 799), "test": (800, 999)})
    assert sorted(r.position for r in placed.collect()) == list(range(1000))
    first = {r.i for r in sampling.ordered_prefix(ids, "i", 10).collect()}
    assert first == {r.i for r in placed.where("position < 10").collect()}


def test_dense_neighbours_blocks_agree(spark):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    q = spark.createDataFrame([(i, i % 2, vec()) for i in range(20)] + [(99, 7, vec())], "s1_id long, place int, vector array<double>")
    t = spark.createDataFrame([(i, i % 2, vec()) for i in range(80)], "t_id long, place int, vector array<double>")
    rows = lambda block: sorted(map(tuple, C.dense_neighbours(q, t, 5, block).collect()))
    assert rows(4096) == rows(7)
    assert len(rows(4096)) == 100


def test_canonical_map(spark):
    subs = spark.createDataFrame([("rd", "road", 50), ("road", "rod", 40), ("x", "y", 2)], "a string, b string, n long")
    assert {tuple(r) for r in X.canonical_map(subs, 30, 0.4).collect()} == {("road", "rd"), ("rod", "rd")}


def test_calibration(spark):
    import math

    logit = lambda p: math.log(p / (1 - p))
    rows = [(logit(0.1), 0), (logit(0.2), 1), (logit(0.3), 0), (logit(0.9), 1)]
    df = spark.createDataFrame(rows, "logit double, label int")
    got = [r.p for r in models.calibrate(df, models.fit_calibrator(df, "logit"), "logit").orderBy("logit").collect()]
    assert got == pytest.approx([0, 0.5, 0.5, 1], abs=1e-6)


def test_models_rank_the_signal(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        label = i % 3 == 0
        rows.append((f"q{i // 3}", f"t{i}", float(label) + rng.gauss(0, 0.3), None if i % 7 == 0 else rng.random(), int(label)))
    df = spark.createDataFrame(rows, "s1_id string, t_id string, x double, y double, label int")
    for fit in (models.fit_logistic, lambda d, c: models.fit_trees(d, c, rounds=5)):
        scored = models.out_of_fold(df, ["x", "y"], fit, folds=2)
        assert scored.count() == 300
        assert D.pair_auc(scored.withColumnRenamed("q", "score")).first().auc > 0.9


def test_quantiles_and_fingerprint(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int")
    assert M.lower_quantile(df, "x", 0.5).first().q == 2
    assert M.fingerprint(df) == M.fingerprint(df.orderBy(F.col("x").desc()))
    assert M.same_result(df, df.orderBy("x")) and not M.same_result(df, df.limit(3))


def test_workspace_skips_finished_stages(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    space = Workspace(spark, str(tmp_path), {"k": 1})
    assert space.stage("a", make).count() == 5 and space.stage("a", make).count() == 5
    assert len(calls) == 1 and space.unchanged("a")
    Workspace(spark, str(tmp_path), {"k": 2}).stage("a", make)
    assert len(calls) == 2


def test_flow_finds_copies(spark):
    from matchloom.plans.linkage import link

    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, gold = [], []
    for i in range(60):
        name, address = " ".join(rng.sample(words, 4)), " ".join(rng.sample(words, 4))
        rows.append((f"S1-{i}", 1, "us", name, address))
        if i % 2:
            rows.append((f"S2-{i}", 2, "us", name + " ltd", address))
            gold.append((f"S1-{i}", f"S2-{i}"))
    rows += [(f"S3-{i}", 3, "us", " ".join(rng.sample(words, 4)), "") for i in range(40)]
    records = spark.createDataFrame(rows, "entity_id string, source int, country string, name string, address string")
    links = spark.createDataFrame(gold, "s1_id string, t_id string")
    n = links.groupBy("s1_id").agg(F.count("*").alias("truth_len"))
    entities = records.where("source = 1").select(F.col("entity_id").alias("s1_id")).join(n, "s1_id", "left").fillna(0)
    found = {(r.s1_id, r.t_id) for r in link(records, links, entities).collect()}
    assert len(found & set(gold)) >= 25 and len(found - set(gold)) <= 3


# ---- running totals, policies, training rows, checks


def test_running_totals(spark):
    rng = random.Random(5)
    rows = [(i / 7, rng.randint(-5, 5)) for i in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "x double, v long")
    for down in (False, True):
        got = {r.x: r.total for r in L.running_totals(df, "x", {"total": "v"}, descending=down, runs=16).collect()}
        total, want = 0, {}
        for x, v in sorted(rows, reverse=down):
            total += v
            want[x] = total
        assert got == want
    assert L.running_totals(df.limit(0), "x", {"total": "v"}).count() == 0


def test_policies_equal_brute_force(spark):
    rng = random.Random(8)
    pairs, ents = [], []
    for i in range(40):
        truth = rng.choice([0, 1, 1, 2])
        ents.append((f"q{i:02}", truth))
        for j in range(rng.randint(0, 5)):
            pairs.append((f"q{i:02}", f"t{rng.randint(0, 60):02}x{j}", round(rng.random(), 2), int(rng.random() < 0.4 * truth)))
    e, p = spark.createDataFrame(ents, "s1_id string, truth_len long"), spark.createDataFrame(pairs, "s1_id string, t_id string, score double, label int")
    best = {}
    for s, _, score, _ in pairs:
        best[s] = max(best.get(s, 0), score)

    def value(rows):
        out = 0.0
        for s, truth in ents:
            mine = [x for x in rows if x[0] == s]
            tp = sum(x[3] for x in mine)
            out += (1.0 if not mine else 0.0) if truth == 0 else (1.25 * tp / (len(mine) + 0.25 * truth) if tp else 0.0)
        return round(out / len(ents), 9)

    scores = sorted({x[2] for x in pairs})
    found = D.tune_policies(e, p)
    assert [(x.family, x.one_owner) for x in found] == [(f, o) for o in (False, True) for f in ("threshold", "empty_guard", "relative")]
    assert found[0].macro_f05 == max(value([x for x in pairs if x[2] >= t]) for t in [*scores, 2.0])
    assert found[2].macro_f05 == max([value([x for x in pairs if x[2] >= t and x[2] >= r * best[x[0]]]) for t in scores for r in D.RATIOS] + [value([])])
    for policy in found:
        rows = [(r.s1_id, r.t_id, r.score, r.label) for r in policy.apply(p).collect()]
        assert value(rows) == policy.macro_f05
    chosen = D.choose_policy(found)
    assert chosen.macro_f05 >= max(x.macro_f05 for x in found) - 1e-5
    assert all(x.complexity >= chosen.complexity or x.macro_f05 < max(y.macro_f05 for y in found) - 1e-5 for x in found)


def test_training_pairs(spark):
    truth = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t3"), ("c", "t4")], "s1_id string, t_id string")
    folds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), ("d", 1)], "s1_id string, fold int")
    none = spark.createDataFrame([], "s1_id string")
    got = sampling.gold_rounds(truth, folds, [1, 2], none).collect()
    assert sorted((r.s1_id, r.round) for r in got) == [("a", 0), ("a", 1), ("b", 0)]
    assert {r.round for r in sampling.gold_rounds(truth, folds, [1, 2], none, most=2).collect()} == {0}
    for bad, held in (([0, 1], none), ([1], spark.createDataFrame([("a",)], "s1_id string")), ([4], none)):
        with pytest.raises(ValueError):
            sampling.gold_rounds(truth, folds, bad, held)
    with pytest.raises(ValueError):
        sampling.training_rows(spark.createDataFrame([("a", "t", -1, 0)], "s1_id string, t_id string, label int, filter_rank int"), spark.createDataFrame([("a", 1)], "s1_id string, n_cand int"), 1, 1, 1)


def test_same_place_negatives(spark):
    records = spark.createDataFrame([(f"S2-{i}", 2, "x" if i < 6 else "y" if i < 8 else "") for i in range(10)], "entity_id string, source int, address string")
    truth = spark.createDataFrame([("S1-1", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-3", "S2-6"), ("S1-3", "S2-7"), ("S1-4", "S2-9")], "s1_id string, t_id string")
    rows = sampling.same_place_pairs(truth, records).collect()
    own = {("S1-1", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-3", "S2-6"), ("S1-3", "S2-7"), ("S1-4", "S2-9")}
    assert {(r.s1_id, r.t_id) for r in rows if r.label == 1} == own
    wrong = [(r.s1_id, r.t_id) for r in rows if r.label == 0]
    assert len(wrong) == len(set(wrong)) == 3 and not set(wrong) & own and {s for s, _ in wrong} == {"S1-1", "S1-2"}
    assert all(t in {f"S2-{i}" for i in range(6)} for _, t in wrong)


def test_raw_features_by_hand(spark):
    records = [("S1-1", 1, "Acme", "12 Main Rd"), ("S2-1", 2, "Acme", "12 main road"), ("S2-2", 2, "Acme", "Main st 14"), ("S2-3", 2, "", ""), ("S1-2", 1, "Zed", ""), ("S2-4", 2, "zed", "5 x")]
    r = spark.createDataFrame(records, "entity_id string, source int, name string, address string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.8), ("S1-1", "S2-3", 0.1), ("S1-2", "S2-4", 0.5)], "s1_id string, t_id string, score double")
    got = {r.t_id: r for r in X.raw_features(pairs, r, "score").collect()}
    assert (got["S2-1"].raw_name_ratio_s1, got["S2-1"].raw_name_eq_s1, got["S2-1"].raw_name_eq_sib, got["S2-1"].street_sim_s1_exp) == (100, 1, 1, 100)
    assert got["S2-1"].first_num_agree_sib == 0 and got["S2-1"].raw_name_ratio_sib_max == 100
    assert abs(got["S2-1"].street_sim_sib_max - 200 * 4 / 11) < 1e-9  # road main and main st share one word
    assert (got["S2-3"].raw_name_ratio_s1, got["S2-3"].addr_raw_ratio_s1, got["S2-3"].street_sim_s1_exp, got["S2-3"].street_sim_sib_max, got["S2-3"].first_num_agree_sib) == (0, None, None, None, None)
    assert (got["S2-4"].raw_name_eq_sib, got["S2-4"].raw_name_ratio_sib_max, got["S2-4"].addr_raw_ratio_s1) == (0, None, None)


def test_restrict_counts_anew(spark):
    pairs = spark.createDataFrame([("a", "x", 1, 0.9), ("a", "y", 1, None), ("a", "z", 0, 0.5), ("b", "x", 0, 0.1)], "s1_id string, t_id string, label int, score double")
    e = spark.createDataFrame([("a", 2, 9, 9), ("b", 0, 9, 9), ("c", 1, 9, 9)], "s1_id string, truth_len int, n_cand int, retrieved_truth int")
    kept, counted = L.restrict(pairs, e, "score", 2)
    assert {(r.s1_id, r.t_id) for r in kept.collect()} == {("a", "x"), ("a", "z"), ("b", "x")}
    assert sorted(map(tuple, counted.collect())) == [("a", 2, 2, 1), ("b", 0, 1, 0), ("c", 1, 0, 0)]
    unlabelled = L.restrict(pairs.withColumn("label", F.lit(-1)), e, "score", 2)[1]
    assert {r.retrieved_truth for r in unlabelled.collect()} == {9}


def test_key_classes_hold_all_links(spark):
    records = spark.createDataFrame([(f"S{1 + i % 3}-{i}", 1 + i % 3, "x", "k" if i < 8 else "") for i in range(10)], "entity_id string, source int, country string, name string")
    pairs = C.exact_name(records).collect()
    classes = {r.entity_id: r for r in C.key_classes(records, F.col("name")).collect()}
    assert sum(classes[i].n_links for i in classes if i.startswith("S1")) == len(pairs) and len({r.class_id for r in classes.values()}) == 1
    few = {(r.s1_id, r.source): 0 for r in pairs}
    for r in C.exact_name(records, 1).collect():
        few[r.s1_id, r.source] += 1
        assert r.t_id == min(p.t_id for p in pairs if p.source == r.source)
    assert set(few.values()) == {1}


def test_audits(spark):
    rows = [("S2-1", "Acme", "x", "us"), ("S2-1", "ACME!", "x", "us"), ("bad", "", "é", ""), ("S2-3", "Acme", "x", "us")]
    r = spark.createDataFrame(rows, "entity_id string, name string, address string, country string")
    a = M.audit_records(r, "S2", r.where("entity_id = 'S2-3'")).first()
    assert (a.n_rows, a.invalid_ids, a.repeated_ids, a.missing_name, a.missing_country, a.non_ascii_address) == (4, 1, 1, 1, 1, 1)
    assert (a.repeated_rows, a.repeated_normalised, a.ids_elsewhere, a.rows_elsewhere, a.normalised_elsewhere) == (1, 2, 1, 2, 3)
    truth = spark.createDataFrame([("S1-1", ["S2-1", "S2-1", "S9-1"]), ("S1-1", ["S2-1"]), ("x", ["S3-9"])], "s1_id string, matched array<string>")
    known = spark.createDataFrame([("S1-1", 1), ("S2-1", 2)], "entity_id string, source int")
    t = M.audit_truth(truth, known).first()
    assert (t.n_rows, t.repeated_queries, t.invalid_queries, t.unknown_queries, t.lists_with_repeats, t.invalid_targets, t.unknown_targets, t.links_s2, t.links_s3, t.reused_targets) == (3, 1, 1, 1, 1, 1, 1, 2, 1, 1)


def test_gates(spark):
    assert D.adoption_gate(0.003, 0.001, {"fr": -0.004})["passed"] and not D.adoption_gate(0.003, 0.001, {"fr": -0.006})["passed"]
    limits = {"recall_drop": 0.5, "every_match_drop": 1, "p95": 800, "slice_drop": 2}
    pilot = {"link_recall": 0.97, "every_match_pct": 95.0}
    good = {"link_recall": 0.966, "every_match_pct": 94.5, "p95": 700}
    assert D.retrieval_gate(good, pilot, limits, {"fr": (0.9, 0.91), "x": (None, 0.5)})["passed"]
    assert not D.retrieval_gate({**good, "p95": 900}, pilot, limits)["passed"] and not D.retrieval_gate(good, pilot, limits, {"fr": (0.9, 0.93)})["passed"]
    run = {"links": 10, "every_match_pct": 90.0, "total": 100, "median": 1, "p95": 2, "p99": 3, "max": 4}
    assert D.platform_gate(run, run, {"links": 0, "every_match_pct": 0, "total": 0})["within"]
    assert not D.platform_gate({**run, "max": 5}, run, {"links": 0, "every_match_pct": 0, "total": 0})["within"]
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, t_id string")
    D.check_scores(pairs.withColumn("q", F.lit(0.5)), pairs, "q")
    for bad in (pairs.withColumn("q", F.lit(float("nan"))), pairs.limit(1).withColumn("q", F.lit(0.5)), pairs.union(pairs).withColumn("q", F.lit(0.5))):
        with pytest.raises(ValueError):
            D.check_scores(bad, pairs, "q")


def test_expected_f_with_missed_gold(spark):
    pairs = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.2)], "s1_id string, t_id string, score double")
    plain, missed = (D.expected_f_sizes(pairs, extra_missed=m).first() for m in (0.0, 2.0))
    assert (plain.k_star, round(plain.expected_f05, 6)) == (1, 0.483333)
    one = 0.4 * 1.25 / (1.25 + 0.25 * 2) + 0.1 * 1.25 / (1.25 + 0.25 * 3)
    assert one < 0.4 and (missed.k_star, round(missed.expected_f05, 6)) == (0, 0.4)


def test_bags_and_transfer(spark):
    rng = random.Random(2)
    rows = [(f"q{i // 4}", f"t{i}", float(i % 4), rng.random(), int(i % 4 == 3), "a" if i % 8 < 4 else "b") for i in range(240)]
    df = spark.createDataFrame(rows, "s1_id string, t_id string, x double, noise double, label int, country string")
    fit = lambda d, f, **kw: models.fit_trees(d, f, rounds=2, depth=2, **kw)
    bag = models.predict_bag(models.fit_bag(df, ["x", "noise"], [0, 1], fit), df, ["x", "noise"])
    assert D.pair_auc(bag.withColumnRenamed("q", "score")).first()["auc"] > 0.95
    oof, there, final = models.fit_with_transfer(df, ["x", "noise"], F.col("country") == "a", models.fit_logistic, folds=2)
    assert oof.count() == 240 and {r.country for r in there.collect()} == {"b"} and final is not None
    assert models.oof_auc(df, ["x", "noise"], 2).first()["auc"] > 0.95


def test_plans_hold_no_global_order(spark):
    """Thresholds, AUC and seeded prefixes: no window over all rows without a partition, but over the few runs."""
    df = spark.createDataFrame([("a", "x", 0.5, 1)], "s1_id string, t_id string, score double, label int")
    plan = L.running_totals(df.groupBy("score").agg(F.count("*").alias("n")), "score", {"total": "n"})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line and "windowspecdefinition" in line]
    assert len(windows) == 2 and sum("__run#" in line.split("windowspecdefinition")[1].split(",")[0] for line in windows) == 2


@pytest.mark.parametrize("block", [8, 1 << 21])
def test_tfidf_blocks_equal_direct_computation(spark, block, monkeypatch):
    """Pairs are ranked inside blocks and never exchanged, ties go by id, records that share an id count as one."""
    import collections
    import math

    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    rows = [(f"S{s}-{i}", s, c, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for s, c, n in ((1, "a", 12), (2, "a", 30), (3, "a", 25), (1, "b", 6), (2, "b", 7), (1, "d", 2)) for i in range(n)]
    rows = [(f"{e}{c}", s, c, x) for e, s, c, x in rows] + [("S2-3a", 2, "a", "w1 w2 w2"), ("S1-x", 1, None, "w1")]
    monkeypatch.setattr(C, "_CELLS", 64)
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, name string")
    route = C.tfidf_route(df, C.word_grams(F.col("name")), max_df=0.3, k=5, block=block)
    plan = route._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan
    want = set()
    gram = lambda x: x.split() + [" ".join(p) for p in itertools.pairwise(x.split())]
    for source, country in {(s, c) for _, s, c, _ in rows if s > 1}:
        t, q = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
        for e, s, c, x in rows:
            if c == country and s in (1, source):
                (q if s == 1 else t)[e].update(gram(x))
        n = sum(s == source and c == country for _, s, c, _ in rows)
        dfs = collections.Counter(g for v in t.values() for g in v)
        idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in dfs.items() if d <= max(2, n * 0.3)}
        weigh = lambda v: {g: (1 + math.log(m)) * idf[g] for g, m in v.items() if g in idf}  # noqa: B023, E731
        norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
        for e, v in q.items():
            a = weigh(v)
            scored = []
            for f, u in t.items():
                b = weigh(u)
                if a.keys() & b.keys():
                    scored.append((-round(sum(a[g] * b[g] for g in a.keys() & b.keys()) / norm(a) / norm(b), 6), f))
            want |= {(e, f, source, -x, r) for r, (x, f) in enumerate(sorted(scored)[:5], 1)}
    assert {(r.s1_id, r.t_id, r.source, r.score, r["rank"]) for r in route.collect()} == want


def test_dense_links_are_counted_not_listed(spark):
    """The slices of the dense report come from counts of the blocks and the top lists, as from all pairs."""
    rng = random.Random(4)
    vectors = [(i, rng.choice("ab") if i < 58 else "c", [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    e = spark.createDataFrame(vectors, "vec_id long, place string, vector array<double>")
    q, t = e.withColumnRenamed("vec_id", "s1_id"), e.withColumnRenamed("vec_id", "t_id").where("place != 'c' or t_id = 58")
    every = C.dense_neighbours(q, t, 1 << 30).localCheckpoint()
    truth = every.where("dense_score >= 0.2").select("s1_id", "t_id").join(q.select("s1_id", "place"), "s1_id")
    dense = every.where("dense_rank < 8")
    want = M.dense_coverage(truth, dense.where("dense_rank >= 3"), dense, [1, 5, 10], "place")
    found = C.dense_neighbours(q, t, 8, 7).where("dense_score >= 0.2").join(q.select("s1_id", "place"), "s1_id")
    found = found.select("place", "dense_rank", (F.col("dense_rank") >= 3).alias("in_list"))
    got = M.dense_coverage_counts(C.dense_link_counts(q, t, 0.2, 7), found, [1, 5, 10], "place")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_corpus_context_moves_no_text(spark):
    """Names and addresses are compared as digests of 16 bytes, so a long text costs no more than a short one; empty and null values keep their meaning."""
    rows = [("S1-1", 1, "a", "n", "x" * 5000), ("S1-2", 1, "a", "", None), ("S2-1", 2, "a", "n", "x" * 5000), ("S2-2", 2, "a", "n", ""), ("S2-3", 2, "b", "", "y")]
    r = spark.createDataFrame(rows, "entity_id string, source int, country string, name string, address string")
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-3")], "s1_id string, t_id string")
    out = X.corpus_context(pairs, r.where("source = 1"), r.where("source > 1"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") >= 5
    names = ["s1_same_name", "s1_same_addr", "tg_same_name", "tg_same_addr", "s1_same_tname", "t_addr_empty", "s1_addr_empty", "name_eq", "addr_eq", "list_same_tname"]
    got = {(x.s1_id, x.t_id): [x[c] for c in names] for x in out.collect()}
    assert got == {
        ("S1-1", "S2-1"): [1, 1, 2, 1, 1, 0, 0, 1, 1, 2],
        ("S1-1", "S2-2"): [1, 1, 2, 0, 1, 1, 0, 1, 0, 2],
        ("S1-2", "S2-3"): [0, 0, 0, 1, 0, 0, None, 0, 0, 0],
    }


def test_fusion_exchanges_candidates_once(spark):
    rows = [(f"q{i % 7}", f"t{i % 11}", 2, i / 100, 1, route, bit) for i in range(60) for route, bit in (("x", 1), ("y", 2)) if i % (bit + 1) == 0]
    rows = list({(r[0], r[1], r[5]): r for r in rows}.values())
    c = spark.createDataFrame(rows, "s1_id string, t_id string, source int, score double, rank int, route string, bit long")
    for out in (L.fuse(c), L.route_evidence(c, ["x", "y"])):
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and out.count() == len({(r[0], r[1]) for r in rows})


def test_pair_features_need_no_address(spark):
    """Pairs carry lengths, so the texts of an address are not needed where features are joined to them."""
    rows = [("S1-1", 1, "us", "acme tools", "1 main street"), ("S2-1", 2, "us", "acme", ""), ("S3-1", 3, "us", "", "1 main st")]
    store = X.token_store(spark.createDataFrame(rows, "entity_id string, source int, country string, name string, address string"))
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], "s1_id string, t_id string")
    got = {r.t_id: r.asDict() for r in X.cheap_features(pairs, store.drop("address")).collect()}
    assert got == {r.t_id: r.asDict() for r in X.cheap_features(pairs, store).collect()}
    assert [(r["name_len_ratio"], r["addr_len_ratio"], r["tgt_name_missing"], r["tgt_addr_missing"]) for _, r in sorted(got.items())] == [(0.4, 0.0, 0, 1), (0.0, 9 / 13, 1, 0)]


def test_routes_are_ranked_behind_one_exchange(spark):
    """The union of routes has the rows of the routes by themselves, and is fused where its one exchange put it."""
    rows = [(f"S{s}-{i}", s, "us", f"acme w{i % 7} v{i % 3}", f"street {i % 5} no {i}") for i in range(40) for s in (1, 2, 3)]
    records = spark.createDataFrame(rows, "entity_id string, source int, country string, name string, address string")
    routes = {"exact_name": C.exact_name, "rare_name": C.rare_names, "own": lambda r: C.rare_digits(r, k=2)}
    every = C.all_routes(records, routes)
    got = sorted(tuple(r) for r in every.select("route", "s1_id", "t_id", "source", "score", "rank").collect())
    want = sorted((name, *(r[c] for c in ("s1_id", "t_id", "source", "score", "rank"))) for name, route in routes.items() for r in route(records).collect())
    assert got == want and len({r[0] for r in got}) == 3
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan(L.fuse(every, deal=False)).count("Exchange hashpartitioning") == plan(every).count("Exchange hashpartitioning")
    assert sorted(L.fuse(every, deal=False).collect()) == sorted(L.fuse(every).collect())


def _char_records(spark, n=60, words=12):
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdeé😀", k=rng.randint(2, 6))) for _ in range(words)]
    rows = [(f"S{1 + i % 3}-{i}", 1 + i % 3, "ab"[i % 7 == 0], " ".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(n)]
    rows += [("S2-1", 2, "b", "ab cde"), ("S2-1", 2, "b", "cde ab"), ("S1-x", 1, None, "abc"), ("S3-n", 3, "b", None), ("S1-0", 1, "b", "de ab"), ("S2-z", 2, "only", "abcd"), ("S1-y", 1, "b", "abc\x00\x00")]
    return spark.createDataFrame(rows, "entity_id string, source int, country string, name string").repartition(3)


@pytest.mark.parametrize("cells", [5, 1 << 19])
def test_counted_grams_equal_gram_rows(spark, cells, monkeypatch):
    """Grams counted in numpy give the candidates of grams as rows, for repeated ids, empty and null texts and any code point."""
    from matchloom.functions import grams

    monkeypatch.setattr(grams, "CELLS", cells)
    texts, owners = ["abab", None, "a\x00\x00\x00", "", "é😀a😀é"], np.array([0, 0, 1, 2, 2])
    words, owner, gram, n = grams.count(texts, owners)
    got = {(int(o), words[g]): int(c) for o, g, c in zip(owner, gram, n)}
    assert got == collections.Counter((int(o), t[i : i + m]) for t, o in zip(texts, owners) if t for m in (3, 4) for i in range(len(t) - m + 1))
    records = _char_records(spark)
    want = C.tfidf_route(records, C.char_grams(F.col("name")), max_df=0.4, k=7)
    route = C.char_tfidf_route(records, "name", max_df=0.4, k=7)
    plan = route._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: {(r.s1_id, r.t_id, r.source, round(r.score, 6), r["rank"]) for r in df.collect()}
    assert rows(route) == rows(want) and "regexp_extract_all" not in plan
    monkeypatch.setattr(C, "_VOCABULARY", 1)
    assert rows(C.char_tfidf_route(records, "name", max_df=0.4, k=7)) == rows(want)


@pytest.mark.parametrize(("size", "frequent", "cells"), [(4, 0.3, 16), (2048, 0.0, 1 << 21), (5, 2.0, 1)])
def test_whole_comparison_drops_no_gram(spark, size, frequent, cells, monkeypatch):
    """Records that share only grams of every record are compared too, whatever the blocks and the grams that are columns."""
    monkeypatch.setattr(C, "_ROWS", size)
    monkeypatch.setattr(C, "_FREQUENT", frequent)
    monkeypatch.setattr(C, "_CELLS", cells)
    rows = lambda df: {(r.s1_id, r.t_id, r.source, round(r.score, 6), r["rank"]) for r in df.collect()}
    records = _char_records(spark)
    assert rows(C.char_tfidf_whole(records, "name", 6)) == rows(C.tfidf_route(records, C.char_grams(F.col("name")), max_df=1.0, k=6))
    same = spark.createDataFrame([(f"S{1 + i % 3}-{i}", 1 + i % 3, "a", "abc" + "xyz"[i % 3]) for i in range(12)], "entity_id string, source int, country string, name string")
    assert C.char_tfidf_whole(same, "name").count() == 4 * 8 and C.name_char_tfidf(same).count() == 0


@pytest.mark.parametrize("listed", [1, 1 << 17])
def test_fusion_in_numpy_equals_fusion_of_rows(spark, listed, monkeypatch):
    """Lists fused in numpy are those of windows over rows, whatever the batches; candidates are exchanged once and ordered by list only."""
    monkeypatch.setattr(C, "_LISTED", listed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(8)
        rows = [(f"S1-{i % 9}", f"S{s}-{rng.randint(0, 30)}", s, rng.choice([0.5, 0.25, rng.random(), None]), k) for i in range(300) for s in (2, 3) for k in (3, None)]
        df = spark.createDataFrame(rows, "s1_id string, t_id string, source int, score double, k int").dropDuplicates(["s1_id", "t_id", "k"]).localCheckpoint()
        one, two = (df.where(c).select("s1_id", "t_id", "source", "score", F.col("k").cast("int").alias("k")) for c in ("k = 3", "k is null"))
        routes = {"x": lambda _: one, "y": lambda _: two}
        ordered = lambda d: sorted(map(tuple, d.collect()), key=repr)
        every = C.all_routes(None, routes)
        fused = C.fused_routes(None, routes)
        assert ordered(fused) == ordered(L.fuse(every)) and fused.columns == L.fuse(every).columns
        wide, want = C.fused_routes(None, routes, evidence=True), L.route_evidence(every, ["x", "y"])
        assert wide.columns == want.columns and ordered(wide) == ordered(want)
        assert ordered(C.fused_routes(None, routes, keep=4)) == ordered(L.fuse(every).where("rrf_rank < 4"))
        plan = fused._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression [s1_id") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
