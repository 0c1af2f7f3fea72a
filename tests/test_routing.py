"""Costs, routing policies, claims, verification, split frames and prior shift on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import gates
from sievework.functions import stats
from sievework.operators import claims, costs, drift, metrics, pricing, ranking, resampling, routing, verify
from sievework.sources import frames

LABELS = ["x", "y"]
COSTS = """version: 1
evidence_class: test
params: {c_misroute_usd: 2.0, c_human_usd: 1.5}
api_cost:
  b: {mode: amortized, per_example_usd: 0.25}
  b_large: {mode: amortized, per_example_usd: 0.5}
  c: {mode: receipts}
"""


def tiers(spark):
    a = spark.createDataFrame([(1, "x", "x", 0.9), (2, "y", "x", 0.8), (3, "x", "y", 0.4), (4, "y", "x", 0.3), (5, "x", "y", 0.2)], "id long, y_true string, y_pred string, p_max double")
    b = spark.createDataFrame([(1, "x", "x", 0.5), (2, "y", "y", 0.5), (3, "x", "x", 0.9), (4, "y", "x", 0.1), (5, "x", "x", 0.1)], a.schema)
    c = spark.createDataFrame([(1, "x", "x"), (2, "y", "y"), (3, "x", "x"), (4, "y", "y"), (5, "x", "x")], "id long, y_true string, y_pred string")
    r = spark.createDataFrame([(i, 0.1 * i, i == 5) for i in range(1, 6)], "id long, computed_cost_usd double, parse_failed boolean")
    return a, b, c, r


def stacked(spark):
    a, b, c, r = tiers(spark)
    rows = routing.with_c(routing.with_b(a, b, "id"), c, r, "id")
    return routing.all_policies(rows, "id", {"a_to_human": 0.5, "a_to_b": 0.5, "a_to_c": 0.5, "a_to_b_to_c": 0.5, "b": 0.5}, 0.0, 0.25)


def test_policies_by_hand(spark):
    got = {}
    for r in stacked(spark).collect():
        got.setdefault(r.policy, {})[r.id] = (r.correct, round(r.api, 2), r.to_human)
    assert got["a"] == {1: (1, 0, False), 2: (0, 0, False), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, False)}
    assert got["all_human"] == {i: (0, 0, True) for i in range(1, 6)}
    assert got["a_to_human"] == {1: (1, 0, False), 2: (0, 0, False)} | {i: (0, 0, True) for i in (3, 4, 5)}
    assert got["a_to_b"] == {1: (1, 0, False), 2: (0, 0, False), 3: (1, 0.25, False), 4: (0, 0.25, False), 5: (1, 0.25, False)}
    assert got["a_to_c"] == {1: (1, 0, False), 2: (0, 0, False), 3: (1, 0.3, False), 4: (1, 0.4, False), 5: (0, 0.5, True)}
    # B is paid for always, C where B is unsure; what C can't parse goes to a human and is paid for.
    assert got["a_to_b_to_c"] == {1: (1, 0, False), 2: (0, 0, False), 3: (1, 0.25, False), 4: (1, 0.65, False), 5: (0, 0.75, True)}
    e = {r.policy: r for r in routing.evaluation(stacked(spark), LABELS, 2.0, 1.5).collect()}
    assert e["all_human"].answered_accuracy is None and e["all_human"].answered_macro_f1 is None and e["all_human"].system_accuracy == 1.0
    assert e["a_to_b_to_c"].system_accuracy == pytest.approx(0.8) and e["a_to_b_to_c"].human_share == pytest.approx(0.2)
    assert e["a"].system_macro_f1 == pytest.approx((2 * 1 / (3 + 3) + 0) / 2)


def test_joins_refuse(spark):
    a, b, c, r = tiers(spark)
    with pytest.raises(gates.GateError, match="missing id: 5"):
        routing.with_b(a, b.where("id < 5"), "id")
    with pytest.raises(gates.GateError, match="repeated id: 2"):
        routing.with_b(a, b.union(b.where("id = 2")), "id")
    with pytest.raises(gates.GateError, match="different y_true: 1"):
        routing.with_b(a, b.withColumn("y_true", F.when(F.col("id") == 1, "y").otherwise(F.col("y_true"))), "id")
    for broken, why in ((r.where("id > 1"), "missing"), (r.union(r), "repeated"), (r.withColumn("parse_failed", F.lit(None).cast("boolean")), "parse_failed"), (r.withColumn("computed_cost_usd", F.lit(float("nan"))), "impossible"), (r.withColumn("computed_cost_usd", F.lit(-1.0)), "impossible")):
        with pytest.raises(gates.GateError, match=why):
            routing.with_c(a, c, broken, "id")
    priced = pricing.with_receipts(a, r, "id")
    assert pricing.check_cost_sum(priced, 1.5)["joined"] == pytest.approx(1.5)
    with pytest.raises(gates.GateError, match="the record says"):
        pricing.check_cost_sum(priced, 1.4)


def test_cost_configuration(tmp_path):
    f = tmp_path / "cost.yaml"
    f.write_text(COSTS)
    c = pricing.load(f)
    assert (c.c_misroute, c.c_human, c.per_example("b")) == (2.0, 1.5, 0.25) and len(c.sha256) == 64
    assert c.tier_of("b_large_seed1") == "b_large" and c.tier_of("b2") == "b" and c.prices("b", "c") and not c.prices("d")
    assert c.identity()["version"] == "1"
    with pytest.raises(KeyError):
        c.tier_of("none")
    with pytest.raises(KeyError):
        c.per_example("d")
    with pytest.raises(ValueError):
        c.per_example("c")
    for old, new in (("0.25", "-1"), ("0.25", ".nan"), ("0.25", "free"), ("2.0", "true"), (", per_example_usd: 0.25", ""), ("c_human_usd: 1.5", "other: 1"), ("receipts", "guess"), ("version: 1", "name: 1")):
        f.write_text(COSTS.replace(old, new, 1))
        with pytest.raises(ValueError):
            pricing.load(f)


def test_claims(spark):
    p = stacked(spark)
    both = routing.paired(p, "a", "a_to_b", 2.0, 1.5)
    got = {r.metric: r for r in routing.cost_claim(both.where("id = 3").drop("id").crossJoin(spark.range(60)), 200, "s").collect()}
    # One kind of row: every replicate that draws it has the same ratio; the cost falls from 2 to 0.25.
    assert got["reduction"].lo == got["reduction"].hi == pytest.approx(0.875) and got["reduction"].verdict == "favorable"
    assert got["delta_per_1k"].hi == pytest.approx(-1750) and got["delta_per_1k"].verdict == "favorable"
    with pytest.raises(gates.GateError, match="baseline"):
        routing.cost_claim(both.where("id = 1"), 10, "s")
    with pytest.raises(gates.GateError, match="not once in both"):
        routing.paired(p.where("not (policy = 'a' and id = 2)"), "a", "a_to_b", 2.0, 1.5)
    p = p.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("id", F.col("id") * 100 + F.col("copy")).drop("copy")
    c = routing.comparison(p, "a", "a_to_b", 2.0, 1.5, 300, "s")
    assert c["mcnemar"] == {"n": 100, "b": 0, "c": 40, "p": 2 / 2**40} and set(c["claims"]) == {"delta_per_1k", "reduction", "accuracy"}
    assert routing.gate({"m": {"verdict": "favorable"}}) == {"certified": True, "any_adverse": False}
    assert routing.gate({"m": {"verdict": "favorable"}, "n": {"verdict": "adverse"}}) == {"certified": False, "any_adverse": True}
    assert not routing.gate({})["certified"]
    f = routing.frontier(p, "a", ["a_to_b", "a_to_c"], 2.0, 1.5, 100, "s")
    assert [x["router"] for x in f] == ["a_to_b", "a_to_c"] and all("certified" in x for x in f)


def test_paths_replay_and_thresholds(spark):
    a, b, _, _ = tiers(spark)
    rows = routing.with_b(a, b, "id")
    answers = stacked(spark).where("policy = 'a_to_b'")
    got = {r.id: r.path for r in routing.replayed_paths(rows, "id", 0.5, answers).collect()}
    assert got[1] == ["A", "answered"] and got[5] == ["A", "escalated", "B", "answered"]
    with pytest.raises(gates.GateError, match="different label"):
        routing.replayed_paths(rows, "id", 0.85, answers)
    t = spark.createDataFrame([("f", "d", 0.5, "new"), ("g", "d", 0.6, "new"), ("f", "d", 0.1, "old")], "family string, dataset string, tau double, cost_sha256 string")
    assert routing.transferred(t, [("f", "d"), ("g", "d")], "new") == {("f", "d"): 0.5, ("g", "d"): 0.6}
    for expected, frame in (([("f", "d")], t), ([("f", "d"), ("g", "d"), ("h", "d")], t), ([("f", "d"), ("g", "d")], t.union(t.limit(1)))):
        with pytest.raises(gates.GateError):
            routing.transferred(frame, expected, "new")


def test_joint_grid_has_both_infinities(spark):
    rows = [(0.9, 0.9, 0, 0, 5.0), (0.5, 0.2, 0, 0, 5.0)]  # A is wrong, B is wrong and dear: humans are cheapest
    d = spark.createDataFrame(rows, "p_max double, p_b double, correct int, correct_b int, cost_b double")
    g = claims.joint_grid(d, None, [(10.0, 1.0)])
    assert g.where("tau_a = double('infinity')").count() == 3 and g.where("tau_b = double('infinity')").count() == 3
    best = claims.joint_thresholds(d.withColumn("cost_b", F.lit(0.0)), None, 10.0, 1.0).first()
    assert (best.tau_a, best.tau_b, best.k) == (math.inf, math.inf, 0) and best.cost_per_1k == 1000.0
    s = {(r.c_misroute, r.c_human): r.cost_per_1k for r in claims.joint_sensitivity(d, (1.0, 10.0), (1.0, 20.0)).collect()}
    assert s[1.0, 1.0] == 1000.0 and s[10.0, 20.0] == 10_000.0


# ---- resampling ----------------------------------------------------------------------------------------------------

def test_replicates_by_brute_force(spark):
    rows = [(i, i % 7 / 3, i % 2) for i in range(500)] + [(None, 1.0, 1), (-5, None, 0)]
    d = spark.createDataFrame(rows, "k long, v double, b int").repartition(7)
    got = {r.rep: r for r in resampling.replicate_sums(d, "k", {"v": F.col("v"), "b": F.col("b")}, 40, "seed").collect()}
    mask, mix, step = 2**64 - 1, resampling.MIX, resampling.STEP

    def mixed(x):
        x = (x ^ (x >> 32)) * mix & mask
        return x ^ (x >> 29)

    for rep in (0, 1, 39):
        w = [sum(mixed(mixed((mixed(((k or 0) + resampling.seed_number("seed")) & mask) + rep * step) & mask)) >> 32 >= t for t in resampling.LIMITS) for k, _, _ in rows]
        assert got[rep].w == sum(w)
        assert got[rep].v == pytest.approx(sum(x * (v or 0) for x, (_, v, _) in zip(w, rows, strict=True)))
    draws = resampling.weights(np.arange(20_000), 50, "s")
    assert draws.mean() == pytest.approx(1, abs=0.01) and draws.var() == pytest.approx(1, abs=0.02) and abs(np.corrcoef(draws[:, 0], draws[:, 1])[0, 1]) < 0.03
    assert resampling.replicate_sums(d.limit(0), "k", {"v": F.col("v")}, 3, "s").agg(F.sum("w")).first()[0] in (None, 0.0)


def test_bands_cover_the_truth(spark):
    rng = np.random.default_rng(2)
    right = rng.random(3000) < 0.7
    rows = [(i, "x" if i % 3 else "y", ("x" if i % 3 else "y") if r else ("y" if i % 3 else "x")) for i, r in enumerate(right.tolist())]
    d = spark.createDataFrame(rows, "id long, y_true string, y_pred string")
    got = {r.metric: r for r in resampling.bands(resampling.replicate_f1(d, "id", LABELS, 400, "s"), "accuracy", "macro_f1").collect()}
    assert got["accuracy"].lo < right.mean() < got["accuracy"].hi and got["accuracy"].hi - got["accuracy"].lo == pytest.approx(2 * 1.96 * math.sqrt(0.21 / 3000), rel=0.25)
    f1 = metrics.scalars(d, LABELS).first().macro_f1
    assert got["macro_f1"].lo < f1 < got["macro_f1"].hi


# ---- running sums ---------------------------------------------------------------------------------------------------

def test_running_sums_of_distinct_and_equal_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(p), int(rng.random() < p)) for i, p in enumerate(rng.random(3000))] + [(5000 + i, 1.0, i % 2) for i in range(2000)]
    d = spark.createDataFrame(rows, "id long, p_max double, correct int").repartition(6)
    want, errors = {}, 0
    for rank, (i, _, c) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        errors += 1 - c
        want[i] = (rank, errors)
    assert {r.id: (r.rank, r.errors) for r in metrics.risk_coverage(d, "id").collect()} == want
    t = {r.p_max: (r.n, r.ok) for r in ranking.prefix_sums(d, "p_max", {"n": F.lit(1), "ok": F.col("correct")}).collect()}
    assert t[1.0] == (2000, 1000) and max(n for n, _ in t.values()) == 5000 and len(t) == 3001
    assert "SinglePartition" not in costs.threshold_table(d)._jdf.queryExecution().optimizedPlan().toString()


# ---- verification ---------------------------------------------------------------------------------------------------

def predictions(spark):
    rows = [(1, "x", "x", [0.9, 0.1]), (2, "y", "x", [0.6, 0.4]), (3, "y", "y", [0.2, 0.8]), (4, "x", "x", [0.5, 0.5])]
    return spark.createDataFrame(rows, "id long, y_true string, y_pred string, probs array<double>").withColumn("p_max", F.array_max("probs"))


def test_artifact_verification(spark):
    p = predictions(spark)
    split = p.select("id", F.col("y_true").alias("label"))
    logged = {r.metric: r.value for r in verify.point_metrics(p, LABELS, "id", (0.5, 1.0)).collect()}
    assert logged["accuracy"] == 0.75 and logged["acc_at_cov::0.5"] == 1.0 and logged["f1::x"] == pytest.approx(0.8)
    rows = verify.artifact(p, LABELS, "id", split, "label", logged)
    verify.require(rows)
    assert len(rows) == 9 + len(logged)
    bad = verify.artifact(p, LABELS, "id", split, "label", {**logged, "accuracy": 0.7, "other": 1.0})
    with pytest.raises(gates.GateError, match="accuracy, other"):
        verify.require(bad)
    broken = {
        "ids are in the split": (p, split.where("id > 1")), "truths are the split's": (p, split.withColumn("label", F.lit("x"))), "ids are unique": (p.union(p.where("id = 1")), split),
        "p_max is the largest": (p.withColumn("p_max", F.lit(0.95)), split), "y_pred has the largest": (p.withColumn("y_pred", F.lit("y")), split),
        "probabilities sum to 1": (p.withColumn("probs", F.array(F.lit(0.9), F.lit(0.3))), split), "labels are declared": (p.withColumn("y_true", F.lit("z")), split),
        "one probability a label": (p.withColumn("probs", F.array(F.lit(1.0))), split), "probabilities from 0 to 1": (p.withColumn("probs", F.array(F.lit(1.5), F.lit(-0.5))), split),
    }
    for check, (frame, s) in broken.items():
        assert check in [r["check"] for r in verify.artifact(frame, LABELS, "id", s, "label", logged) if not r["ok"]]
    with pytest.raises(ValueError):
        verify.point_metrics(p, LABELS, "id", (0.0,))
    verify.provenance({"run_id": "a"}, {"run_id": "a"}, ("run_id",))
    for said in ({"run_id": ""}, {}, {"run_id": "b"}):
        with pytest.raises(gates.GateError):
            verify.provenance(said, {"run_id": "a" if said else ""}, ("run_id",))
    assert sum(b["n"] for b in verify.calibration_exhibit(p, LABELS, logged["ece"])) == 4
    with pytest.raises(gates.GateError):
        verify.calibration_exhibit(p, LABELS, logged["ece"] + 0.01)


# ---- split frames ---------------------------------------------------------------------------------------------------

def test_split_frames(spark, tmp_path):
    d = spark.createDataFrame([(i, None if i == 3 else f"t{i}", "ab"[i % 2]) for i in range(40)], "id long, narrative string, cls string")
    path = str(tmp_path / "train")
    s = frames.write_split(d, path, "train", "id", "cls")
    assert (s["n"], s["low"], s["high"], s["classes"]) == (40, 0, 39, {"a": 20, "b": 20})
    assert frames.verify_split(spark, path, s).count() == 40 and frames.dataset_info([s], "train") is s
    with pytest.raises(gates.GateError, match="has changed"):
        frames.verify_split(spark, path, {**s, "rows_hash": 1})
    with pytest.raises(KeyError):
        frames.dataset_info([s], "test")
    with pytest.raises(gates.GateError):
        frames.write_split(d.union(d), str(tmp_path / "x"), "train", "id", "cls")
    got = frames.load_split(spark, path, "id", "narrative", "cls")
    assert got.where("id = 3").first().text == "" and frames.load_ids(spark, path, "id").count() == 40
    small, large = ({r.id for r in frames.subsample(d, "id", n, "s").collect()} for n in (5, 12))
    assert small < large and len(large) == 12 and frames.subsample(d, "id", None, "s").count() == 40
    with pytest.raises(ValueError):
        frames.subsample(d, "id", 0, "s")
    with pytest.raises(gates.GateError):
        frames.lookup(d, spark.createDataFrame([(99,)], "id long"), "id")
    x, y, lost_x, lost_y = frames.shared(d.where("id < 10"), d.where("id > 5"), "id")
    assert (x.count(), y.count(), lost_x, lost_y) == (4, 4, 6, 30)
    with pytest.raises(gates.GateError):
        frames.shared(d.where("id < 5"), d.where("id > 5"), "id")
    assert frames.export(d, str(tmp_path / "j"), "id", "narrative", "cls") == {"n": 40, "classes": {"a": 20, "b": 20}}
    f = tmp_path / "c.yaml"
    f.write_text("model: {runner: r}\ndata: {split: s}\n")
    assert frames.load_config(f)["model"]["runner"] == "r"
    f.write_text("model: {runner: r}\n")
    with pytest.raises(ValueError):
        frames.load_config(f)


def test_allocation_and_curated_draw(spark):
    assert frames.allocation({"a": 1, "b": 1, "c": 998}, 10) == {"a": 1, "b": 1, "c": 8}
    assert frames.allocation({"a": 7, "b": 3}, 5) == {"a": 4, "b": 1} or frames.allocation({"a": 7, "b": 3}, 5) == {"a": 3, "b": 2}
    assert frames.allocation({"a": 2, "b": 2}, 4) == {"a": 2, "b": 2}
    for n in (1, 5):
        with pytest.raises(ValueError):
            frames.allocation({"a": 2, "b": 2}, n)
    d = spark.createDataFrame([(i, "rare" if i == 7 else "common") for i in range(200)], "id long, cls string")
    got = frames.curated(d, "id", "cls", 10, "s").groupBy("cls").count().collect()
    assert {r.cls: r["count"] for r in got} == {"rare": 1, "common": 9}


def test_datasheet(spark):
    counts = spark.createDataFrame([("a", 2020, 1200), ("a", 2021, 3), ("b", 2021, 5)], "class string, year int, n long")
    stats_ = [{"split": "train", "n": 1208, "low": 1, "high": 9, "rows_hash": -1}]
    text = frames.datasheet("Data", counts, stats_, {"read": 2000, "removed": 792, "kept": 1208})
    assert "| a | 1,200 | 3 | 1,203 |" in text and "| all | 1,200 | 8 | 1,208 |" in text and "39.60 %" in text and "ffffffffffffffff" in text
    with pytest.raises(gates.GateError):
        frames.datasheet("Data", counts, stats_, {"read": 2000, "removed": 1, "kept": 1})


# ---- prior shift ----------------------------------------------------------------------------------------------------

def shifted(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, (p, r) in {"ref": (0.5, 0.9), "new": (0.8, 0.7)}.items():
        for _ in range(400):
            t = "x" if rng.random() < p else "y"
            rows.append((len(rows), s, t, t if rng.random() < r else ("y" if t == "x" else "x")))
    return spark.createDataFrame(rows, "id long, s string, y_true string, y_pred string")


def test_prior_shift_parts_add_up(spark):
    d = shifted(spark)
    r = drift.rates(d, "s")
    c = drift.components_of(drift.macro_f1_cells(r, "s", "ref", LABELS))
    drift.check_additivity(c, "s")
    with pytest.raises(gates.GateError, match="don't add up"):
        drift.check_additivity(c.withColumn("prior_first", F.col("prior_first") + 0.1), "s")
    whole = {x.s: x.total for x in c.collect()}
    per = drift.class_attribution(r, "s", "ref", LABELS).groupBy("s").agg(F.sum("total").alias("t")).collect()
    assert {x.s: x.t for x in per} == pytest.approx(whole) and whole["ref"] == 0
    acc = {x.s: x.a for x in d.groupBy("s").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a")).collect()}
    parts = drift.accuracy_parts(r, "s", "ref", LABELS).groupBy("s").agg(F.sum(F.col("prior") + F.col("within") + F.col("interaction")).alias("t")).collect()
    assert {x.s: x.t for x in parts}["new"] == pytest.approx(acc["ref"] - acc["new"])
    ball = {x.s: x for x in drift.balanced_accuracy_cells(r, "s", "ref", LABELS).collect()}
    assert ball["ref"].own == ball["ref"].reference == ball["new"].reference != ball["new"].own
    one = {(x.s, x.moved): x.macro_f1 for x in drift.one_at_a_time(r, "s", "ref", LABELS).collect()}
    cells = {x.s: x for x in drift.macro_f1_cells(r, "s", "ref", LABELS).collect()}
    assert one["new", "x"] == pytest.approx(cells["new"].b) and one["ref", "y"] == pytest.approx(cells["ref"].a)  # with two classes, one moves both
    reps = drift.replicate_components(d, "id", "s", "ref", "new", LABELS, 200, "z")
    assert reps.where("valid").count() == 200
    band = {x.metric: x for x in resampling.bands(reps, "total", "prior_shapley").collect()}
    assert band["total"].lo < whole["new"] < band["total"].hi < 0


def test_share_gate_and_weights():
    assert drift.share_gate(-0.1, -0.15, -0.05) == (True, None)
    assert not drift.share_gate(-0.1, -0.15, 0.05)[0] and not drift.share_gate(0.015, 0.01, 0.02)[0] and not drift.share_gate(-0.1, -0.15, -0.05, False)[0]
    assert stats.kish_weights([0.5, 0.5], [1.0, 0.0], 100) == {"max": None, "min": 0.5, "n_eff": 0.0}
    w = stats.kish_weights([0.5, 0.5], [0.25, 0.75], 100)
    each = [2.0] * 25 + [2 / 3] * 75
    assert w["n_eff"] == pytest.approx(sum(each) ** 2 / sum(x * x for x in each)) and w["max"] == 2.0
    assert json.dumps(w)
