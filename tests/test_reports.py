"""Prompts, receipts, reports and runs on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievework import gates
from sievework.operators import models, report, routing
from sievework.sources import frames, ingest, prompts

LABELS = ["x", "y"]


def test_prompt_bundle(spark, tmp_path):
    (tmp_path / "system.txt").write_text("sort texts")
    (tmp_path / "user.txt").write_text("{text}")
    (tmp_path / "exemplars.jsonl").write_text('{"text": "t", "label": "x"}\n')
    b = prompts.load_bundle(tmp_path, LABELS)
    assert b.exemplars == (("t", "x"),) and prompts.load_bundle(tmp_path, LABELS, b.sha256) == b
    rows = spark.createDataFrame(list(b.files.items()), "name string, sha256 string")
    assert prompts.bundle_hash(rows).first().sha256 == b.sha256
    assert b.sha256 == hashlib.sha256("".join(f"{n}:{h}\n" for n, h in sorted(b.files.items())).encode()).hexdigest()
    with pytest.raises(gates.GateError, match="frozen"):
        prompts.load_bundle(tmp_path, LABELS, "0" * 64)
    with pytest.raises(gates.GateError, match="unknown"):
        prompts.load_bundle(tmp_path, ["y"])
    assert prompts.response_schema(LABELS)["properties"]["label"]["enum"] == LABELS
    with pytest.raises(ValueError):
        prompts.response_schema(["x", "x"])


def test_completions_and_receipts(spark):
    def said(content, **more):
        return json.dumps({"model": "m", "choices": [{"finish_reason": "stop", "message": {"content": content}}], "usage": {"prompt_tokens": 10, "completion_tokens": 2, "total_tokens": 12}, **more})

    rows = [(1, said('{"label": "x"}', provider="p"), 100.0, 0), (2, said("no json"), 300.0, 2), (3, said('{"label": "z"}'), 200.0, 0), (4, "broken", None, 0), (5, None, None, None)]
    d = spark.createDataFrame(rows, "id long, raw string, latency_ms double, retries long")
    r = prompts.receipts(d, "id", "raw", "slug", 0.1, 0.5, LABELS)
    got = {x.complaint_id: x for x in r.collect()}
    assert got[1].computed_cost_usd == pytest.approx(2.0) and not got[1].parse_failed and got[1].provider == "p" and got[1].finish_reason == "stop"
    assert got[2].parse_failed and got[3].parse_failed and got[4].prompt_tokens is None and got[5].content is None
    t = prompts.rollup(r).first()
    assert (t.n, t.prompt_tokens, t.retries, t.parse_failed, t.p50_ms) == (5, 30, 2, 4, 200.0) and prompts.rollup(r.limit(0)).first().n == 0
    labels = {x.complaint_id: x.label for x in prompts.labels_of(r.select("complaint_id"), r, "complaint_id", LABELS, "y").collect()}
    assert labels == {1: "x", 2: "y", 3: "y", 4: "y", 5: "y"}
    with pytest.raises(gates.GateError, match="missing"):
        prompts.labels_of(r.select("complaint_id"), r.where("complaint_id > 1"), "complaint_id", LABELS, "y")
    with pytest.raises(ValueError):
        prompts.labels_of(r, r, "complaint_id", LABELS, "z")


def test_receipt_labels_from_a_file(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text(json.dumps({"complaint_id": 1, "content": '{"label": "x"}'}) + "\n" + json.dumps({"complaint_id": 2, "content": "?"}) + "\n")
    got = prompts.read_receipt_labels(spark, str(f), "complaint_id", LABELS, "y").collect()
    assert {r.complaint_id: r.label for r in got} == {1: "x", 2: "y"}


def test_arms_and_series(spark):
    rows = [(i, "xy"[i % 2], "x", 0.9 if i < 6 else 0.1) for i in range(10)]
    a = spark.createDataFrame(rows, "id long, y_true string, y_pred string, p_max double")
    p = routing.policy("a_to_human", a, "id", 0.5, routing.human_arm())
    s = report.arm_stats(p, LABELS).first()
    assert (s.machine_share, s.human_share, s.misroute_rate, s.answered_accuracy, s.system_accuracy) == (0.6, 0.4, 0.3, 0.5, 0.7)
    assert {(r.slice, r.policy) for r in report.series({"2020": p, "2021": p.where("id > 2")}, LABELS).collect()} == {("2020", "a_to_human"), ("2021", "a_to_human")}
    reps = report.arm_replicates(p, "a_to_human", 200, "s").where("human_share is not null")
    m = reps.agg(F.avg("human_share").alias("h"), F.max(F.abs(F.col("human_share") + F.col("misroute_rate") - 1)).alias("d")).first()
    assert m.h == pytest.approx(0.4, abs=0.05) and m.d <= 1
    assert report.support_kind(5, 5) == "full_slice" and report.support_kind(4, 5) != "full_slice"
    c = report.arms_compared(a, a.withColumn("y_pred", F.lit("y")), "id")
    assert (c["n"], c["accuracy_a"], c["accuracy_b"], c["agreement"], c["b"], c["c"], c["p"]) == (10, 0.5, 0.5, 0.0, 5, 5, 1.0)
    assert report.id_hash(a, "id") == report.id_hash(a.orderBy(F.desc("id")), "id") != report.id_hash(a.where("id > 0"), "id")
    spread = report.seed_spread(spark.createDataFrame([("f1", 0.5), ("f1", 0.7)], "metric string, value double"), "metric", "value").first()
    assert spread.sd == pytest.approx(0.1414213562) and spread.range == pytest.approx(0.2)


def test_perturbation_grid(spark):
    rows = [(i, "xy"[i % 2], "xy"[i % 2], [0.8, 0.2] if i % 2 == 0 else [0.2, 0.8]) for i in range(8)]
    d = spark.createDataFrame(rows, "id long, y_true string, y_pred string, probs array<double>")
    worse = d.withColumn("probs", F.when(F.col("id") == 0, F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.col("probs"))).withColumn("y_pred", F.when(F.col("id") == 0, "y").otherwise(F.col("y_pred")))
    got = {r.metric: r.delta for r in report.pair_row(d, worse, "id", LABELS, 8).collect()}
    assert got["accuracy"] == pytest.approx(-0.125)
    assert {r.metric for r in report.pair_row(d, worse.where("id < 4"), "id", LABELS, 4, subset=True).collect()} >= {"accuracy", "ece"}
    with pytest.raises(gates.GateError):
        report.pair_row(d, worse.where("id < 4"), "id", LABELS)
    with pytest.raises(gates.GateError, match="expected 9"):
        report.pair_row(d, worse, "id", LABELS, 9)
    rows = report.grid({"a": False, "b": True}, {"typo": (0.1, 0.2)}, {("a", "typo", 0.1)})
    assert [r["state"] for r in rows] == ["done", "missing", "skipped", "skipped"]
    with pytest.raises(gates.GateError):
        report.grid({"a": False}, {"typo": (0.1,)}, {("c", "typo", 0.1)})


def test_run_of_a_configuration(spark, tmp_path):
    rows = [(i, f"{'good fine' if i % 2 else 'bad awful'} word{i % 5}", "pos" if i % 2 else "neg") for i in range(60)]
    d = spark.createDataFrame(rows, "id long, text string, y_true string")
    stats = frames.write_split(d, str(tmp_path / "s"), "test", "id", "y_true")
    f = tmp_path / "linear.yaml"
    f.write_text("model: {runner: tfidf_linear, min_df: 1}\ndata: {split: test}\n")
    r = report.run(spark, f, lambda name: (d, d, stats), tmp_path / "results.jsonl", tmp_path)
    assert r["metrics"]["accuracy"] == 1.0 and r["dataset"]["split"] == "test"
    assert ingest.load_records(tmp_path / "results.jsonl") == [json.loads(json.dumps(r))]
    df, labels, said = ingest.read_predictions(spark, r["predictions"])
    assert df.count() == 60 and labels == ["neg", "pos"] and said["run_id"] == r["run_id"]
    newest, older = report.latest([{**r, "timestamp_utc": "1"}, r], str(f))
    assert newest == r and len(older) == 1 and list(report.by_config([r])) == [str(f)]
    with pytest.raises(gates.GateError):
        report.by_config([r, r])
    with pytest.raises(KeyError):
        report.latest([], "x")
    models.RUNNERS["loses_rows"] = lambda train, test: models.run("tfidf_linear", train, test.where("id > 3"), min_df=1)
    f.write_text("model: {runner: loses_rows}\ndata: {split: test}\n")
    with pytest.raises(gates.GateError, match="missing id"):
        report.run(spark, f, lambda name: (d, d, stats))
    del models.RUNNERS["loses_rows"]
    assert report.compared_state({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "9", "d": "4"}) == [{"path": "a", "state": "same"}, {"path": "b", "state": "changed"}, {"path": "c", "state": "deleted"}, {"path": "d", "state": "new"}]
