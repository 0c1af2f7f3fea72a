"""Runners, calibration, claims and joint thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import claims, models


@pytest.mark.parametrize("family", ["logreg", "complement_nb"])
def test_linear_runner(spark, family):
    rows = [(i, f"{'good fine' if i % 2 else 'bad awful'} word{i % 5}", "pos" if i % 2 else "neg") for i in range(60)]
    d = spark.createDataFrame(rows, "id long, text string, y_true string")
    got = models.run("tfidf_linear", d, d, family=family, min_df=1)
    assert got.where("y_true = y_pred").count() == 60
    assert got.where(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6).isEmpty()
    flat = models.isotonic(got, got, ["neg", "pos"]).select(F.array_max("probs").alias("p")).distinct().collect()
    assert [r.p for r in flat] == [1.0]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4000])
def test_interpolation_by_numpy(spark, n):
    rng = np.random.default_rng(n)
    xs = np.sort(np.concatenate((rng.random(n), rng.random(n)[: n // 3].round(2), rng.random(n)[: n // 3].round(2))))
    ys = np.sort(rng.random(len(xs)))
    points = [(float(v),) for v in (-1.0, 0.0, xs[0], xs[-1], 2.0, *rng.random(40))]
    got = spark.createDataFrame(points, "x double").select("x", models._interp(F.col("x"), xs.tolist(), ys.tolist()).alias("y")).collect()
    for r in got:
        assert r.y == pytest.approx(float(np.interp(r.x, xs, ys)), abs=1e-12)


def test_registry():
    with pytest.raises(ValueError):
        models.register_runner("tfidf_linear")(lambda: None)
    with pytest.raises(KeyError):
        models.run("none")


def test_joint_thresholds_match_brute_force(spark):
    rows = [(i, round((i * 7 % 10) / 10, 1), round((i * 3 % 8) / 8, 3), int(i % 3 > 0), int(i % 4 > 0), 0.1) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, p_max double, p_b double, correct int, correct_b int, cost_b double")
    taus = (0.1, 0.5, 0.9)
    best = min(
        (round(sum((2 * (1 - c)) if p >= a else cb + (2 * (1 - k) if pb >= b else 1.5) for _, p, pb, c, k, cb in rows) * 25, 6), -sum(p >= a for _, p, *_ in rows), b)
        for a in {r[1] for r in rows} for b in taus
    )
    got = claims.joint_thresholds(d, taus, 2.0, 1.5).first()
    assert (got.cost_per_1k, -got.k, got.tau_b) == pytest.approx(best)


def test_joint_thresholds_try_every_gate(spark):
    """Without given gates all are tried: best at the lowest p_b here, with A never answering where it is always wrong."""
    for a_right, b_right, human in ((0, 1, 1.5), (1, 1, 1.5), (0, 0, 0.5)):
        rows = [(i, (i * 7 % 10) / 10, (i * 3 % 8) / 11, int(a_right and i % 3 > 0), int(b_right and i % 4 > 0), 0.1) for i in range(40)]
        d = spark.createDataFrame(rows, "id long, p_max double, p_b double, correct int, correct_b int, cost_b double")
        cost = lambda a, b: sum((2 * (1 - c)) if p >= a else cb + (2 * (1 - k) if pb >= b else human) for _, p, pb, c, k, cb in rows)  # noqa: B023, E731
        gates = lambda n: {r[n] for r in rows} | {float("inf")}  # noqa: B023, E731
        best = min((round(cost(a, b) * 25, 6), -sum(r[1] >= a for r in rows), b) for a in gates(1) for b in gates(2))
        got = claims.joint_thresholds(d, None, 2.0, human).first()
        assert (got.cost_per_1k, -got.k, got.tau_b) == pytest.approx(best)


def test_self_comparison_is_not_established(spark):
    d = spark.createDataFrame([(i, 0) for i in range(20)], "id long, d int")
    c = claims.paired_claim(d, "id", {"accuracy": F.col("d")}, 10, "s")
    assert c.first().verdict == "not_established" and not claims.certified(c).first().certified
