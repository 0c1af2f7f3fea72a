"""What must not grow with the rows: shuffles of occurrences, passes over the input, what is sent to the driver."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.operators import drift
from sievework.operators.terms import Terms

TEXTS = [(1, "aa bb aa cc"), (2, "bb aa"), (2, "cc aa bb"), (None, "aa"), (3, ""), (4, "bb dd é😀x bb"), (5, "é😀x aa bb")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_terms(words, grams=None, chars=None):
    if chars:
        out = []
        for w in (f" {x} " for x in words):
            for n in range(chars[0], chars[1] + 1):
                out += [w[i : i + n] for i in range(len(w) - n + 1)] or ([w] if n == chars[0] else [])
        return out
    return [" ".join(words[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("how", [{"grams": (1, 2)}, {"chars": (3, 5)}, {"chars": (5, 6)}])
@pytest.mark.parametrize("bound", [500_000, 1])
def test_tfidf_blocks_shuffle_no_occurrences(spark, monkeypatch, how, bound):
    monkeypatch.setattr(drift, "VOCABULARY", bound)
    docs = spark.createDataFrame(TEXTS, "id int, text string").select("id", F.array_remove(F.split("text", " "), "").alias("t"))
    terms = Terms(F.col("t"), how.get("grams", (1, 1)), how.get("chars"))
    rows = drift.tfidf_blocks(docs, "id", {"x": terms}, docs, 2, 6)
    if bound > 1:
        plain = docs.where("id > 2")  # keys once each
        assert "Exchange" not in plan(drift.tfidf_blocks(plain, "id", {"x": terms}, plain, 1, 6))
    tf = defaultdict(Counter)
    for k, text in TEXTS:
        tf[k].update(brute_terms(text.split(), **how))
    df, n = Counter(x for c in tf.values() for x in c), sum(tf.values(), Counter())
    kept = sorted((x for x in df if df[x] >= 2), key=lambda x: (-n[x], x))[:6]
    want = {}
    for k, c in tf.items():
        w = {x: (1 + math.log(c[x])) * (math.log((1 + len(TEXTS)) / (1 + df[x])) + 1) for x in kept if c[x]}
        want |= {(k, x): v / math.sqrt(sum(y * y for y in w.values())) for x, v in w.items()}
    assert {(r.id, r.tok): r.w for r in rows.collect()} == pytest.approx(want)


def test_routing_joins_are_made_once(spark, monkeypatch):
    from sievework import gates
    from sievework.operators import routing

    a = spark.createDataFrame([(i, "x" if i % 3 else "y", "x", i / 20) for i in range(20)], "id int, y_true string, y_pred string, p_max double")
    c, receipts = a.select("id", "y_true", "y_pred"), a.select("id", F.lit(0.5).alias("computed_cost_usd"), (F.col("id") == 3).alias("parse_failed"))
    rows = routing.with_c(routing.with_b(a, a, "id"), c, receipts, "id")
    assert "Join" not in plan(rows) and "Exchange" not in plan(rows)  # stored by the gates
    policies = routing.all_policies(rows, "id", {"a_to_human": 0.6, "a_to_b": 0.7, "a_to_c": 0.5, "a_to_b_to_c": 0.65, "b": 0.4}, 0.001, 0.02)
    assert "Join" not in plan(routing.evaluation(policies, ["x", "y"], 2.0, 1.5))
    both = routing.paired(policies, "a", "a_to_c", 2.0, 1.5)
    assert both.count() == 20 and "Exchange" not in plan(both)
    with pytest.raises(gates.GateError, match="missing id: 7"):
        routing.with_b(a, a.where("id <> 7"), "id")
    with pytest.raises(gates.GateError, match="different y_true: 7"):
        routing.with_b(a, a.withColumn("y_true", F.when(F.col("id") != 7, F.col("y_true"))), "id")
    with pytest.raises(gates.GateError, match="repeated id: 7"):
        routing.with_b(a, a.unionByName(a.where("id = 7")), "id")


def test_weights_of_draws_on_limits():
    import numpy as np

    from sievework.operators import resampling as r

    # Upper bits that hold a limit are told apart by the lower ones, the others all weigh the same.
    tops = np.arange(1 << 16, dtype=np.int64) << 16
    low, high = ((tops[:, None] + more >= np.array(r._EDGES, np.int64)).sum(axis=1) for more in (0, 65535))
    assert (r._BY_TOP == np.where(low == high, low, r._SPLIT)).all()
    keys = np.arange(-3000, 3000)
    mixed = lambda x: (lambda y: y ^ (y >> np.uint64(29)))((x ^ (x >> np.uint64(32))) * np.uint64(r.MIX))
    own = mixed(keys.view(np.uint64) + np.uint64(r.seed_number("s")))
    draws = mixed(mixed(own[:, None] + np.arange(50, dtype=np.uint64) * np.uint64(r.STEP))) >> np.uint64(32)
    assert (r.weights(keys, 50, "s") == sum((draws >= x).astype(float) for x in r._EDGES)).all()


def test_oov_joins_nothing(spark):
    docs = spark.createDataFrame([(0, "p", "aa bb aa"), (1, "p", "bb aa cc"), (2, "q", "cc dd"), (3, None, "ee bb aa cc")], "id int, g string, text string")
    got = drift.oov(docs, Terms(F.split("text", " "), (2, 2)), F.col("id") % 2 == 0, "g")
    assert "Join" not in plan(got) and "Expand" not in plan(got)
    assert {r.g: (r.n_tokens, r.n_oov, r.n_types, r.n_oov_types) for r in got.collect()} == {"p": (4, 1, 3, 1), "q": (1, 0, 1, 0), None: (3, 2, 3, 2)}


def test_components_broadcast_nothing(spark, monkeypatch):
    from sievework.operators import dedup

    plans, stored = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, label: (plans.append(plan(df)), stored(df, label))[1])
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 6)] + [(9, 8)], "u long, v long")
    assert {r.node: r.label for r in dedup.connected(links).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 8: 8, 9: 8}
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y")], "id long, t string").withColumn("day", F.lit(0))
    got = dedup.clusters(docs, "id", "t", "day")
    assert {(r.id, r.cluster_id, r.kept) for r in got.collect()} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in [*plans, plan(got)])


def test_split_leaks_shuffles_no_whole_sets(spark, monkeypatch):
    from sievework.operators import dedup

    plans, stored = {}, dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, label: (plans.update({label: plan(df)}), stored(df, label))[1])
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i % 4] + ([f"z{i}"] if i % 3 else []))) for i in range(24)] + [(90, ""), (91, "")]
    docs = spark.createDataFrame(rows, "id int, t string")
    got = {(r.first_id, r.second_id): r.shared for r in dedup.split_leaks(docs, "id", "t", F.col("id") % 2 == 0).collect()}
    sets = {}
    for i, t in rows:
        w = t.split()
        if w:
            sets.setdefault((i % 2 == 0, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))), i)
    want = {(i, j): len(x & y) for (a, x), i in sets.items() for (b, y), j in sets.items() if a and not b and 100 * len(x & y) >= 90 * len(x | y)}
    assert got == want and want
    assert "Exchange" not in plans["prefixes"]
