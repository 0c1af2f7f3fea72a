"""Routing policies: who answers a row, at what price, and how policies compare.

A policy is a frame ``policy, id, y_true, y_pred, correct, api, to_human``, one row per id; ``y_pred`` is null where a
human answers. Tier frames are ``id, y_true, y_pred, p_max`` (the third tier needs no confidence); they are joined
after gates: one row per id on each side, the same ids, the same truths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import gates
from sievework.functions.stats import ci_class, mcnemar_p
from sievework.operators import costs
from sievework.operators.resampling import bands, replicate_sums
from sievework.session import stored

INF = float("inf")


# ---- arms: where a row goes that the first tier does not answer ---------------------------------------------------

def human_arm() -> dict[str, Column]:
    return {"y_pred": F.lit(None).cast("string"), "api": F.lit(0.0), "to_human": F.lit(True)}


def b_arm(price: float, b: str = "_b") -> dict[str, Column]:
    """The second tier answers, at a fixed price a row."""
    return {"y_pred": F.col(f"y_pred{b}"), "api": F.lit(float(price)), "to_human": F.lit(False)}


def c_arm(c: str = "_c") -> dict[str, Column]:
    """The third tier answers at its receipt's cost; what it could not parse goes to a human, and is paid for too."""
    failed = F.col(f"parse_failed{c}")
    return {"y_pred": F.when(~failed, F.col(f"y_pred{c}")), "api": F.col(f"api{c}"), "to_human": failed}


def b_then(rest: dict[str, Column], tau_b: Column | float, price: float, b: str = "_b") -> dict[str, Column]:
    """The second tier is always paid; below its gate (or without a confidence) ``rest`` takes over and is paid as well."""
    sure = F.coalesce(F.col(f"p_max{b}") >= tau_b, F.lit(False))
    return {"y_pred": F.when(sure, F.col(f"y_pred{b}")).otherwise(rest["y_pred"]), "api": F.lit(float(price)) + F.when(sure, 0.0).otherwise(rest["api"]), "to_human": ~sure & rest["to_human"]}


def policy(name: str, rows: DataFrame, key: str, tau: Column | float | None, arm: dict[str, Column]) -> DataFrame:
    """The first tier answers at ``p_max >= tau`` (None: never), the arm takes the rest."""
    own = F.lit(False) if tau is None else F.coalesce(F.col("p_max") >= tau, F.lit(False))
    pred = F.when(own, F.col("y_pred")).otherwise(arm["y_pred"])
    human = ~own & arm["to_human"]
    got = rows.select(F.lit(name).alias("policy"), F.col(key).alias("id"), "y_true", F.when(~human, pred).alias("y_pred"), F.when(own, 0.0).otherwise(arm["api"]).alias("api"), human.alias("to_human"))
    return got.withColumn("correct", F.coalesce((F.col("y_pred") == F.col("y_true")).cast("int"), F.lit(0)))


# ---- joins ---------------------------------------------------------------------------------------------------------

def with_b(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of A with B's columns as ``y_pred_b, p_max_b``."""
    return gates.aligned(a, b.select(key, "y_true", "y_pred", "p_max"), key, "y_true")


def with_c(rows: DataFrame, c: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Rows with C's answer and receipt as ``y_pred_c, api_c, parse_failed_c``; ids must be the same."""
    from sievework.operators.pricing import with_receipts

    answered = gates.aligned(rows, c.select(key, "y_true", F.col("y_pred").alias("y_pred_c")), key, "y_true").withColumnRenamed("y_pred_c_b", "y_pred_c")
    return with_receipts(answered, receipts, key).withColumnsRenamed({"api": "api_c", "parse_failed": "parse_failed_c"})


def all_policies(rows: DataFrame, key: str, taus: dict[str, float], price_a: float, price_b: float) -> DataFrame:
    """The six policies over rows that hold A, B and C, stacked. ``taus``: a_to_human, a_to_b, a_to_c, a_to_b_to_c and b."""
    human, b, c = human_arm(), b_arm(price_b), c_arm()
    chain = b_then(c, taus["b"], price_b)
    made = [
        policy("a", rows, key, -INF, human), policy("all_human", rows, key, None, human), policy("a_to_human", rows, key, taus["a_to_human"], human),
        policy("a_to_b", rows, key, taus["a_to_b"], b), policy("a_to_c", rows, key, taus["a_to_c"], c), policy("a_to_b_to_c", rows, key, taus["a_to_b_to_c"], chain),
    ]
    every = reduce(DataFrame.unionByName, made)
    return every.withColumn("api", F.col("api") + F.when(F.col("policy") == "all_human", 0.0).otherwise(float(price_a)))


# ---- evaluation ----------------------------------------------------------------------------------------------------

def _f1(labels: list[str], pred: Column, kept: Column) -> Column:
    """Macro F1 over rows of ``y_true`` and ``pred``, ``n`` alike each, that are ``kept``."""
    of = lambda c: F.coalesce(F.sum(F.when(kept & c, F.col("n"))), F.lit(0))
    f1 = [F.coalesce(F.try_divide(2.0 * of((F.col("y_true") == k) & (pred == k)), of(F.col("y_true") == k) + of(pred == k)), F.lit(0.0)) for k in labels]
    return sum(f1, F.lit(0.0)) / len(labels)


def macro_f1(policies: DataFrame, labels: list[str], system: bool) -> DataFrame:
    """``policy`` and macro F1 over ``labels``: of answered rows, or of the system (humans are right)."""
    rows = policies.withColumn("y_pred", F.when(F.col("to_human"), F.col("y_true")).otherwise(F.col("y_pred"))) if system else policies.where(~F.col("to_human"))
    cells = rows.groupBy("policy", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("policy").agg(_f1(labels, F.col("y_pred"), F.lit(True)).alias("system_macro_f1" if system else "answered_macro_f1"))


def evaluation(policies: DataFrame, labels: list[str], c_misroute: float, c_human: float) -> DataFrame:
    """Costs by component, routing mix, accuracy and macro F1 over ``labels`` of every policy.

    Rows are counted once, by what tells them apart (classes and flags); all figures come from the counts. F1 is that of
    answered rows (null without any) and that of the system, in which humans are right.
    """
    cells = policies.groupBy("policy", "y_true", "y_pred", "correct", "to_human").agg(F.count(F.lit(1)).alias("n"), F.count("api").alias("paid"), F.sum(F.col("api").cast("double")).alias("api"))
    human, n, right = F.col("to_human"), F.col("n"), F.col("correct")
    mean = lambda v, of=F.lit(True): F.try_divide(F.sum(F.when(of & v.isNotNull(), v * n)).cast("double"), F.sum(F.when(of & v.isNotNull(), n)))  # noqa: E731, B008
    c = costs.components(right, F.lit(0.0), human, c_misroute, c_human)
    return cells.groupBy("policy").agg(
        F.sum("n").alias("n"), mean(c["misroute"]).alias("misroute"), F.try_divide(F.sum("api"), F.sum("paid")).alias("api"), mean(c["human"]).alias("human"), mean(human.cast("int")).alias("human_share"),
        mean(right, ~human).alias("answered_accuracy"), mean(F.when(human, 1).otherwise(right)).alias("system_accuracy"),
        F.when(F.bool_or(~human), _f1(labels, F.col("y_pred"), ~human)).alias("answered_macro_f1"), _f1(labels, F.when(human, F.col("y_true")).otherwise(F.col("y_pred")), F.lit(True)).alias("system_macro_f1"),
    )


def paired(policies: DataFrame, x: str, y: str, c_misroute: float, c_human: float) -> DataFrame:
    """A row per id: cost and rightness of policies ``x`` and ``y`` (a human is right), and who answered by machine.

    Stored, since it is checked and then read by every claim.
    """
    c = costs.components(F.col("correct"), F.col("api"), F.col("to_human"), c_misroute, c_human)
    # Numbers and flags one by one, not structs: those would be sorted to be aggregated.
    one = {"cost": c["misroute"] + c["api"] + c["human"], "right": F.when(F.col("to_human"), 1).otherwise(F.col("correct")), "machine": ~F.col("to_human")}
    of = lambda p, v: F.when(F.col("policy") == p, v)
    sides = [F.max(of(p, v)).alias(f"{s}_{k}") for s, p in (("x", x), ("y", y)) for k, v in one.items()]
    flat = policies.where(F.col("policy").isin(x, y)).groupBy("id").agg(*sides, F.count_if(F.col("policy") == x).alias("nx"), F.count_if(F.col("policy") == y).alias("ny"))
    whole = lambda s: F.struct(*(F.col(f"{s}_{k}").alias(k) for k in one)).alias(s)
    both = stored(flat.select("id", whole("x"), whole("y"), ((F.col("nx") == 1) & (F.col("ny") == 1)).alias("ok")), "paired")
    gates.holds(both, "id", F.col("ok"), f"id not once in both {x} and {y}")
    return both.drop("ok")


def cost_claim(both: DataFrame, reps: int, seed: str) -> DataFrame:
    """Bands of ``delta_per_1k`` (y minus x; less is better) and of ``reduction``, the share of x's cost that y saves.

    The reduction is a ratio within each replicate; a baseline that costs nothing is refused.
    """
    base = both.agg(F.sum("x.cost").alias("s")).first().s
    if not base:
        raise gates.GateError("the baseline costs nothing: no share of it can be saved")
    r = stored(replicate_sums(both, "id", {"a": F.col("x.cost"), "b": F.col("y.cost")}, reps, seed), "replicates")
    gates.holds(r, "rep", (F.col("w") > 0) & (F.col("a") > 0), "replicates without a cost")
    r = r.select(((F.col("b") - F.col("a")) * 1000 / F.col("w")).alias("delta_per_1k"), (1 - F.col("b") / F.col("a")).alias("reduction"))
    got = bands(r, "delta_per_1k", "reduction")
    less = F.col("metric") == "delta_per_1k"
    return got.withColumn("verdict", F.when(less, ci_class(F.col("lo"), F.col("hi"), False)).otherwise(ci_class(F.col("lo"), F.col("hi"))))


def accuracy_claim(both: DataFrame, reps: int, seed: str) -> DataFrame:
    """Band of the difference of the systems' accuracies, y minus x."""
    r = replicate_sums(both, "id", {"d": F.col("y.right") - F.col("x.right")}, reps, seed).select(F.try_divide("d", "w").alias("accuracy"))
    got = bands(r, "accuracy")
    return got.withColumn("verdict", ci_class(F.col("lo"), F.col("hi")))


def comparison(policies: DataFrame, x: str, y: str, c_misroute: float, c_human: float, reps: int, seed: str) -> dict:
    """Cost and accuracy bands of y against x, and McNemar's test over rows that machines answer in both."""
    both = paired(policies, x, y, c_misroute, c_human)
    rows = cost_claim(both, reps, seed).unionByName(accuracy_claim(both, reps, seed)).collect()
    machine = both.where(F.col("x.machine") & F.col("y.machine"))
    m = machine.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x.right") == 1) & (F.col("y.right") == 0)).alias("b"), F.count_if((F.col("x.right") == 0) & (F.col("y.right") == 1)).alias("c")).first()
    return {"claims": {r.metric: r.asDict() for r in rows}, "mcnemar": {"n": m.n, "b": m.b, "c": m.c, "p": mcnemar_p(m.b, m.c)}}


def gate(claims: dict[str, dict]) -> dict:
    """Certified where every metric is favorable; whether any is adverse."""
    verdicts = [c["verdict"] for c in claims.values()]
    return {"certified": bool(verdicts) and all(v == "favorable" for v in verdicts), "any_adverse": "adverse" in verdicts}


def frontier(policies: DataFrame, baseline: str, routers: list[str], c_misroute: float, c_human: float, reps: int, seed: str) -> list[dict]:
    """Each router's claims against the baseline, with its gate."""
    out = []
    for y in routers:
        c = comparison(policies, baseline, y, c_misroute, c_human, reps, seed)
        out.append({"router": y, "baseline": baseline, **c, **gate(c["claims"])})
    return out


def replayed_paths(rows: DataFrame, key: str, tau: float, answers: DataFrame) -> DataFrame:
    """The path of each row from the gate; labels that the gate gives must be those of the policy."""
    own = F.col("p_max") >= tau
    path = F.when(own, F.array(F.lit("A"), F.lit("answered"))).otherwise(F.array(F.lit("A"), F.lit("escalated"), F.lit("B"), F.lit("answered")))
    got = rows.select(F.col(key).alias("id"), path.alias("path"), F.when(own, F.col("y_pred")).otherwise(F.col("y_pred_b")).alias("label"))
    gates.equal_values(got, answers.select("id", F.col("y_pred").alias("label")), "id", "label")
    return got


def transferred(found: DataFrame, expected: list[tuple[str, str]], cost_sha256: str) -> dict[tuple[str, str], float]:
    """Frozen thresholds ``family, dataset, tau, cost_sha256`` by (family, dataset): exactly the expected ones.

    Files of another cost generation are passed over; of this one, repeated, missing or unexpected keys raise.
    """
    rows = [r for r in found.select("family", "dataset", "tau", "cost_sha256").collect() if r.cost_sha256 == cost_sha256]
    keys = [(r.family, r.dataset) for r in rows]
    if len(set(keys)) < len(keys):
        raise gates.GateError(f"repeated thresholds: {sorted(k for k in set(keys) if keys.count(k) > 1)}")
    if set(keys) != set(expected):
        raise gates.GateError(f"missing thresholds {sorted(set(expected) - set(keys))}, unexpected {sorted(set(keys) - set(expected))}")
    return {k: float(r.tau) for k, r in zip(keys, rows, strict=True)}
