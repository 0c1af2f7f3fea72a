"""Vocabulary drift, TF-IDF centroids and prior-shift decomposition."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework import gates
from sievework.functions.stats import ratio
from sievework.operators.bounded import at_most
from sievework.operators.resampling import replicate_sums
from sievework.operators.terms import Terms, counts, one_per_key, sums, weighted
from sievework.session import stored


def oov(docs: DataFrame, terms: Terms, reference: Column, group: str) -> DataFrame:
    """Per group: tokens, tokens and types unknown to the reference rows, and their shares."""
    per = sums(docs.withColumn("ref", reference), [group, "ref"], terms)
    # Types per group first: a row is a type, so types are counted without being told apart again.
    types = per.groupBy("tok", group).agg(F.sum("n").alias("n"), F.coalesce(F.bool_or("ref"), F.lit(False)).alias("ref"))
    j = types.withColumn("known", F.max("ref").over(Window.partitionBy("tok")))
    g = j.groupBy(group).agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("n_oov"), F.count(F.lit(1)).alias("n_types"), F.count_if(~F.col("known")).alias("n_oov_types"))
    return g.withColumn("oov_rate", ratio(F.col("n_oov"), F.col("n_tokens"))).withColumn("type_oov_rate", ratio(F.col("n_oov_types"), F.col("n_types")))


#: Vocabularies of up to this many terms go to the tasks as they are (some 30 bytes a term); larger ones are joined.
VOCABULARY = 500_000


def _weighted(docs: DataFrame, key: str, terms: Terms, idf: DataFrame) -> DataFrame:
    """``key, tok, w`` by the stored ``idf`` (``tok, idf``); a row of ``docs`` per key."""
    if at_most(idf, VOCABULARY):
        return weighted(docs, key, terms, idf.toArrow())
    w = counts(docs, key, terms).join(idf, "tok").select(key, "tok", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).withColumnRenamed(key, "_key")
    return w.join(norm, F.col(key).eqNullSafe(F.col("_key"))).select(key, "tok", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(docs: DataFrame, key: str, tokens: Column, fitted_on: DataFrame, min_df: int) -> DataFrame:
    """Sparse rows ``key, tok, w``: sublinear tf, smoothed idf fitted on one frame, L2-normalised per document."""
    n = fitted_on.agg(F.count(F.lit(1))).scalar()
    df = sums(fitted_on, [], Terms(tokens)).where(F.col("df") >= min_df)
    idf = stored(df.select("tok", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    return _weighted(one_per_key(docs, key, tokens), key, Terms(F.col("_words")), idf)


def tfidf_blocks(docs: DataFrame, key: str, blocks: dict[str, Terms], fitted_on: DataFrame, min_df: int = 5, vocabulary: int = 150_000) -> DataFrame:
    """Sparse rows ``key, block, tok, w``: each block of terms weighted and L2-normalised by itself.

    A block keeps terms of at least ``min_df`` documents, the ``vocabulary`` most frequent ones (then by term).
    """
    n = fitted_on.agg(F.count(F.lit(1))).scalar()
    out = None
    for name, terms in blocks.items():
        here = replace(terms, of=F.col("_words"))
        df = stored(sums(one_per_key(fitted_on, key, terms.of), [], here).where(F.col("df") >= min_df), "terms")
        idf = stored(df.orderBy(F.col("n").desc(), "tok").limit(vocabulary).select("tok", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
        rows = _weighted(one_per_key(docs, key, terms.of), key, here, idf).select(key, F.lit(name).alias("block"), "tok", "w")
        out = rows if out is None else out.unionByName(rows)
    return out


def centroid_distances(rows: DataFrame, key: str, groups: DataFrame, group: str, reference: str) -> DataFrame:
    """Cosine distance of each group's mean row to the reference group's (below 1e-12: 0)."""
    sums = rows.join(groups, key).groupBy(group, "tok").agg(F.sum("w").alias("s"))
    ref = sums.where(F.col(group) == reference).select("tok", F.col("s").alias("r"))
    dots = sums.join(ref, "tok", "left").groupBy(group).agg(F.sum(F.col("s") * F.coalesce("r", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    ref_norm = ref.agg(F.sqrt(F.sum(F.col("r") * F.col("r")))).scalar()
    d = 1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("dot") / (F.col("norm") * ref_norm)))
    return dots.select(group, F.when(F.abs(d) < 1e-12, 0.0).otherwise(d).alias("distance"))


def rates(df: DataFrame, slice_: str) -> DataFrame:
    """Per slice, class and prediction: class prior and the prediction's share within the class."""
    c = df.groupBy(slice_, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy(slice_, "y_true").agg(F.sum("n").alias("support"))
    t = s.groupBy(slice_).agg(F.sum("support").alias("total"))
    return c.join(s, [slice_, "y_true"]).join(t, slice_).select(slice_, "y_true", "y_pred", (F.col("support") / F.col("total")).alias("prior"), (F.col("n") / F.col("support")).alias("cond"))


def dense(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """Every slice, class and prediction with its own prior and conditional (``p1, c1``) and the reference's (``p0, c0``)."""
    rr = r.where(F.col(slice_) == ref).select("y_true", "y_pred", F.col("prior").alias("p0"), F.col("cond").alias("c0"))
    every = F.array(*map(F.lit, labels))
    grid = r.select(slice_).distinct().withColumn("y_true", F.explode(every)).withColumn("y_pred", F.explode(every))
    own = r.select(slice_, "y_true", "y_pred", F.col("cond").alias("c1"))
    prior1 = r.select(slice_, "y_true", F.col("prior").alias("p1")).distinct()
    prior0 = rr.select("y_true", "p0").distinct()
    return grid.join(own, [slice_, "y_true", "y_pred"], "left").join(rr.select("y_true", "y_pred", "c0"), ["y_true", "y_pred"], "left").join(prior1, [slice_, "y_true"], "left").join(prior0, "y_true", "left").na.fill(0.0)


def _class_f1(g: DataFrame, p: str, c: str, name: str, *by: str) -> DataFrame:
    """F1 of every class under priors ``p`` and conditionals ``c``."""
    hit = F.col("y_true") == F.col("y_pred")
    got = g.groupBy(*by, F.col("y_pred").alias("label")).agg(F.sum(F.col(p) * F.col(c)).alias("rho"), F.sum(F.when(hit, F.col(p) * F.col(c)).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, F.col(p)).otherwise(0.0)).alias("pi"))
    return got.select(*by, "label", ratio(2 * F.col("tp"), F.col("pi") + F.col("rho")).alias(name))


def class_f1_cells(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """Per slice and class: F1 with (prior, conditional) from (ref, ref), (slice, ref), (ref, slice), (slice, slice)."""
    g, out = dense(r, slice_, ref, labels), None
    for cell, (p, c) in {"a": ("p0", "c0"), "b": ("p1", "c0"), "c": ("p0", "c1"), "d": ("p1", "c1")}.items():
        f1 = _class_f1(g, p, c, cell, slice_)
        out = f1 if out is None else out.join(f1, [slice_, "label"])
    return out


def macro_f1_cells(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """Per slice: the macro F1 of the four cells."""
    return class_f1_cells(r, slice_, ref, labels).groupBy(slice_).agg(*((F.sum(x) / len(labels)).alias(x) for x in "abcd"))


def balanced_accuracy_cells(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """Per slice: mean recall of the classes that occur in it, its own and the reference's; no prior enters."""
    g = dense(r, slice_, ref, labels).where("y_true = y_pred")
    return g.groupBy(slice_).agg(F.avg(F.when(F.col("p1") > 0, F.col("c1"))).alias("own"), F.avg(F.when(F.col("p0") > 0, F.col("c0"))).alias("reference"))


def class_attribution(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """What each class adds to the change of macro F1, and its prior and within-class parts; classes add up to the whole."""
    c = components_of(class_f1_cells(r, slice_, ref, labels))
    parts = ("total", "prior_first", "within_last", "within_first", "prior_last", "prior_shapley", "within_shapley")
    return c.select(slice_, "label", *((F.col(x) / len(labels)).alias(x) for x in parts))


def accuracy_parts(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """Per slice and class, the loss of accuracy against the reference: by prior, within the class, and by both at once.

    Accuracy is the sum of priors times recalls, so the three parts of all classes add up to the loss exactly.
    """
    g = dense(r, slice_, ref, labels).where("y_true = y_pred")
    dp, dr = F.col("p0") - F.col("p1"), F.col("c0") - F.col("c1")
    return g.select(slice_, F.col("y_true").alias("label"), (dp * F.col("c0")).alias("prior"), (F.col("p0") * dr).alias("within"), ((F.col("p1") - F.col("p0")) * dr).alias("interaction"))


def one_at_a_time(r: DataFrame, slice_: str, ref: str, labels: list[str]) -> DataFrame:
    """Per slice and moved class: macro F1 where only that class has the slice's share and the others shrink alike."""
    g = dense(r, slice_, ref, labels)
    moved = g.where("y_true = y_pred").select(F.col(slice_).alias("_s"), F.col("y_true").alias("moved"), F.col("p0").alias("m0"), F.col("p1").alias("m1"))
    j = g.join(F.broadcast(moved), F.col(slice_) == F.col("_s")).drop("_s")  # slices x classes rows
    share = F.when(F.col("y_true") == F.col("moved"), F.col("m1")).otherwise(F.coalesce(F.try_divide(F.col("p0") * (1 - F.col("m1")), 1 - F.col("m0")), F.lit(0.0)))
    f1 = _class_f1(j.withColumn("p", share), "p", "c0", "f1", slice_, "moved")
    return f1.groupBy(slice_, "moved").agg((F.sum("f1") / len(labels)).alias("macro_f1"))


def check_additivity(components: DataFrame, slice_: str, tol: float = 1e-12) -> None:
    """Each pair of parts adds up to the total; slices where one does not raise."""
    pairs = (("prior_first", "within_last"), ("within_first", "prior_last"), ("prior_shapley", "within_shapley"))
    ok = F.lit(True)
    for x, y in pairs:
        ok = ok & (F.abs(F.col(x) + F.col(y) - F.col("total")) <= tol)
    gates.holds(components, slice_, ok, f"{slice_} whose parts don't add up")


def replicate_components(df: DataFrame, key: str, slice_: str, ref: str, one: str, labels: list[str], reps: int, seed: str) -> DataFrame:
    """Two-sample bootstrap of the components: reference and slice ``one`` draw their own rows in each replicate.

    ``rep, valid`` and the components; a replicate in which a class of the reference or the slice has no row is not
    ``valid``. Only sums of weights per confusion cell leave the rows.
    """
    cells = [(t, p) for t in labels for p in labels]

    def sums(name: str, tag: str) -> DataFrame:
        hits = {f"n{i}": ((F.col("y_true") == t) & (F.col("y_pred") == p)).cast("int") for i, (t, p) in enumerate(cells)}
        got = replicate_sums(df.where(F.col(slice_) == name), key, hits, reps, f"{seed}:{tag}")
        return got.select("rep", F.explode(F.array(*(F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"n{i}").alias("n")) for i, (t, p) in enumerate(cells)))).alias("x")).select("rep", "x.*")

    n = sums(ref, "ref").withColumn("side", F.lit(0)).unionByName(sums(one, "one").withColumn("side", F.lit(1)))
    per = n.groupBy("rep", "side", "y_true").agg(F.sum("n").alias("s"))
    total = per.groupBy("rep", "side").agg(F.sum("s").alias("t"), F.min("s").alias("least"))
    j = n.join(per, ["rep", "side", "y_true"]).join(total, ["rep", "side"])
    value = lambda side, c: F.max(F.when(F.col("side") == side, c))
    prior, cond = ratio(F.col("s"), F.col("t")), ratio(F.col("n"), F.col("s"))
    g = j.groupBy("rep", "y_true", "y_pred").agg(value(0, prior).alias("p0"), value(0, cond).alias("c0"), value(1, prior).alias("p1"), value(1, cond).alias("c1"))
    out = total.groupBy("rep").agg((F.min("least") > 0).alias("valid"))
    for cell, (p, c) in {"a": ("p0", "c0"), "b": ("p1", "c0"), "c": ("p0", "c1"), "d": ("p1", "c1")}.items():
        out = out.join(_class_f1(g, p, c, "f1", "rep").groupBy("rep").agg((F.sum("f1") / len(labels)).alias(cell)), "rep")
    return components_of(out)


# Fixed value: a share of a total smaller than this is not stated.
MIN_ABS_TOTAL = 0.02


def share_gate(point: float, lo: float, hi: float, valid: bool = True) -> tuple[bool, str | None]:
    """Whether a part may be stated as a share of the total, or why not."""
    if not valid:
        return False, "too many replicates lack a class"
    if not (lo > 0 or hi < 0):
        return False, f"the total's interval [{lo:.4f}, {hi:.4f}] holds 0"
    if abs(point) < MIN_ABS_TOTAL:
        return False, f"the total {point:.4f} is smaller than {MIN_ABS_TOTAL}"
    return True, None


def components_of(cells: DataFrame) -> DataFrame:
    """Total change, and its prior and within-class parts along both paths and their mean; parts add up to the total."""
    a, b, c, d = (F.col(x) for x in "abcd")
    return cells.select("*", (d - a).alias("total"), (b - a).alias("prior_first"), (d - b).alias("within_last"), (c - a).alias("within_first"), (d - c).alias("prior_last"), (((b - a) + (d - c)) / 2).alias("prior_shapley"), (((d - b) + (c - a)) / 2).alias("within_shapley"))
