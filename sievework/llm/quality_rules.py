"""Quality rules whose cutoffs are risk-controlled (DataFrame functions only).

Every rule rejects a document whose statistic exceeds a cutoff. On labelled good documents (label 1, base
rules passed) each candidate cutoff of each rule in each stratum is a test of "this cutoff rejects more
than a rule's share of the good documents", the share being ``alpha`` divided by the number of rules. A cutoff is admissible where the exact binomial tail
P(X <= k | n, share) is at most ``delta`` divided by the number of all tests (Bonferroni), which is the
Clopper-Pearson bound. The lowest admissible cutoff of a rule is used; with none the rule stays silent.
With probability 1 - ``delta`` every stratum loses at most ``alpha`` of its good documents to all rules together.

Defined cases: null text has no words and fails the base rules; null lang is the stratum ``''``; a document
with several labels counts as good only if all of them are 1; null labels are ignored; without labels no
cutoff is certified and only the base rules reject; repeated rows get a row each; empty tables give none.
Repeats of word windows are found by 64-bit hashes of five words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import stored, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: Candidate cutoffs of each rule.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3),
    "dup_line_ratio": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_ratio": (0.01, 0.02, 0.05, 0.1, 0.15),
    "mean_word_chars": (8.0, 10.0, 12.0, 15.0, 20.0),
}
ALPHA, DELTA = 0.01, 0.05


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word, symbol, line and repeat counts of each text, in one pass without a shuffle."""
    t = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, t.alias("_t"))
    words = F.array_remove(F.split("_t", SPACE), "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = base.select(
        *keep,
        words.alias("_w"),
        lines.alias("_l"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    b = a.select(
        *keep,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    counts = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    at = lambda i: F.get(F.col("_h"), i)
    five = F.transform("_h", lambda x, i: F.xxhash64(x, *(at(i + k) for k in range(1, WINDOW))))
    last = F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))
    c = b.select(*counts, F.slice(five, F.lit(1), last).alias("_f"))
    # Only texts with a repeat are sorted, to find which places repeat.
    some = F.size(F.array_distinct("_f")) < F.size("_f")
    d = c.select(*counts, F.when(some, F.sort_array(F.transform("_f", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda x, i: F.get(F.col("_s"), i).h.eqNullSafe(x.h)
    places = F.filter("_s", lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
    e = d.select(*counts, F.sort_array(F.transform(places, lambda x: x.i)).alias("_p"))
    covered = F.aggregate(
        F.coalesce("_p", F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc.n + p + WINDOW - F.greatest(acc.end, p)).alias("n")),
        lambda acc: acc.n,
    )
    return e.select(*counts, covered.cast("long").alias("n_repeat_words"))


def with_rules(stats: DataFrame) -> DataFrame:
    """Adds the base verdict and the rules' statistics (0 where nothing is counted)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return stats.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))).alias("base_failed"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from logarithms; 1 where k is at or above the mean."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("log"), F.exp(n * math.log(1 - p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc.log + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (acc.sum + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a.sum)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def certified_cutoffs(good: DataFrame, stratum: str, rules: dict[str, tuple[float, ...]], alpha: float, delta: float) -> DataFrame:
    """A row per stratum: the lowest admissible cutoff of each rule, as ``cut_<rule>`` (null: none).

    One map-side combined aggregation counts every candidate at once; what follows is strata x candidates rows.
    """
    tests = [(r, c) for r, cuts in rules.items() for c in cuts]
    counted = good.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(r) > c).alias(f"k{i}") for i, (r, c) in enumerate(tests))
    )
    strata = counted.agg(F.count(F.lit(1))).scalar()
    long = counted.select(
        stratum, "n",
        F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(tests)))).alias("t"),
    ).select(stratum, "n", "t.*")
    level = delta / len(tests) / strata
    ok = long.where(binomial_cdf(F.col("k"), F.col("n"), alpha / len(rules)) <= level)
    return ok.groupBy(stratum).agg(*(F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in rules))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Statistics, base verdict and ``kept`` of every document."""
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")
    stats = stored(with_rules(text_stats(d, ("doc_id", "stratum"))), "quality-stats")
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label")).where("label = 1").select("doc_id")
    good = stats.where(~F.col("base_failed")).join(truth, "doc_id", "left_semi")
    cuts = certified_cutoffs(good, "stratum", RULES, alpha, delta)
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return stats.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_S = "[\\x20\\x09-\\x0D]"
_TESTS = ", ".join(f"('{r}', {c}::DOUBLE)" for r, cuts in RULES.items() for c in cuts)
_N = sum(map(len, RULES.values()))
_A = ALPHA / len(RULES)
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_S}+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(5, i - coalesce(p, i - 5))) AS n FROM
        (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
-- each repeated window adds the words not covered by the one before it
s AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AS base_failed,
        CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols::DOUBLE / word_chars END AS symbol_ratio,
        CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines::DOUBLE / n_lines END AS dup_line_ratio,
        CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words::DOUBLE / n_words END AS repeat_ratio,
        CASE WHEN n_words = 0 THEN 0 ELSE word_chars::DOUBLE / n_words END AS mean_word_chars FROM s),
good AS (SELECT r.* FROM r JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1) USING (doc_id)
         WHERE NOT base_failed),
tests(rule, cut) AS (VALUES {_TESTS}),
k AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (
        CASE rule WHEN 'symbol_ratio' THEN symbol_ratio WHEN 'dup_line_ratio' THEN dup_line_ratio
                  WHEN 'repeat_ratio' THEN repeat_ratio ELSE mean_word_chars END > cut) AS k
      FROM good, tests GROUP BY ALL),
ok AS (SELECT stratum, rule, min(cut) AS cut FROM k WHERE k < n * {_A} AND
        list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_A}) + (n - i) * ln(1 - {_A}))
                  for i in range(0, k + 1)]) <= {DELTA} / {_N} / (SELECT count(DISTINCT stratum) FROM good)
       GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM r JOIN ok USING (stratum) WHERE CASE ok.rule WHEN 'symbol_ratio' THEN symbol_ratio
    WHEN 'dup_line_ratio' THEN dup_line_ratio WHEN 'repeat_ratio' THEN repeat_ratio ELSE mean_word_chars END > ok.cut)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept
FROM r LEFT JOIN bad USING (doc_id)
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {"op6_quality_rules": OP6_SQL}
