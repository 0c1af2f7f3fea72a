"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

Stand-ins: ``documents`` for narratives (product = source, state = lang); ``orders`` for dated rows; ``lineitem``
for predictions (classes of l_returnflag, a prediction and a confidence made of its keys, with many ties).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as tx
from sievework.functions.stats import ratio, wilson
from sievework.operators import costs, dedup, drift, metrics, ranking, resampling, routing, verify
from sievework.operators import splits as sp
from sievework.operators.terms import Terms
from sievework.session import table
from sievework.sources import frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LABELS = ["A", "N", "R"]
C_MISROUTE, C_HUMAN = 2.0, 1.5


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def z6(c, name: str):
    """Rounded, without a negative zero."""
    return F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(c, 6)).alias(name)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---- stand-in tables -------------------------------------------------------------------------------------------

def predictions(spark: SparkSession, d: str) -> DataFrame:
    """``id, y_true, y_pred, p_max, probs, year`` of lineitem; ids are unique, confidences take 1,000 values."""
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000
    p = F.lit(0.34) + k * 0.00066
    wrong = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    pred = F.when(F.col("l_partkey") % 5 < 4, F.col("l_returnflag")).otherwise(wrong)
    probs = F.transform(F.array(*map(F.lit, LABELS)), lambda x: F.when(x == F.col("y_pred"), F.col("p_max")).otherwise((1 - F.col("p_max")) / 2))
    t = table(spark, d, "lineitem").select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("id"), F.col("l_returnflag").alias("y_true"), pred.alias("y_pred"), p.alias("p_max"), F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 7).alias("m7"), (F.col("l_suppkey") % 11).alias("m11"))
    return t.withColumn("probs", probs).withColumn("correct", (F.col("y_true") == F.col("y_pred")).cast("int"))


_P = """p AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, l_returnflag AS y_true,
  CASE WHEN l_partkey % 5 < 4 THEN l_returnflag ELSE ['A', 'N', 'R'][l_suppkey % 3 + 1] END AS y_pred,
  0.34::DOUBLE + ((l_orderkey * 7 + l_linenumber) % 1000) * 0.00066::DOUBLE AS p_max, year(l_shipdate)::INT AS year,
  l_partkey % 7 AS m7, l_suppkey % 11 AS m11 FROM lineitem),
q AS (SELECT *, (y_true = y_pred)::INT AS correct FROM p)"""
#: Escalation arm of a row: right unless m7 is 0, sent to a human where m11 is 0, at a price.
_ARM = "q2 AS (SELECT *, (m7 <> 0)::INT AS arm_correct, (m11 = 0)::INT AS arm_human, 0.01::DOUBLE * (1 + m7) AS arm_api FROM q)"


def arm() -> dict:
    return {"correct": (F.col("m7") != 0).cast("int"), "to_human": (F.col("m11") == 0).cast("int"), "api": 0.01 * (1 + F.col("m7"))}


# ---- scans, filters, counts ------------------------------------------------------------------------------------

@query("ingest_filter", "SELECT doc_id, source AS product, lang AS state, length(text)::BIGINT AS n FROM documents WHERE doc_id IS NOT NULL AND length(trim(text)) > 0")
def ingest_filter(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("doc_id", F.col("source").alias("product"), F.col("lang").alias("state"), F.length("text").cast("long").alias("n"))


@query("ingest_stats", "SELECT count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS n_empty FROM documents")
def ingest_stats(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("n_empty"))


@query("try_cast_rejects", "SELECT CASE WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'bad' WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'large' ELSE 'ok' END AS reason, count(*) AS n FROM events GROUP BY 1")
def try_cast_rejects(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy(F.when(k.isNull(), "bad").when(k > 50, "large").otherwise("ok").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("json_parse", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


TAXONOMY = {f"src{i}": f"class_{i % 4}" for i in range(18)}  # src18 and src19 are not mapped


@query("taxonomy_counts", "SELECT 'class_' || ((substr(source, 4)::INT % 4)::VARCHAR) AS class, count(*) AS n FROM documents WHERE substr(source, 4)::INT < 18 GROUP BY 1")
def taxonomy_counts(spark, d):
    return sp.mapped(table(spark, d, "documents"), "source", TAXONOMY, "class").where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("uncovered_values", "SELECT DISTINCT source AS value FROM documents WHERE substr(source, 4)::INT >= 18")
def uncovered_values(spark, d):
    return sp.uncovered(table(spark, d, "documents"), "source", TAXONOMY).select(F.col("source").alias("value"))


@query("class_year_matrix", """WITH c AS (SELECT DISTINCT o_orderpriority FROM orders), y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders)
SELECT c.o_orderpriority AS class, y.year, count(o.o_orderkey) AS n FROM c CROSS JOIN y LEFT JOIN orders o ON o.o_orderpriority = c.o_orderpriority AND year(o.o_orderdate) = y.year GROUP BY 1, 2""")
def class_year_matrix(spark, d):
    return sp.class_year(table(spark, d, "orders"), "o_orderpriority", "o_orderdate")


@query("class_year_totals", """SELECT coalesce(o_orderpriority, 'all') AS class, coalesce(year(o_orderdate)::VARCHAR, 'all') AS year, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, year(o_orderdate))""")
def class_year_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), F.year("o_orderdate").cast("string").alias("year"))
    return o.cube("class", "year").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("class", F.lit("all")).alias("class"), F.coalesce("year", F.lit("all")).alias("year"), "n")


# ---- splits and selection --------------------------------------------------------------------------------------

RANGES = (("train", "1992-01-01", "1994-12-31"), ("cal", "1995-01-01", "1995-06-30"), ("test", "1995-07-01", "1996-06-30"), ("late", "1996-06-30", None))
_R = "r(split, lo, hi) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', {f'DATE {chr(39)}{b}{chr(39)}' if b else 'NULL::DATE'})" for n, a, b in RANGES) + ")"


@query("temporal_splits", f"WITH {_R} SELECT split, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders JOIN r ON o_orderdate::DATE >= lo AND (hi IS NULL OR o_orderdate::DATE <= hi) GROUP BY 1")
def temporal_splits(spark, d):
    return sp.assigned(table(spark, d, "orders"), "o_orderdate", RANGES).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("split_overlap", f"WITH {_R}, s AS (SELECT split, o_orderkey FROM orders JOIN r ON o_orderdate::DATE >= lo AND (hi IS NULL OR o_orderdate::DATE <= hi)) SELECT a.split AS first, b.split AS second, count(*) AS n FROM s a JOIN s b ON a.o_orderkey = b.o_orderkey AND a.split < b.split GROUP BY 1, 2")
def split_overlap(spark, d):
    return sp.overlaps(sp.assigned(table(spark, d, "orders"), "o_orderdate", RANGES), "o_orderkey")


_QUOTA = """c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c),
b AS (SELECT lang, n, total, (n * 200) // total AS base, (n * 200) % total AS rest FROM t),
z AS (SELECT lang, n, CASE WHEN total <= 200 THEN n ELSE base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 200 - sum(base) OVER () THEN 1 ELSE 0 END END AS quota FROM b)"""


@query("hamilton_quotas", f"WITH {_QUOTA} SELECT lang, n, quota::BIGINT AS quota FROM z")
def hamilton_quotas(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return ranking.quotas(counts, "lang", "n", 200)


@query("stratified_sample", f"WITH {_QUOTA}, k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260805:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, k.lang FROM k JOIN z ON z.lang = k.lang WHERE r <= quota")
def stratified_sample(spark, d):
    return ranking.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 200, "20260805").select("doc_id", "lang")


@query("latest_record", "SELECT o_custkey, max(o_orderdate)::TIMESTAMP AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_record(spark, d):
    return ranking.latest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@query("set_algebra", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS n_unlabelled, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS n_unknown")
def set_algebra(spark, d):
    docs, labs = (table(spark, d, t).select("doc_id").distinct().withColumn(t[0], F.lit(1)) for t in ("documents", "labels"))
    return docs.join(labs, "doc_id", "full_outer").agg(F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("n_both"), F.count_if(F.col("l").isNull()).alias("n_unlabelled"), F.count_if(F.col("d").isNull()).alias("n_unknown"))


@query("quality_gates", "SELECT count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (d IS NULL) AS missing, count(*) FILTER (quality NOT IN (0, 1)) AS outside FROM (SELECT l.*, x.doc_id AS d FROM labels l LEFT JOIN documents x ON l.doc_id = x.doc_id)")
def quality_gates(spark, d):
    known = table(spark, d, "documents").select("doc_id").distinct().withColumn("d", F.lit(1))
    return table(spark, d, "labels").join(known, "doc_id", "left").agg((F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated"), F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(~F.col("quality").isin(0, 1)).alias("outside"))


# ---- texts and duplicates --------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'x{2,}', 'x', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("exact_dedup", f"SELECT md5({_NORM}) AS norm, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(tx.normalized(F.col("text"))).alias("norm")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("token_counts", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')))::BIGINT AS n_types FROM documents")
def token_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


_TOK = f"list_filter(string_split({_NORM}, ' '), lambda x: x <> '')"
_SH = f"""s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [chr(0) || 'EMPTY' || chr(0)] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' ')) END) AS g FROM (SELECT doc_id, {_TOK} AS t FROM documents))"""
_M = "18446744073709551616::UHUGEINT"  # hashes are modulo 2^64


def _mixed(source: str, col: str, keep: str) -> str:
    """Two selects around ``source``: ``col`` (UBIGINT) becomes its mixed hash ``m`` (UHUGEINT)."""
    inner = f"SELECT {keep}, ((xor({col}, {col} >> 32)::UHUGEINT * {dedup.MIX}::UHUGEINT) % {_M})::UBIGINT AS y FROM ({source})"
    return f"SELECT {keep}, xor(y, y >> 29)::UHUGEINT AS m FROM ({inner})"


def _bands_sql() -> str:
    a, b = (x.ravel().tolist() for x in dedup.permutations())
    perms = ", ".join(f"({i}, {p}::UHUGEINT, {q}::UHUGEINT)" for i, (p, q) in enumerate(zip(a, b, strict=True)))
    word = f"SELECT w, list_reduce(list_transform(string_split(reverse(w), ''), lambda c: (ascii(c) + 1)::UHUGEINT), lambda x, y: (x * {dedup.BYTE_BASE}::UHUGEINT + y) % {_M})::UBIGINT AS h FROM (SELECT DISTINCT w FROM k)"
    step = [pow(dedup.WORD_BASE, i, 1 << 64) for i in range(dedup.SHINGLE)]
    terms = " + ".join(f"(coalesce(lead(m, {i}) OVER d, 0::UHUGEINT) * {x}::UHUGEINT) % {_M}" for i, x in enumerate(step))
    return f"""t AS (SELECT doc_id, {_TOK} AS t FROM documents),
k AS (SELECT doc_id, i, t[i] AS w, len(t) AS n FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)),
mw AS ({_mixed(word, 'h', 'w')}),
p AS (SELECT doc_id, i, n, (({terms}) % {_M})::UBIGINT AS h FROM k JOIN mw USING (w) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS ({_mixed(f'SELECT doc_id, h FROM p WHERE i <= greatest(n - {dedup.SHINGLE - 1}, 1)', 'h', 'doc_id')} UNION ALL SELECT doc_id, {dedup.EMPTY_HASH}::UHUGEINT FROM t WHERE len(t) = 0),
perms(i, a, b) AS (VALUES {perms}),
g AS (SELECT doc_id, i, min((m * a + b) % {_M}) // 4294967296::UHUGEINT AS low FROM s, perms GROUP BY 1, 2),
m AS (SELECT doc_id, i // {dedup.ROWS_PER_BAND} AS b, string_agg(low::VARCHAR, ',' ORDER BY i) AS k FROM g GROUP BY 1, 2)"""


_BANDS = _bands_sql()


@query("lsh_bands", f"WITH {_BANDS}, c AS (SELECT b, k, count(*) AS size FROM m GROUP BY 1, 2) SELECT b::INT AS band, size, count(*) AS n FROM c GROUP BY 1, 2")
def lsh_bands(spark, d):
    c = dedup.bands(table(spark, d, "documents"), "doc_id", "text").groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
    return c.groupBy("band", "size").agg(F.count(F.lit(1)).alias("n"))


_CLUSTER = f"""RECURSIVE {_BANDS}, e AS (SELECT DISTINCT doc_id AS u, min(doc_id) OVER (PARTITION BY b, k) AS v FROM m),
f AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach(node, top) AS (SELECT DISTINCT u, u FROM f UNION SELECT f.v, reach.top FROM reach JOIN f ON f.u = reach.node),
cl AS (SELECT node AS doc_id, min(top) AS cluster_id FROM reach GROUP BY 1)"""


@query("dedup_clusters", f"WITH {_CLUSTER} SELECT doc_id, cluster_id, doc_id = cluster_id AS kept FROM cl")
def dedup_clusters(spark, d):
    return dedup.clusters(table(spark, d, "documents").withColumn("day", F.lit(0)), "doc_id", "text", "day")


@query("cluster_size_histogram", f"WITH {_CLUSTER}, z AS (SELECT cluster_id, count(*) AS size FROM cl GROUP BY 1) SELECT size, count(*) AS n FROM z GROUP BY 1")
def cluster_size_histogram(spark, d):
    return dedup_clusters(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


_BEN = _SH.replace("s AS", "bs AS", 1).replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")


@query("shingle_jaccard", f"WITH {_SH}, {_BEN}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1), i AS (SELECT doc_id, item_id, count(*) AS i FROM s JOIN bs USING (g) GROUP BY 1, 2) SELECT i.doc_id, i.item_id, i.i AS shared, round(i.i / (n.n + bn.n - i.i)::DOUBLE, 6) AS jaccard FROM i JOIN n USING (doc_id) JOIN bn USING (item_id)")
def shingle_jaccard(spark, d):
    return dedup.shared_shingles(spark, d).select("doc_id", "item_id", "shared", r6(F.col("shared") / (F.col("n_doc") + F.col("n_item") - F.col("shared")), "jaccard"))


@query("leakage_check", f"WITH {_SH}, {_BEN}, bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1), i AS (SELECT doc_id, item_id, count(*) AS i FROM s JOIN bs USING (g) GROUP BY 1, 2) SELECT i.doc_id, i.item_id FROM i JOIN bn USING (item_id) WHERE i.i >= 0.5 * bn.n")
def leakage_check(spark, d):
    return dedup.shared_shingles(spark, d).where(F.col("shared") >= 0.5 * F.col("n_item")).select("doc_id", "item_id")


@query("split_leakage", f"""WITH {_SH}, c AS (SELECT side, min(doc_id) AS id, count(*) AS n, any_value(gs) AS gs FROM (SELECT doc_id, doc_id % 2 = 0 AS side, list_sort(list(g)) AS gs FROM s WHERE g <> chr(0) || 'EMPTY' || chr(0) GROUP BY 1) GROUP BY side, gs),
x AS (SELECT id, n, len(gs) AS size, unnest(gs) AS g FROM c WHERE side), y AS (SELECT id, n, len(gs) AS size, unnest(gs) AS g FROM c WHERE NOT side),
p AS (SELECT x.id AS first_id, y.id AS second_id, count(*) AS shared, any_value(x.size) + any_value(y.size) - count(*) AS n_union, any_value(x.n) AS n_first, any_value(y.n) AS n_second FROM x JOIN y ON x.g = y.g GROUP BY 1, 2)
SELECT * FROM p WHERE 100 * shared >= 90 * n_union""")
def split_leakage(spark, d):
    return dedup.split_leaks(table(spark, d, "documents"), "doc_id", "text", F.col("doc_id") % 2 == 0)


# ---- metrics ---------------------------------------------------------------------------------------------------

@query("confusion", f"WITH {_P} SELECT y_true, y_pred, count(*) AS n FROM q GROUP BY 1, 2")
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


_K = f"""{_P}, k AS (SELECT x.label, (SELECT count(*) FROM q WHERE y_true = x.label) AS support, (SELECT count(*) FROM q WHERE y_true = x.label AND y_pred = x.label) AS tp,
  (SELECT count(*) FROM q WHERE y_pred = x.label) AS predicted FROM (VALUES ('A'), ('N'), ('R')) x(label))"""


@query("per_class_f1", f"WITH {_K} SELECT label, support, tp, predicted, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0), 0), 6) AS f1 FROM k")
def per_class_f1(spark, d):
    return metrics.per_class(predictions(spark, d), LABELS).select("label", "support", "tp", "predicted", r6("recall", "recall"), r6("f1", "f1"))


@query("scalar_metrics", f"WITH {_K} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(coalesce(2 * tp / nullif(support + predicted, 0), 0)), 6) AS macro_f1, round(avg(tp / nullif(support, 0)), 6) AS balanced_accuracy FROM k")
def scalar_metrics(spark, d):
    return metrics.scalars(predictions(spark, d), LABELS).select(*(r6(c, c) for c in ("accuracy", "macro_f1", "balanced_accuracy")))


@query("labelled_accuracy", "SELECT d.lang, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, round(avg(l.quality), 6) AS share FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
def labelled_accuracy(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), r6(F.avg("quality"), "share"))


@query("ece_bins", f"WITH {_P}, b AS (SELECT least(floor(p_max * 15), 14)::BIGINT AS bin, count(*) AS n, avg(p_max) AS c, avg(correct) AS a FROM q GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n, round(coalesce(c, 0), 6) AS confidence, round(coalesce(a, 0), 6) AS accuracy FROM range(15) r(bin) LEFT JOIN b ON b.bin = r.bin")
def ece_bins(spark, d):
    return metrics.reliability(predictions(spark, d)).select("bin", "n", r6("confidence", "confidence"), r6("accuracy", "accuracy"))


@query("ece", f"WITH {_P}, b AS (SELECT least(floor(p_max * 15), 14) AS bin, count(*) AS n, avg(p_max) AS c, avg(correct) AS a FROM q GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return metrics.ece(predictions(spark, d)).select(r6("ece", "ece"))


@query("brier", f"WITH {_P} SELECT round(avg(CASE WHEN correct = 1 THEN (1 - p_max) ** 2 + 2 * ((1 - p_max) / 2) ** 2 ELSE p_max ** 2 + ((1 - p_max) / 2) ** 2 + ((1 - (1 - p_max) / 2)) ** 2 END), 6) AS brier FROM q")
def brier(spark, d):
    return metrics.brier(predictions(spark, d), LABELS).select(r6("brier", "brier"))


_PROBS = "pq AS (SELECT *, list_transform(['A', 'N', 'R'], lambda x: CASE WHEN x = y_pred THEN p_max ELSE (1 - p_max) / 2 END) AS probs FROM q)"


@query("check_probs", f"WITH {_P}, {_PROBS} SELECT count(*) AS n, count(*) FILTER (p_max <> list_max(probs)) AS bad_max, count(*) FILTER (['A', 'N', 'R'][list_position(probs, list_max(probs))] <> y_pred) AS bad_argmax FROM pq")
def check_probs(spark, d):
    p = predictions(spark, d)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_max") != F.array_max("probs")).alias("bad_max"), F.count_if(metrics.top(F.col("probs"), LABELS) != F.col("y_pred")).alias("bad_argmax"))


_CURVE = "c AS (SELECT id, correct, row_number() OVER o AS rank, sum(1 - correct) OVER (o ROWS UNBOUNDED PRECEDING) AS errors FROM q WINDOW o AS (ORDER BY p_max DESC, id))"


@query("risk_coverage", f"WITH {_P}, {_CURVE} SELECT rank // 1000 AS bucket, count(*) AS n, sum(errors)::BIGINT AS errors FROM c GROUP BY 1")
def risk_coverage(spark, d):
    c = metrics.risk_coverage(predictions(spark, d), "id")
    return c.groupBy(F.floor(F.col("rank") / 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))


@query("aurc", f"WITH {_P}, {_CURVE} SELECT round(avg(errors / rank), 6) AS aurc FROM c")
def aurc(spark, d):
    return metrics.aurc(metrics.risk_coverage(predictions(spark, d), "id")).select(r6("aurc", "aurc"))


@query("acc_at_coverage", f"WITH {_P}, {_CURVE} SELECT x.coverage, round((SELECT avg(correct) FROM c WHERE rank <= greatest(1, ceil(x.coverage * (SELECT count(*) FROM q)))), 6) AS accuracy FROM (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) x(coverage)")
def acc_at_coverage(spark, d):
    return metrics.accuracy_at_coverage(predictions(spark, d), "id", (0.5, 0.8, 0.9, 1.0)).select("coverage", r6("accuracy", "accuracy"))


# ---- thresholds, costs, policies -------------------------------------------------------------------------------

_TT = "t AS (SELECT p_max AS tau, sum(count(*)) OVER o AS n_covered, sum(sum(correct)) OVER o AS ok FROM q GROUP BY p_max WINDOW o AS (ORDER BY p_max DESC))"


@query("threshold_table", f"WITH {_P}, {_TT} SELECT round(tau, 6) AS tau, n_covered::BIGINT AS n_covered, round(n_covered / (SELECT count(*) FROM q), 6) AS coverage, round(ok / n_covered, 6) AS accuracy, round(1 - ok / n_covered, 6) AS risk FROM t")
def threshold_table(spark, d):
    return costs.threshold_table(predictions(spark, d)).select(r6("tau", "tau"), "n_covered", r6("coverage", "coverage"), r6("accuracy", "accuracy"), r6("risk", "risk"))


_GRID = f"""{_P}, {_ARM}, a AS (SELECT p_max AS tau, sum(count(*)) OVER o AS k, sum(sum(correct)) OVER o AS ok, sum(sum(arm_correct * (1 - arm_human))) OVER o AS aok, sum(sum(arm_human)) OVER o AS ah, sum(sum(arm_api)) OVER o AS aa FROM q2 GROUP BY 1 WINDOW o AS (ORDER BY p_max DESC)
  UNION ALL SELECT 'infinity'::DOUBLE, 0, 0, 0, 0, 0),
t AS (SELECT count(*) AS n, sum(arm_correct * (1 - arm_human)) AS aok, sum(arm_human) AS ah, sum(arm_api) AS aa FROM q2),
g AS (SELECT tau, a.k, a.k - a.ok AS wrong, t.n - a.k AS escalated, t.ah - a.ah AS human, t.aa - a.aa AS api, t.aok - a.aok AS arm_ok, t.n FROM a, t)"""
_COST = "({m} * (wrong + escalated - human - arm_ok) + api + {h} * human) * 1000 / n"


@query("cost_sweep", f"WITH {_GRID} SELECT CASE WHEN tau = 'infinity' THEN -1 ELSE round(tau, 6) END AS tau, k::BIGINT AS k, round({_COST.format(m=C_MISROUTE, h=C_HUMAN)}, 5) AS cost_per_1k FROM g")
def cost_sweep(spark, d):
    s = costs.sweep(costs.grid(predictions(spark, d), arm()), C_MISROUTE, C_HUMAN)
    return s.select(F.when(F.col("tau") == float("inf"), -1.0).otherwise(F.round("tau", 6)).alias("tau"), "k", F.round("cost_per_1k", 5).alias("cost_per_1k"))


@query("tau_star", f"WITH {_GRID}, c AS (SELECT *, {_COST.format(m=C_MISROUTE, h=C_HUMAN)} AS cost FROM g) SELECT round(tau, 6) AS tau, k::BIGINT AS k, round(cost, 5) AS cost_per_1k FROM c ORDER BY cost, k DESC LIMIT 1")
def tau_star(spark, d):
    s = costs.sweep(costs.grid(predictions(spark, d), arm()), C_MISROUTE, C_HUMAN)
    return costs.cheapest(s).select(r6("tau", "tau"), "k", F.round("cost_per_1k", 5).alias("cost_per_1k"))


PRICES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
_PR = ", ".join(f"({p}::DOUBLE)" for p in PRICES)


@query("sensitivity_grid", f"WITH {_GRID}, x AS (SELECT m, h FROM (VALUES {_PR}) a(m), (VALUES {_PR}) b(h)), c AS (SELECT m, h, k, {_COST.format(m='m', h='h')} AS cost FROM g, x) SELECT m AS c_misroute, h AS c_human, k::BIGINT AS k, round(cost, 4) AS cost_per_1k FROM c QUALIFY row_number() OVER (PARTITION BY m, h ORDER BY cost, k DESC) = 1")
def sensitivity_grid(spark, d):
    return costs.sensitivity(costs.grid(predictions(spark, d), arm()), PRICES, PRICES).select("c_misroute", "c_human", "k", F.round("cost_per_1k", 4).alias("cost_per_1k"))


def policies(spark, d):
    """Four policies over the same rows, stacked: A alone, all to humans, A then human, A then the arm."""
    p = predictions(spark, d).withColumns({f"arm_{k}": v for k, v in arm().items()})
    low = F.col("p_max") < 0.6
    rows = {
        "a": (F.col("correct"), F.lit(0.0), F.lit(False)),
        "human": (F.lit(1), F.lit(0.0), F.lit(True)),
        "a_to_human": (F.col("correct"), F.lit(0.0), low),
        "a_to_arm": (F.when(low, F.col("arm_correct")).otherwise(F.col("correct")), F.when(low, F.col("arm_api")).otherwise(0.0), low & (F.col("arm_to_human") == 1)),
    }
    each = F.array(*(F.struct(F.lit(k).alias("policy"), a.cast("int").alias("correct"), b.cast("double").alias("api"), c.alias("to_human")) for k, (a, b, c) in rows.items()))
    return p.select("id", F.explode(each).alias("x")).select("id", "x.*")


_POL = f"""{_P}, {_ARM}, z AS (SELECT id, 'a' AS policy, correct, 0::DOUBLE AS api, false AS to_human FROM q2 UNION ALL SELECT id, 'human', 1, 0, true FROM q2
  UNION ALL SELECT id, 'a_to_human', correct, 0, p_max < 0.6::DOUBLE FROM q2
  UNION ALL SELECT id, 'a_to_arm', CASE WHEN p_max < 0.6::DOUBLE THEN arm_correct ELSE correct END, CASE WHEN p_max < 0.6::DOUBLE THEN arm_api ELSE 0 END, p_max < 0.6::DOUBLE AND arm_human = 1 FROM q2)"""


@query("policy_eval", f"WITH {_POL} SELECT policy, count(*) AS n, round(avg(CASE WHEN NOT to_human AND correct = 0 THEN {C_MISROUTE} ELSE 0 END), 6) AS misroute, round(avg(api), 6) AS api, round(avg(CASE WHEN to_human THEN {C_HUMAN} ELSE 0 END), 6) AS human, round(avg(to_human::INT), 6) AS human_share, round(avg(correct) FILTER (NOT to_human), 6) AS answered_accuracy, round(avg(CASE WHEN to_human THEN 1 ELSE correct END), 6) AS system_accuracy FROM z GROUP BY 1")
def policy_eval(spark, d):
    e = costs.evaluate(policies(spark, d), C_MISROUTE, C_HUMAN)
    return e.select("policy", "n", *(r6(c, c) for c in ("misroute", "api", "human", "human_share", "answered_accuracy", "system_accuracy")))


@query("coverage_matched_tau", f"WITH {_P}, c AS (SELECT p_max, row_number() OVER (ORDER BY p_max DESC, id) AS r FROM q) SELECT round(p_max, 6) AS tau FROM c WHERE r = (SELECT round(0.7 * count(*))::BIGINT FROM q)")
def coverage_matched_tau(spark, d):
    r = ranking.ranked(predictions(spark, d).select("id", "p_max"), F.col("p_max").desc(), F.col("id").asc())
    k = predictions(spark, d).agg(F.round(0.7 * F.count(F.lit(1))).cast("long")).scalar()
    return r.where(F.col("rank") == k).select(r6("p_max", "tau"))


# ---- resampling and paired tests -------------------------------------------------------------------------------

@query("mcnemar_counts", f"WITH {_POL}, a AS (SELECT id, correct FROM z WHERE policy = 'a'), b AS (SELECT id, correct FROM z WHERE policy = 'a_to_arm') SELECT count(*) AS n, count(*) FILTER (a.correct = 1 AND b.correct = 0) AS b, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS c FROM a JOIN b ON a.id = b.id")
def mcnemar_counts(spark, d):
    p = policies(spark, d).where(F.col("policy").isin("a", "a_to_arm"))
    w = p.groupBy("id").agg(F.max(F.when(F.col("policy") == "a", F.col("correct"))).alias("x"), F.max(F.when(F.col("policy") == "a_to_arm", F.col("correct"))).alias("y"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c"))


REPS = 1000


def _replicates(rows: str, seed: str) -> str:
    """CTEs ``w(rep, v, w)``: the Poisson weight of every row of ``rows`` (k, v) in every replicate, by the operator's draws."""
    mix = lambda x: f"((xor({x}, {x} >> 32)::UHUGEINT * {resampling.MIX}::UHUGEINT) % {_M})::UBIGINT"
    late = "xor(y, y >> 29)"
    weight = " + ".join(f"(d >= {x})::INT" for x in resampling.LIMITS)
    return f"""r0 AS (SELECT v, ((k::UHUGEINT + {resampling.seed_number(seed)}::UHUGEINT) % {_M})::UBIGINT AS x FROM ({rows})),
r1 AS (SELECT v, {mix('x')} AS y FROM r0), r2 AS (SELECT v, {late} AS own FROM r1),
r3 AS (SELECT v, rep, ((own::UHUGEINT + (rep::UHUGEINT * {resampling.STEP}::UHUGEINT) % {_M}) % {_M})::UBIGINT AS x FROM r2, range({REPS}) z(rep)),
r4 AS (SELECT v, rep, {mix('x')} AS y FROM r3), r5 AS (SELECT v, rep, {late} AS x FROM r4),
r6 AS (SELECT v, rep, {mix('x')} AS y FROM r5), r7 AS (SELECT v, rep, {late} >> 32 AS d FROM r6),
w AS (SELECT rep, v, {weight} AS w FROM r7)"""


_ORDERS = _replicates("SELECT o_orderkey AS k, o_totalprice AS v FROM orders", "s")


@query("bootstrap_means", f"WITH {_ORDERS} SELECT rep::INT AS rep, round(sum(w * v) / sum(w), 4) AS mean FROM w GROUP BY 1")
def bootstrap_means(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return resampling.replicate_means(o, "o_orderkey", {"mean": F.col("o_totalprice")}, REPS, "s").select("rep", F.round("mean", 4).alias("mean"))


@query("bootstrap_band", f"WITH {_ORDERS}, m AS (SELECT rep, sum(w * v) / sum(w) AS mean FROM w GROUP BY 1) SELECT 'mean' AS metric, round(quantile_cont(mean, 0.025), 4) AS lo, round(quantile_cont(mean, 0.975), 4) AS hi FROM m")
def bootstrap_band(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    m = resampling.replicate_means(o, "o_orderkey", {"mean": F.col("o_totalprice")}, REPS, "s")
    return resampling.bands(m, "mean").select("metric", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("bootstrap_f1")
def bootstrap_f1(spark, d):
    got = resampling.replicate_f1(predictions(spark, d), "id", LABELS, REPS, "f")
    return resampling.bands(got, "accuracy", "macro_f1").select("metric", r6("lo", "lo"), r6("hi", "hi"))


@query("wilson_by_segment", """WITH s AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal < 0)::DOUBLE AS f, count(*)::DOUBLE AS n FROM customer GROUP BY 1), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT segment, round(greatest(((f/n + z*z/(2*n)) - z*sqrt(f/n*(1-f/n)/n + z*z/(4*n*n))) / (1 + z*z/n), 0), 6) AS lo, round(least(((f/n + z*z/(2*n)) + z*sqrt(f/n*(1-f/n)/n + z*z/(4*n*n))) / (1 + z*z/n), 1), 6) AS hi FROM s, z""")
def wilson_by_segment(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("c_acctbal") < 0).alias("f"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("f"), F.col("n"))
    return s.select("segment", r6(lo, "lo"), r6(hi, "hi"))


# ---- drift -----------------------------------------------------------------------------------------------------

_WT = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')"
_OOV = f"w AS (SELECT lang, doc_id % 2 = 0 AS ref, unnest({_WT}) AS tok FROM documents), k AS (SELECT DISTINCT tok FROM w WHERE ref)"


@query("oov_rates", f"WITH {_OOV} SELECT lang, count(*) AS n_tokens, count(*) FILTER (k.tok IS NULL) AS n_oov, count(DISTINCT w.tok) AS n_types, count(DISTINCT w.tok) FILTER (k.tok IS NULL) AS n_oov_types, round(count(*) FILTER (k.tok IS NULL) / count(*), 6) AS oov_rate, round(count(DISTINCT w.tok) FILTER (k.tok IS NULL) / count(DISTINCT w.tok), 6) AS type_oov_rate FROM w LEFT JOIN k ON k.tok = w.tok GROUP BY 1")
def oov_rates(spark, d):
    g = drift.oov(table(spark, d, "documents"), Terms(tx.word_tokens(F.col("text"))), F.col("doc_id") % 2 == 0, "lang")
    return g.select("lang", "n_tokens", "n_oov", "n_types", "n_oov_types", r6("oov_rate", "oov_rate"), r6("type_oov_rate", "type_oov_rate"))


_BG = f"list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"


@query("ngram_oov", f"WITH x AS (SELECT lang, doc_id, {_WT} AS t FROM documents), w AS (SELECT lang, doc_id % 2 = 0 AS ref, unnest({_BG}) AS tok FROM x), k AS (SELECT DISTINCT tok FROM w WHERE ref) SELECT lang, count(*) AS n_tokens, count(*) FILTER (k.tok IS NULL) AS n_oov FROM w LEFT JOIN k ON k.tok = w.tok GROUP BY 1")
def ngram_oov(spark, d):
    t = table(spark, d, "documents").select("lang", "doc_id", tx.word_tokens(F.col("text")).alias("t"))
    return drift.oov(t, Terms(F.col("t"), (2, 2)), F.col("doc_id") % 2 == 0, "lang").select("lang", "n_tokens", "n_oov")


@query("tfidf_centroid", f"""WITH t AS (SELECT doc_id, lang, {_WT} AS t FROM documents), n AS (SELECT count(*) AS n FROM t),
f AS (SELECT tok, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS tok FROM t) GROUP BY 1 HAVING count(*) >= 5),
tf AS (SELECT doc_id, lang, tok, count(*) AS tf FROM (SELECT doc_id, lang, unnest(t) AS tok FROM t) GROUP BY ALL),
w AS (SELECT doc_id, lang, tok, (1 + ln(tf)) * (ln((1 + n.n) / (1 + df)) + 1) AS w FROM tf JOIN f USING (tok), n),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), s AS (SELECT lang, tok, sum(w / norm) AS s FROM w JOIN l USING (doc_id) GROUP BY 1, 2),
r AS (SELECT tok, s AS r FROM s WHERE lang = 'en'), d AS (SELECT lang, sum(s * coalesce(r, 0)) AS dot, sqrt(sum(s * s)) AS norm FROM s LEFT JOIN r USING (tok) GROUP BY 1)
SELECT lang, CASE WHEN abs(1 - dot / (norm * (SELECT sqrt(sum(r * r)) FROM r))) < 1e-9 THEN 0 ELSE round(1 - dot / (norm * (SELECT sqrt(sum(r * r)) FROM r)), 6) END AS distance FROM d""")
def tfidf_centroid(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    rows = drift.tfidf(docs, "doc_id", tx.word_tokens(F.col("text")), docs, 5)
    got = drift.centroid_distances(rows, "doc_id", docs.select("doc_id", "lang"), "lang", "en")
    return got.select("lang", F.when(F.abs("distance") < 1e-9, 0.0).otherwise(F.round("distance", 6)).alias("distance"))


_CELL = """SELECT s.year AS year, sum(coalesce(2 * tp / nullif(pi + rho, 0), 0)) / 3 AS v FROM (SELECT year, y_pred AS label, sum({p} * {c}) AS rho, sum(CASE WHEN y_true = y_pred THEN {p} * {c} ELSE 0 END) AS tp, sum(CASE WHEN y_true = y_pred THEN {p} ELSE 0 END) AS pi FROM g GROUP BY 1, 2) s GROUP BY 1"""


_SHIFT = f"""{_P}, n AS (SELECT year::VARCHAR AS year, y_true, y_pred, count(*) AS n FROM q GROUP BY ALL), s AS (SELECT year, y_true, sum(n) AS s FROM n GROUP BY ALL), t AS (SELECT year, sum(s) AS t FROM s GROUP BY 1),
k AS (SELECT y.year, a.y_true, b.y_pred FROM (SELECT DISTINCT year FROM n) y, (VALUES ('A'), ('N'), ('R')) a(y_true), (VALUES ('A'), ('N'), ('R')) b(y_pred)),
g AS (SELECT k.*, coalesce(s1.s / t1.t, 0) AS p1, coalesce(s0.s / t0.t, 0) AS p0, coalesce(n1.n / s1.s, 0) AS c1, coalesce(n0.n / s0.s, 0) AS c0 FROM k JOIN t t1 ON t1.year = k.year JOIN t t0 ON t0.year = '1995'
  LEFT JOIN s s1 ON s1.year = k.year AND s1.y_true = k.y_true LEFT JOIN s s0 ON s0.year = '1995' AND s0.y_true = k.y_true
  LEFT JOIN n n1 ON n1.year = k.year AND n1.y_true = k.y_true AND n1.y_pred = k.y_pred LEFT JOIN n n0 ON n0.year = '1995' AND n0.y_true = k.y_true AND n0.y_pred = k.y_pred)"""


@query("prior_shift_components", f"""WITH {_SHIFT},
a AS ({_CELL.format(p='p0', c='c0')}), b AS ({_CELL.format(p='p1', c='c0')}), c AS ({_CELL.format(p='p0', c='c1')}), d AS ({_CELL.format(p='p1', c='c1')})
SELECT a.year, round(d.v - a.v, 6) AS total, round(((b.v - a.v) + (d.v - c.v)) / 2, 6) AS prior_shapley, round(((d.v - b.v) + (c.v - a.v)) / 2, 6) AS within_shapley FROM a JOIN b USING (year) JOIN c USING (year) JOIN d USING (year)""")
def prior_shift_components(spark, d):
    p = predictions(spark, d).withColumn("year", F.col("year").cast("string"))
    cells = drift.macro_f1_cells(drift.rates(p, "year"), "year", "1995", LABELS)
    return drift.components_of(cells).select("year", r6("total", "total"), r6("prior_shapley", "prior_shapley"), r6("within_shapley", "within_shapley"))


def _z6(x: str) -> str:
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0 ELSE round({x}, 6) END"


def _rates(spark, d):
    return drift.rates(predictions(spark, d).withColumn("year", F.col("year").cast("string")), "year")


@query("prior_shift_accuracy", f"WITH {_SHIFT} SELECT year, y_true AS label, {_z6('(p0 - p1) * c0')} AS prior, {_z6('p0 * (c0 - c1)')} AS within, {_z6('(p1 - p0) * (c0 - c1)')} AS interaction FROM g WHERE y_true = y_pred")
def prior_shift_accuracy(spark, d):
    return drift.accuracy_parts(_rates(spark, d), "year", "1995", LABELS).select("year", "label", *(z6(F.col(c), c) for c in ("prior", "within", "interaction")))


@query("prior_shift_balanced", f"WITH {_SHIFT} SELECT year, round(avg(c1) FILTER (p1 > 0), 6) AS own, round(avg(c0) FILTER (p0 > 0), 6) AS reference FROM g WHERE y_true = y_pred GROUP BY 1")
def prior_shift_balanced(spark, d):
    return drift.balanced_accuracy_cells(_rates(spark, d), "year", "1995", LABELS).select("year", r6("own", "own"), r6("reference", "reference"))


_LF1 = "SELECT year, y_pred AS label, coalesce(2 * sum(CASE WHEN y_true = y_pred THEN {p} * {c} ELSE 0 END) / nullif(sum(CASE WHEN y_true = y_pred THEN {p} ELSE 0 END) + sum({p} * {c}), 0), 0) AS v FROM g GROUP BY 1, 2"


@query("prior_shift_classes", f"""WITH {_SHIFT}, a AS ({_LF1.format(p='p0', c='c0')}), b AS ({_LF1.format(p='p1', c='c0')}), c AS ({_LF1.format(p='p0', c='c1')}), d AS ({_LF1.format(p='p1', c='c1')})
SELECT year, label, {_z6('(d.v - a.v) / 3')} AS total, {_z6('((b.v - a.v) + (d.v - c.v)) / 6')} AS prior_shapley, {_z6('((d.v - b.v) + (c.v - a.v)) / 6')} AS within_shapley FROM a JOIN b USING (year, label) JOIN c USING (year, label) JOIN d USING (year, label)""")
def prior_shift_classes(spark, d):
    got = drift.class_attribution(_rates(spark, d), "year", "1995", LABELS)
    return got.select("year", "label", *(z6(F.col(c), c) for c in ("total", "prior_shapley", "within_shapley")))


@query("prior_shift_one_class", f"""WITH {_SHIFT}, m AS (SELECT year, y_true AS moved, p0 AS m0, p1 AS m1 FROM g WHERE y_true = y_pred),
s1 AS (SELECT g.year, moved, y_true, y_pred, c0, CASE WHEN y_true = moved THEN m1 ELSE coalesce(p0 * (1 - m1) / nullif(1 - m0, 0), 0) END AS p FROM g JOIN m ON m.year = g.year),
f AS (SELECT year, moved, y_pred, coalesce(2 * sum(CASE WHEN y_true = y_pred THEN p * c0 ELSE 0 END) / nullif(sum(CASE WHEN y_true = y_pred THEN p ELSE 0 END) + sum(p * c0), 0), 0) AS v FROM s1 GROUP BY 1, 2, 3)
SELECT year, moved, round(sum(v) / 3, 6) AS macro_f1 FROM f GROUP BY 1, 2""")
def prior_shift_one_class(spark, d):
    return drift.one_at_a_time(_rates(spark, d), "year", "1995", LABELS).select("year", "moved", r6("macro_f1", "macro_f1"))


@query("prior_shift_bands")
def prior_shift_bands(spark, d):
    p = predictions(spark, d).withColumn("year", F.col("year").cast("string"))
    got = drift.replicate_components(p, "id", "year", "1995", "1997", LABELS, REPS, "y").where("valid")
    return resampling.bands(got, "total", "prior_shapley", "within_shapley").select("metric", r6("lo", "lo"), r6("hi", "hi"))


_CW = "list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''), lambda x: ' ' || x || ' ')"
_CG = "flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substr(w, i, n))))"
_TFB = """t{b} AS ({src}), pd{b} AS (SELECT doc_id, tok, count(*) AS tf FROM t{b} GROUP BY 1, 2), f{b} AS (SELECT tok, count(*) AS df FROM pd{b} GROUP BY 1 HAVING count(*) >= 5 ORDER BY sum(tf) DESC, tok LIMIT 150000),
w{b} AS (SELECT doc_id, '{b}' AS block, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM pd{b} JOIN f{b} USING (tok))"""


@query("tfidf_blocks", f"""WITH {_TFB.format(b='w', src=f"SELECT doc_id, unnest(list_concat(t, {_BG})) AS tok FROM (SELECT doc_id, {_WT} AS t FROM documents)")},
{_TFB.format(b='c', src=f"SELECT doc_id, unnest({_CG}) AS tok FROM (SELECT doc_id, unnest({_CW}) AS w FROM documents)")}, e AS (SELECT * FROM ww UNION ALL SELECT * FROM wc)
SELECT doc_id, block, count(*) AS n_terms, round(sum(w) / sqrt(sum(w * w)), 5) AS total FROM e GROUP BY 1, 2""")
def tfidf_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("t"), "text")
    blocks = {"w": Terms(F.col("t"), (1, 2)), "c": Terms(tx.blank_words(F.col("text")), chars=(3, 5))}
    rows = drift.tfidf_blocks(docs, "doc_id", blocks, docs)
    return rows.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("w"), 5).alias("total"))


# ---- metric maps, split frames ---------------------------------------------------------------------------------

@query("point_metrics", f"""WITH {_K}, {_CURVE}, b AS (SELECT least(floor(p_max * 15), 14) AS bin, count(*) AS n, avg(p_max) AS c, avg(correct) AS a FROM q GROUP BY 1),
m AS (SELECT 'accuracy' AS metric, sum(tp) / sum(support) AS value FROM k UNION ALL SELECT 'macro_f1', avg(coalesce(2 * tp / nullif(support + predicted, 0), 0)) FROM k UNION ALL SELECT 'balanced_accuracy', avg(tp / nullif(support, 0)) FROM k
  UNION ALL SELECT 'ece', sum(n * abs(a - c)) / sum(n) FROM b
  UNION ALL SELECT 'brier', avg(CASE WHEN correct = 1 THEN (1 - p_max) ** 2 + 2 * ((1 - p_max) / 2) ** 2 ELSE p_max ** 2 + ((1 - p_max) / 2) ** 2 + ((1 - (1 - p_max) / 2)) ** 2 END) FROM q
  UNION ALL SELECT 'aurc', avg(errors / rank) FROM c UNION ALL SELECT 'f1::' || label, coalesce(2 * tp / nullif(support + predicted, 0), 0) FROM k
  UNION ALL SELECT 'acc_at_cov::' || x.s, (SELECT avg(correct) FROM c WHERE rank <= greatest(1, ceil(x.v * (SELECT count(*) FROM q)))) FROM (VALUES ('0.5', 0.5::DOUBLE), ('0.8', 0.8::DOUBLE), ('0.9', 0.9::DOUBLE)) x(s, v))
SELECT metric, round(value, 6) AS value FROM m""")
def point_metrics(spark, d):
    return verify.point_metrics(predictions(spark, d), LABELS, "id").select("metric", r6("value", "value"))


@query("artifact_checks", f"""WITH {_P}, {_PROBS}, s AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, CASE WHEN l_tax > 0.07 THEN 'R' ELSE l_returnflag END AS label FROM lineitem WHERE l_linenumber < 7),
j AS (SELECT pq.id, y_true, s.id AS k, label FROM pq LEFT JOIN s ON s.id = pq.id)
SELECT 'ids are in the split' AS "check", count(*) FILTER (k IS NULL) AS n_bad, min(id) FILTER (k IS NULL) AS first FROM j
UNION ALL SELECT 'truths are the split''s', count(*) FILTER (k IS NOT NULL AND label <> y_true), min(id) FILTER (k IS NOT NULL AND label <> y_true) FROM j
UNION ALL SELECT 'ids are unique', count(*) FILTER (n > 1), min(id) FILTER (n > 1) FROM (SELECT id, count(*) AS n FROM pq GROUP BY 1)
UNION ALL SELECT 'one probability a label', count(*) FILTER (len(probs) <> 3), min(id) FILTER (len(probs) <> 3) FROM pq
UNION ALL SELECT 'probabilities from 0 to 1', count(*) FILTER (list_min(probs) < 0 OR list_max(probs) > 1), NULL FROM pq
UNION ALL SELECT 'probabilities sum to 1', count(*) FILTER (abs(list_sum(probs) - 1) > 1e-6), NULL FROM pq
UNION ALL SELECT 'p_max is the largest', count(*) FILTER (p_max <> list_max(probs)), min(id) FILTER (p_max <> list_max(probs)) FROM pq
UNION ALL SELECT 'y_pred has the largest', count(*) FILTER (probs[list_position(['A', 'N', 'R'], y_pred)] <> list_max(probs)), NULL FROM pq
UNION ALL SELECT 'labels are declared', count(*) FILTER (y_true NOT IN ('A', 'N', 'R') OR y_pred NOT IN ('A', 'N', 'R')), NULL FROM pq""")
def artifact_checks(spark, d):
    p = predictions(spark, d)
    k = (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("id")
    split = table(spark, d, "lineitem").where("l_linenumber < 7").select(k, F.when(F.col("l_tax") > 0.07, "R").otherwise(F.col("l_returnflag")).alias("label"))
    return verify.against_split(p, split, "id", "label").unionByName(verify.prob_checks(p, LABELS, "id"))


@query("curated_sample")
def curated_sample(spark, d):
    return frames.curated(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 40, "c")


@query("subsample", "SELECT doc_id, lang FROM documents ORDER BY md5('sub:' || doc_id), doc_id LIMIT 100")
def subsample(spark, d):
    return frames.subsample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, "sub")


@query("dedup_map", f"WITH {_CLUSTER} SELECT doc_id AS removed_id, cluster_id AS kept_id FROM cl WHERE doc_id <> cluster_id")
def dedup_map(spark, d):
    return frames.dedup_map(dedup_clusters(spark, d), "doc_id")


@query("truncation_rate", f"SELECT count(*) AS n, round(avg((len({_WT}) > 512)::INT), 6) AS rate FROM documents")
def truncation_rate(spark, d):
    t = table(spark, d, "documents").select(F.size(tx.word_tokens(F.col("text"))).alias("n_tokens"))
    return frames.truncation_rate(t, "n_tokens", 512).select("n", r6("rate", "rate"))


# ---- receipts, events, streaming shapes ------------------------------------------------------------------------

@query("receipts_rollup", "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, round(sum(value), 2) AS total, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def receipts_rollup(spark, d):
    e = table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.count_distinct("user_id").alias("users"))
    return e.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "total", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"), "users")


@query("messages_by_role", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS convs, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def messages_by_role(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("convs"), F.sum(F.length("text")).alias("chars"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from sievework.streaming.windows import hourly

    return hourly(table(spark, d, "events"))


@query("paired_delta", f"WITH {_POL}, c AS (SELECT id, policy, CASE WHEN NOT to_human AND correct = 0 THEN {C_MISROUTE} ELSE 0 END + api + CASE WHEN to_human THEN {C_HUMAN} ELSE 0 END AS cost FROM z) SELECT count(*) AS n, round(avg(b.cost - a.cost) * 1000, 4) AS delta_per_1k FROM c a JOIN c b ON a.id = b.id WHERE a.policy = 'a' AND b.policy = 'a_to_arm'")
def paired_delta(spark, d):
    p = policies(spark, d)
    c = costs.components(F.col("correct"), F.col("api"), F.col("to_human"), C_MISROUTE, C_HUMAN)
    cost = c["misroute"] + c["api"] + c["human"]
    w = p.where(F.col("policy").isin("a", "a_to_arm")).groupBy("id").agg(F.sum(F.when(F.col("policy") == "a", -cost).otherwise(cost)).alias("delta"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta") * 1000, 4).alias("delta_per_1k"))


def _perturbed(family: str, rate: float):
    def f(spark, d):
        from sievework.functions.perturb import perturbed

        docs = table(spark, d, "documents").select("doc_id", "text")
        return docs.select("doc_id", F.sha2(perturbed("text", "doc_id", family, rate, 20260805), 256).alias("text_sha256"))

    return f


for _family, _rate in (("typo", 0.05), ("ocr", 0.1), ("case", 0.1)):
    QUERIES[f"perturb_{_family}"] = _perturbed(_family, _rate)


# ---- cascades, claims, exemplars -------------------------------------------------------------------------------

_JOINT = f"""{_P}, x AS (SELECT p_max, correct, m11 / 11.0::DOUBLE AS p_b, (m7 <> 0)::INT AS correct_b, 0.05::DOUBLE AS cost_b FROM q),
tb AS (SELECT DISTINCT p_b AS tau_b FROM x UNION ALL SELECT 'infinity'::DOUBLE),
a AS (SELECT tau_b, p_max, count(*) AS n, sum({C_MISROUTE} * (1 - correct)) AS own, sum(cost_b + CASE WHEN p_b >= tau_b THEN {C_MISROUTE} * (1 - correct_b) ELSE {C_HUMAN} END) AS arm FROM x, tb GROUP BY 1, 2),
g AS (SELECT tau_b, p_max AS tau_a, sum(n) OVER d AS k, sum(own) OVER d + sum(arm) OVER w - sum(arm) OVER d AS cost, sum(n) OVER w AS n FROM a WINDOW d AS (PARTITION BY tau_b ORDER BY p_max DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY tau_b)
  UNION ALL SELECT tau_b, 'infinity'::DOUBLE, 0, sum(arm), sum(n) FROM a GROUP BY 1)"""


@query("joint_thresholds", f"""WITH {_JOINT}
SELECT tau_b, round(tau_a, 6) AS tau_a, k::BIGINT AS k, round(cost * 1000 / n, 5) AS cost_per_1k FROM g ORDER BY round(cost * 1000 / n, 6), k DESC, tau_b LIMIT 1""")
def joint_thresholds(spark, d):
    from sievework.operators import claims

    p = predictions(spark, d).withColumns({"p_b": F.col("m11") / 11.0, "correct_b": (F.col("m7") != 0).cast("int"), "cost_b": F.lit(0.05)})
    return claims.joint_thresholds(p, None, C_MISROUTE, C_HUMAN).select("tau_b", r6("tau_a", "tau_a"), "k", F.round("cost_per_1k", 5).alias("cost_per_1k"))


_DELTAS = _replicates("SELECT id AS k, y - x AS v FROM c", "c")


@query("paired_claim", f"""WITH {_POL}, c AS (SELECT id, max(CASE WHEN policy = 'a' THEN correct END) AS x, max(CASE WHEN policy = 'a_to_arm' THEN CASE WHEN to_human THEN 1 ELSE correct END END) AS y FROM z GROUP BY 1),
{_DELTAS}, m AS (SELECT rep, sum(w * v) / sum(w) AS mean FROM w GROUP BY 1),
b AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m)
SELECT 'accuracy' AS metric, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 THEN 'favorable' WHEN hi < 0 THEN 'adverse' ELSE 'not_established' END AS verdict FROM b""")
def paired_claim(spark, d):
    from sievework.operators import claims

    p = policies(spark, d).where(F.col("policy").isin("a", "a_to_arm"))
    right = F.when(F.col("to_human"), 1).otherwise(F.col("correct"))
    w = p.groupBy("id").agg(F.max(F.when(F.col("policy") == "a", F.col("correct"))).alias("x"), F.max(F.when(F.col("policy") == "a_to_arm", right)).alias("y"))
    got = claims.paired_claim(w, "id", {"accuracy": F.col("y") - F.col("x")}, REPS, "c")
    return got.select("metric", r6("lo", "lo"), r6("hi", "hi"), "verdict")


@query("exemplars", r"WITH e AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('ex:' || doc_id), doc_id) AS r FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) BETWEEN 200 AND 1200) SELECT doc_id, lang FROM e WHERE r = 1")
def exemplars(spark, d):
    from sievework.operators import claims

    return claims.exemplars(table(spark, d, "documents"), "doc_id", "lang", "text", 200, 1200, "ex").select("doc_id", "lang")


@query("cascade_paths", f"WITH {_P} SELECT CASE WHEN p_max >= 0.6::DOUBLE THEN 'A>answered' ELSE 'A>escalated>B>answered' END AS path, count(*) AS n FROM q GROUP BY 1")
def cascade_paths(spark, d):
    from sievework.operators import claims

    return claims.cascade_paths(predictions(spark, d), 0.6).groupBy(F.array_join("path", ">").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("as_of_events", "SELECT a.event_id, b.value FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts > b.ts")
def as_of_events(spark, d):
    """Each event with the value of its user's event before it."""
    from sievework.streaming.windows import as_of

    e = table(spark, d, "events")
    past = e.groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(e.select("event_id", "user_id", "ts"), past, "user_id", "ts", "value", strict=True).select("event_id", "value")


# ---- routing over three tiers ----------------------------------------------------------------------------------

TAUS = {"a_to_human": 0.6, "a_to_b": 0.7, "a_to_c": 0.5, "a_to_b_to_c": 0.65, "b": 0.4}
PRICE_A, PRICE_B = 0.001, 0.02


def routed(spark, d):
    """The six policies over stand-ins for three tiers and the third one's receipts, joined by id behind gates."""
    p = predictions(spark, d)
    wrong = lambda other: F.when(F.col("y_true") == "A", other).otherwise("A")
    b = p.select("id", "y_true", F.when(F.col("m7") != 0, F.col("y_true")).otherwise(wrong("N")).alias("y_pred"), (F.col("m11") / 11.0).alias("p_max"))
    c = p.select("id", "y_true", F.when(F.col("m11") % 4 != 0, F.col("y_true")).otherwise("R").alias("y_pred"))
    receipts = p.select("id", (0.01 * (1 + F.col("m7"))).alias("computed_cost_usd"), (F.col("m11") == 3).alias("parse_failed"))
    rows = routing.with_c(routing.with_b(p.select("id", "y_true", "y_pred", "p_max"), b, "id"), c, receipts, "id")
    return routing.all_policies(rows, "id", TAUS, PRICE_A, PRICE_B)


_own = {k: f"p_max >= {v}::DOUBLE" for k, v in TAUS.items()}
_ROUTED = f"""{_P}, q3 AS (SELECT *, CASE WHEN m7 <> 0 THEN y_true WHEN y_true = 'A' THEN 'N' ELSE 'A' END AS pb, m11 / 11.0::DOUBLE AS p_b, CASE WHEN m11 % 4 <> 0 THEN y_true ELSE 'R' END AS pc, 0.01::DOUBLE * (1 + m7) AS api_c, m11 = 3 AS failed FROM q),
r6 AS (SELECT 'a' AS policy, id, y_true, y_pred AS pred, {PRICE_A}::DOUBLE AS api, false AS human FROM q3
  UNION ALL SELECT 'all_human', id, y_true, NULL, 0, true FROM q3
  UNION ALL SELECT 'a_to_human', id, y_true, y_pred, {PRICE_A}, NOT {_own['a_to_human']} FROM q3
  UNION ALL SELECT 'a_to_b', id, y_true, CASE WHEN {_own['a_to_b']} THEN y_pred ELSE pb END, {PRICE_A} + CASE WHEN {_own['a_to_b']} THEN 0 ELSE {PRICE_B} END, false FROM q3
  UNION ALL SELECT 'a_to_c', id, y_true, CASE WHEN {_own['a_to_c']} THEN y_pred ELSE pc END, {PRICE_A} + CASE WHEN {_own['a_to_c']} THEN 0 ELSE api_c END, NOT {_own['a_to_c']} AND failed FROM q3
  UNION ALL SELECT 'a_to_b_to_c', id, y_true, CASE WHEN {_own['a_to_b_to_c']} THEN y_pred WHEN p_b >= {TAUS['b']} THEN pb ELSE pc END,
    {PRICE_A} + CASE WHEN {_own['a_to_b_to_c']} THEN 0 ELSE {PRICE_B} + CASE WHEN p_b >= {TAUS['b']} THEN 0 ELSE api_c END END, NOT {_own['a_to_b_to_c']} AND p_b < {TAUS['b']} AND failed FROM q3),
z6 AS (SELECT policy, id, y_true, CASE WHEN NOT human THEN pred END AS pred, api, human, coalesce((NOT human AND pred = y_true)::INT, 0) AS correct FROM r6)"""
_F1 = "(SELECT policy, avg(coalesce(2.0 * h / nullif(s + p, 0), 0)) AS f FROM (SELECT policy, label, count(*) FILTER (y_true = label) AS s, count(*) FILTER (pred = label) AS p, count(*) FILTER (y_true = label AND pred = label) AS h FROM {rows}, (VALUES ('A'), ('N'), ('R')) l(label) GROUP BY 1, 2) GROUP BY 1)"


@query("routing_policies", f"""WITH {_ROUTED}, e AS (SELECT policy, count(*) AS n, avg(CASE WHEN NOT human AND correct = 0 THEN {C_MISROUTE} ELSE 0 END) AS misroute, avg(api) AS api, avg(CASE WHEN human THEN {C_HUMAN} ELSE 0 END) AS human, avg(human::INT) AS human_share,
  avg(correct) FILTER (NOT human) AS answered_accuracy, avg(CASE WHEN human THEN 1 ELSE correct END) AS system_accuracy FROM z6 GROUP BY 1)
SELECT e.policy, n, round(misroute, 6) AS misroute, round(api, 6) AS api, round(human, 6) AS human, round(human_share, 6) AS human_share, round(answered_accuracy, 6) AS answered_accuracy, round(system_accuracy, 6) AS system_accuracy,
  round(x.f, 6) AS answered_macro_f1, round(y.f, 6) AS system_macro_f1 FROM e LEFT JOIN {_F1.format(rows="(SELECT * FROM z6 WHERE NOT human)")} x ON x.policy = e.policy
  JOIN {_F1.format(rows="(SELECT policy, y_true, CASE WHEN human THEN y_true ELSE pred END AS pred FROM z6)")} y ON y.policy = e.policy""")
def routing_policies(spark, d):
    e = routing.evaluation(routed(spark, d), LABELS, C_MISROUTE, C_HUMAN)
    return e.select("policy", "n", *(r6(c, c) for c in ("misroute", "api", "human", "human_share", "answered_accuracy", "system_accuracy", "answered_macro_f1", "system_macro_f1")))


_PAIR = f"""{_ROUTED}, k6 AS (SELECT *, CASE WHEN NOT human AND correct = 0 THEN {C_MISROUTE} ELSE 0 END + api + CASE WHEN human THEN {C_HUMAN} ELSE 0 END AS cost, CASE WHEN human THEN 1 ELSE correct END AS ok FROM z6),
pr AS (SELECT x.id, x.cost AS cx, y.cost AS cy, x.ok AS ox, y.ok AS oy, NOT x.human AND NOT y.human AS machine FROM k6 x JOIN k6 y ON x.id = y.id WHERE x.policy = 'a' AND y.policy = 'a_to_b_to_c')"""


@query("routing_paired", f"WITH {_PAIR} SELECT count(*) AS n, round(avg(cy - cx) * 1000, 4) AS delta_per_1k, round(1 - sum(cy) / sum(cx), 6) AS reduction, round(avg(oy - ox), 6) AS accuracy, count(*) FILTER (machine AND ox = 1 AND oy = 0) AS b, count(*) FILTER (machine AND ox = 0 AND oy = 1) AS c FROM pr")
def routing_paired(spark, d):
    x, y, m = F.col("x"), F.col("y"), F.col("x.machine") & F.col("y.machine")
    got = routing.paired(routed(spark, d), "a", "a_to_b_to_c", C_MISROUTE, C_HUMAN)
    return got.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(y.cost - x.cost) * 1000, 4).alias("delta_per_1k"), r6(1 - F.sum(y.cost) / F.sum(x.cost), "reduction"), r6(F.avg(y.right - x.right), "accuracy"),
        F.count_if(m & (x.right == 1) & (y.right == 0)).alias("b"), F.count_if(m & (x.right == 0) & (y.right == 1)).alias("c"),
    )


@query("routing_cost_claim")
def routing_cost_claim(spark, d):
    got = routing.cost_claim(routing.paired(routed(spark, d), "a", "a_to_b_to_c", C_MISROUTE, C_HUMAN), REPS, "k")
    return got.select("metric", r6("lo", "lo"), r6("hi", "hi"), "verdict")


_JS = _JOINT.replace(f"{C_MISROUTE} * (1 - correct)", "m * (1 - correct)").replace(f"{C_MISROUTE} * (1 - correct_b) ELSE {C_HUMAN}", "m * (1 - correct_b) ELSE h").replace("FROM x, tb GROUP BY 1, 2", "FROM x, tb, pr GROUP BY 1, 2, m, h").replace("a AS (SELECT tau_b,", f"pr AS (SELECT m, h FROM (VALUES {_PR}) u(m), (VALUES {_PR}) v(h)), a AS (SELECT m, h, tau_b,").replace("GROUP BY 1, 2, m, h", "GROUP BY ALL").replace("g AS (SELECT tau_b,", "g AS (SELECT m, h, tau_b,").replace("PARTITION BY tau_b", "PARTITION BY m, h, tau_b").replace("UNION ALL SELECT tau_b, 'infinity'::DOUBLE, 0, sum(arm), sum(n) FROM a GROUP BY 1", "UNION ALL SELECT m, h, tau_b, 'infinity'::DOUBLE, 0, sum(arm), sum(n) FROM a GROUP BY ALL")


@query("joint_sensitivity", f"WITH {_JS} SELECT m AS c_misroute, h AS c_human, tau_b, round(tau_a, 6) AS tau_a, k::BIGINT AS k, round(cost * 1000 / n, 4) AS cost_per_1k FROM g QUALIFY row_number() OVER (PARTITION BY m, h ORDER BY round(cost * 1000 / n, 6), k DESC, tau_b) = 1")
def joint_sensitivity(spark, d):
    from sievework.operators import claims

    p = predictions(spark, d).withColumns({"p_b": F.col("m11") / 11.0, "correct_b": (F.col("m7") != 0).cast("int"), "cost_b": F.lit(0.05)})
    got = claims.joint_sensitivity(p, PRICES, PRICES)
    return got.select("c_misroute", "c_human", "tau_b", r6("tau_a", "tau_a"), "k", F.round("cost_per_1k", 4).alias("cost_per_1k"))


@query("dominance", f"WITH {_POL}, c AS (SELECT policy, avg(CASE WHEN NOT to_human AND correct = 0 THEN {C_MISROUTE} ELSE 0 END + api + CASE WHEN to_human THEN {C_HUMAN} ELSE 0 END) AS cost FROM z GROUP BY 1) SELECT a.policy, count(b.policy) AS n_beaten FROM c a LEFT JOIN c b ON a.cost < b.cost - 1e-9 GROUP BY 1")
def dominance(spark, d):
    e = costs.evaluate(policies(spark, d), C_MISROUTE, C_HUMAN).select("policy", (F.col("misroute") + F.col("api") + F.col("human")).alias("cost"))
    rank = F.rank().over(Window.orderBy(F.round("cost", 9).desc()))  # a row per policy
    return e.select("policy", (rank - 1).cast("long").alias("n_beaten"))
