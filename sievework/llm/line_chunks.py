"""Line dedup by content-defined line chunks (DataFrame functions only).

Lines are what stands between newlines. A rolling hash over the hashes of a line and the line before it ends a
chunk where it is 0 modulo ``TARGET_LINES``. So a boundary depends on two lines only, and text shifted by other lines
is cut alike. Chunks of at least two lines with a word count as passages. A line of at least ``LONG_WORDS`` words is a
chunk by itself and counts too (a paragraph on one line). Boundaries fall inside of a repeated run of lines as well,
so its first and last lines, or all of a short one, may lie in no repeated chunk: pairs of neighbouring lines (over
lines without words) are the shortest chunks, and where repeated pairs follow one another over at least ``RUN_WORDS``
words, the whole run is a passage.

Chunks and pairs whose bytes occur more than once in the corpus keep their first occurrence (smallest doc_id, then
place); the lines of the others are removed, for pairs within such runs only. Every line that is removed equals an
earlier one, so the first one of all stays.

First the 64-bit hashes of all chunks and pairs are counted (combined before the shuffle); only those whose hash
repeats travel with their bytes, and grouping by the bytes themselves settles equality.

Defined cases: null text is empty and comes back as the empty string; texts without passages come back unchanged;
rows equal in doc_id and text are one document (all keep what the first keeps); rows that share a doc_id but not a
text each keep a passage that is first in that doc_id; a null doc_id sorts after all others; further columns are
kept, except for ones named like the three counts, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.bounded import at_most
from sievework.session import stored, table

TARGET_LINES = 4
LONG_WORDS = 50
RUN_WORDS = 50
MIN_LINES = 2
#: Up to this many hashes are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Up to so many passages, of so many bytes in all, are broadcast; more are joined by a shuffle, where AQE splits hot ones.
BROADCAST_PASSAGES, BROADCAST_BYTES = 100_000, 16 << 20
_NULL_ID = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Null-safe row key: the id (nulls last) and a hash of the text; the row itself is one column, so no name clashes."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("_sw_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_sw_id"), F.xxhash64(text).alias("_sw_h"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), ""))


def passages(keyed: DataFrame) -> DataFrame:
    """``_sw_id, _sw_h, start, len, pair, text`` of every chunk that counts and every pair of lines of every document."""
    a = keyed.select("_sw_id", "_sw_h", _lines(F.col("_sw_doc.text")).alias("_sw_lines"))
    a = a.select(
        "*",
        F.transform("_sw_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")).alias("_sw_hash"),
        F.transform("_sw_lines", _n_words).alias("_sw_n"),
    )
    line = lambda i: F.get(F.col("_sw_lines"), i)
    prior = lambda i: F.coalesce(F.get(F.col("_sw_hash"), i - 1), F.lit(0))
    long_at = lambda i: F.coalesce(F.get(F.col("_sw_n"), i), F.lit(0)) >= LONG_WORDS
    cut = F.transform("_sw_hash", lambda h, i: ((prior(i) * 31 + h) % TARGET_LINES == 0) | long_at(i) | long_at(i + 1))
    places = F.sequence(F.lit(0), F.size("_sw_lines") - 1)
    filled = F.filter(places, lambda i: F.get(F.col("_sw_n"), i) > 0)
    # The cuts are bound to a variable: as a column they would be computed anew at every place.
    starts = F.get(F.transform(F.array(cut), lambda c: F.filter(places, lambda i: (i == 0) | F.get(c, i - 1))), F.lit(0))
    c = a.select("*", filled.alias("_sw_filled"), starts.alias("_sw_starts"))
    end = lambda k: F.coalesce(F.get(F.col("_sw_starts"), k + 1), F.size("_sw_lines"))
    spans = F.transform("_sw_starts", lambda s, k: F.struct(s.alias("start"), (end(k) - s).alias("len")))
    part = lambda col, x: F.slice(F.col(col), x.start + 1, x.len)
    total = lambda x: F.aggregate(part("_sw_n", x), F.lit(0), lambda p, q: p + q)
    some = lambda x: F.size(F.filter(part("_sw_n", x), lambda n: n > 0))
    d = c.select("_sw_id", "_sw_h", "_sw_lines", "_sw_filled", F.filter(spans, lambda x: (some(x) >= MIN_LINES) | (total(x) >= LONG_WORDS)).alias("_sw_s"))
    piece = lambda start, n, pair, text: F.struct(start.alias("start"), n.alias("len"), F.lit(pair).alias("pair"), text.alias("text"))
    chunks = F.transform("_sw_s", lambda x: piece(x.start, x.len, False, F.array_join(part("_sw_lines", x), "\n")))
    after = lambda k: F.get(F.col("_sw_filled"), k + 1)
    firsts = F.slice("_sw_filled", F.lit(1), F.greatest(F.size("_sw_filled") - 1, F.lit(0)))
    pairs = F.transform(firsts, lambda i, k: piece(i, after(k) - i + 1, True, F.concat(line(i), F.lit("\n"), line(after(k)))))
    return d.select("_sw_id", "_sw_h", F.explode(F.concat(chunks, pairs)).alias("p")).select("_sw_id", "_sw_h", "p.*")


def removals(keyed: DataFrame) -> DataFrame:
    """Per document with a repeated passage: ``_sw_marks``, sorted (passage, start, len, pair, first_here)."""
    found = passages(keyed).select("*", F.xxhash64("pair", "text").alias("ch"))
    twice = stored(found.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("ch").alias("dup")), "dup-hashes")
    side = F.broadcast(twice) if at_most(twice, BROADCAST_HASHES) else twice
    seen = stored(found.join(side, found.ch == side.dup, "left_semi"), "candidates")
    # Grouping by the bytes: what only shares a hash falls apart here. Rows of one document count once.
    same = stored(seen.groupBy("ch", "pair", "text").agg(F.count(F.lit(1)).alias("n"), F.min("_sw_id").alias("first_id")).where("n > 1").drop("n"), "passages")
    size = same.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()
    side = F.broadcast(same) if size.n <= BROADCAST_PASSAGES and size.b <= BROADCAST_BYTES else same
    marked = seen.join(side, ["ch", "pair", "text"]).select("_sw_id", "_sw_h", "ch", "start", "len", "pair", (F.col("_sw_id") == F.col("first_id")).alias("here"))
    return marked.distinct().groupBy("_sw_id", "_sw_h").agg(F.sort_array(F.collect_list(F.struct("ch", "start", "len", "pair", "here"))).alias("_sw_marks"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` deduplicated, and ``n_lines, n_removed_lines, n_removed_chunks`` (runs count as one)."""
    keyed = _keyed(docs)
    joined = keyed.join(removals(keyed), ["_sw_id", "_sw_h"], "left")
    again = lambda x, i: (i > 0) & F.get(F.col("_sw_marks"), i - 1).ch.eqNullSafe(x.ch)
    gone = F.filter("_sw_marks", lambda x, i: ~x.here | again(x, i))
    a = joined.select("_sw_doc", _lines(F.col("_sw_doc.text")).alias("_sw_lines"), gone.alias("_sw_gone"))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    pairs = F.array_sort(F.transform(F.filter("_sw_gone", lambda x: x.pair), lambda x: span(x.start, x.start + x.len - 1)))
    # Pairs that share a line follow one another: a run begins where no pair ends, and ends where none begins.
    b = a.select("*", pairs.alias("_sw_pairs")).select("*", F.transform("_sw_pairs", lambda x: x.a).alias("_sw_a"), F.transform("_sw_pairs", lambda x: x.b).alias("_sw_b"))
    c = b.select("*", F.array_except("_sw_a", "_sw_b").alias("_sw_a0"), F.array_except("_sw_b", "_sw_a").alias("_sw_b0"))
    runs = F.zip_with("_sw_a0", "_sw_b0", span)
    total = lambda x: F.aggregate(F.slice("_sw_lines", x.a + 1, x.b - x.a + 1), F.lit(0), lambda n, y: n + _n_words(y))
    chunks = F.transform(F.filter("_sw_gone", lambda x: ~x.pair), lambda x: span(x.start, x.start + x.len - 1))
    d = c.select("_sw_doc", "_sw_lines", F.concat(chunks, F.filter(runs, lambda x: total(x) >= RUN_WORDS)).alias("_sw_out"))
    out = F.array_distinct(F.flatten(F.transform("_sw_out", lambda x: F.sequence(x.a, x.b))))
    e = d.select("*", F.when(F.size("_sw_out") > 0, out).alias("_sw_places"))
    new = F.when(F.size("_sw_places") > 0, F.array_join(_without("_sw_lines", "_sw_places"), "\n")).otherwise(F.coalesce(F.col("_sw_doc.text"), F.lit(""))).alias("text")
    counts = ("n_lines", "n_removed_lines", "n_removed_chunks")
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return e.select(
        *[new if c == "text" else F.col(f"_sw_doc.`{c}`").alias(c) for c in docs.columns if c not in counts],
        F.size("_sw_lines").cast("long").alias("n_lines"),
        count("_sw_places").alias("n_removed_lines"),
        count("_sw_out").alias("n_removed_chunks"),
    )


def _without(lines: str, places: str) -> Column:
    """The lines at other places."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    return F.transform(kept, lambda i: F.get(F.col(lines), i))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line, len(ls) AS n_lines
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
h AS (SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS hash,
        len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l),
c AS (SELECT *, (coalesce(lag(hash) OVER d, 0) * 31 + hash) % {TARGET_LINES} = 0 OR words >= {LONG_WORDS}
        OR coalesce(lead(words) OVER d, 0) >= {LONG_WORDS} AS cut FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
p AS (SELECT doc_id, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id, chunk
      HAVING count(*) FILTER (words > 0) >= {MIN_LINES} OR sum(words) >= {LONG_WORDS}),
x AS (SELECT doc_id, chunk, start, n FROM p QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, start) > 1),
-- pairs of neighbouring lines with words, and runs of repeated ones
f AS (SELECT doc_id, i, line, row_number() OVER d AS k, lead(i) OVER d AS nxt, lead(line) OVER d AS nline FROM h WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, nxt, k FROM f WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, nline ORDER BY doc_id, i) > 1),
v AS (SELECT doc_id, min(i) AS a, max(nxt) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM w) GROUP BY doc_id, run),
r AS (SELECT v.doc_id, a, b FROM v JOIN h ON h.doc_id = v.doc_id AND h.i BETWEEN a AND b GROUP BY v.doc_id, a, b HAVING sum(words) >= {RUN_WORDS}),
z AS (SELECT doc_id, start AS a, start + n - 1 AS b FROM x UNION ALL SELECT doc_id, a, b FROM r),
o AS (SELECT doc_id, count(*) AS chunks FROM z GROUP BY doc_id),
q AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM z),
g AS (SELECT k.doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (q.i IS NOT NULL) AS gone,
        coalesce(string_agg(line, chr(10) ORDER BY k.i) FILTER (q.i IS NULL), '') AS t
      FROM k LEFT JOIN q ON k.doc_id = q.doc_id AND k.i = q.i GROUP BY k.doc_id)
SELECT g.doc_id, n_lines::BIGINT AS n_lines, gone::BIGINT AS n_removed_lines, coalesce(chunks, 0)::BIGINT AS n_removed_chunks,
  sha256(t) AS text_sha256 FROM g LEFT JOIN o USING (doc_id)
"""

QUERIES = {"op2_line_chunks": op2_line_chunks}
ORACLE_SQL = {"op2_line_chunks": OP2_SQL}
