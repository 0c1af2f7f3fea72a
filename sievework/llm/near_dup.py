"""Near-duplicates by HyperMinHash.

A document's set of word shingles is summed up in ``REGISTERS`` registers; each takes the minimum of the set
under its own hash and stores that minimum's count of leading zeros and the ``MANTISSA`` bits after them (16
bits in all). ``BANDS`` bands of ``ROWS`` registers are candidate keys. For a pair in a bucket the share of equal
registers, less the collisions expected of unequal minima, estimates the Jaccard similarity; pairs within five
standard errors of the limit are confirmed on their full sets. At a similarity of 0.85 a pair shares no band in 3
cases of 10^7 and is estimated too low as rarely.

No bucket is expanded into all its pairs. Equal sets become one node first. In each bucket the member that
shares most buckets with others (the likely original) is tried against the rest. Only buckets that still hold
members outside their largest component go on: small ones (``SMALL`` members) as pairs, estimated and confirmed as
above; larger ones in blocks of ``BLOCK`` members whose full sets are intersected at once, each block of outsiders
against every block of the bucket, giving back only links that join components. So every pair of a bucket is
confirmed, refuted, or already connected, whatever the bucket's size, and rows grow with members, not with pairs.

Defined cases: null, empty or wordless text has the empty set: linked with nothing, its own component. Texts with
fewer words than a shingle have one shingle, the whole sequence. A null doc_id takes part in nothing: component_id
null, kept true. Rows repeating a doc_id stand for one node with all their texts. Texts are taken whole; ties go to
the smallest doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.components import components
from sievework.llm.hashing import mix, window_hashes, word_hashes
from sievework.operators.bounded import only
from sievework.session import bound_batches, stored, table

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
SMALL = 8
BLOCK = 128
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77003))
_A = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_C = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def registers(low: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 53) and mantissa of each minimum, as 16 bits."""
    exponent = np.frexp((low >> _U(11)).astype(np.float64))[1]  # exact: 53 bits
    zeros = (53 - exponent).astype(np.uint64)
    rest = (low << zeros) << _U(1)
    return ((zeros << _U(MANTISSA)) | (rest >> _U(64 - MANTISSA))).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    keyed = mix(regs.astype(np.uint64) * _C + _B)
    return mix(np.bitwise_xor.reduce(keyed.reshape(BANDS, ROWS), axis=1)).view(np.int64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(window_hashes(words, n))


SIGNED = "doc_id long, n_shingles long, set_key binary, regs array<int>, bands array<long>"


def _signer(n: int):
    tags = np.arange(REGISTERS, dtype=np.int64) << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, regs, keyed = [], [], [], []
            for words in word_hashes(b.column(1)):
                s = shingle_set(words, n)
                sizes.append(len(s))
                if len(s):
                    r = registers(minima(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    regs.append((r.astype(np.int64) + tags).astype(np.int32))
                    keyed.append(bands(r))
                else:
                    keys.append(None)
                    regs.append(None)
                    keyed.append(None)
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.list_(pa.int32())), pa.array(keyed, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "regs", "bands"])

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words in enumerate(word_hashes(b.column(1))):  # a row at a time: sets of long texts are large
                s = shingle_set(words, n).view(np.int64)
                yield pa.record_batch([b.column(0).slice(i, 1), pa.array([s], pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def sign(docs: DataFrame, n: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signer(n), SIGNED)


def expected_collision(n: str, m: str):
    """Chance that a register of two sets is equal though their minima differ (HyperMinHash's constant)."""
    a, b = F.col(n).cast("double"), F.col(m).cast("double")
    return F.lit(0.1699194871597391 * 2.0**-MANTISSA) * 4 * a * b / ((a + b) * (a + b))


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links among ``pairs`` (a < b): estimated from registers, then confirmed on full sets."""
    limit = num / den
    floor = limit - 5 * math.sqrt(limit * (1 - limit) / REGISTERS)
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = both.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    equal = F.size(F.array_intersect("regs_a", "regs_b")) / F.lit(REGISTERS)
    chance = expected_collision("n_a", "n_b")
    likely = stored(sized.where((equal - chance) / (1 - chance) >= floor).select("a", "b"), "likely")
    ids = stored(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "ids")
    sets = only(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids).mapInArrow(_setter(n), "id long, shingles array<long>")
    sets = stored(sets, "sets")
    of = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    test = likely.join(of("a"), "a").join(of("b"), "b").select("a", "b", shared.alias("i"), (F.size("s_a") + F.size("s_b")).alias("t"))
    return test.where(den * F.col("i") >= num * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def _linker(num: int, den: int):
    """Exact links between a block of outsiders and a block of members, less those within a component."""

    def matrix(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(shared)), np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(shared, s)
            at[at == len(shared)] = 0
            out[i, at[shared[at] == s]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for left, right in zip(b.column(0), b.column(1), strict=True):
                x, y = left.values, right.values
                ids, labels, sets = zip(*([v.field(0).to_numpy(), v.field(1).to_numpy(), _lists(v.field(2))] for v in (x, y)), strict=True)
                tops = [np.unique(np.concatenate(s)) for s in sets]
                shared = np.intersect1d(*tops, assume_unique=True)
                if not len(shared):
                    continue
                both = np.rint(matrix(sets[0], shared) @ matrix(sets[1], shared).T).astype(np.int64)
                sizes = np.array([len(s) for s in sets[0]])[:, None] + np.array([len(s) for s in sets[1]])[None, :]
                ok = (den * both >= num * (sizes - both)) & (labels[0][:, None] != labels[1][None, :])
                up: dict[int, int] = {}

                def root(v: int, up: dict[int, int] = up) -> int:
                    while v in up:
                        v = up[v]
                    return v

                for i, j in zip(*np.nonzero(ok), strict=True):
                    p, q = root(int(labels[0][i])), root(int(labels[1][j]))
                    if p != q:
                        up[p] = q
                        found.append((int(ids[0][i]), int(ids[1][j])))
            a, c = ([x[k] for x in found] for k in (0, 1))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def _block_links(open_: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links in large buckets: blocks of outsiders meet blocks of members, sets and all."""
    ids = stored(open_.select("id").distinct(), "ids")
    sets = stored(only(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids).mapInArrow(_setter(shingle), "id long, shingles array<long>"), "sets")
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).cast("int"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        one = F.struct("id", "label", "shingles")
        return rows.join(sets, "id").groupBy("key", "size", "block").agg(F.collect_list(one).alias(name))

    # A bucket's blocks are dealt apart: the left ones go to each block on the right.
    left = blocks(dealt.where("label <> main"), "left").select("key", "left", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("block"))
    met = left.join(blocks(dealt, "right").select("key", "block", "right"), ["key", "block"]).select("left", "right")
    return met.mapInArrow(_linker(num, den), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _own_links(known: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links from each doc_id that has several sets to the nodes of those sets."""
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("id"))
    own = known.select("doc_id", "set_key").join(several, F.col("doc_id") == F.col("id"), "left_semi").join(firsts, "set_key")
    return own.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; links need ``num/den`` of the union shared."""
    bound_batches(docs.sparkSession)
    sig = stored(sign(docs, shingle), "signed")
    known = sig.where("doc_id is not null and n_shingles > 0")
    firsts = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "firsts")
    # A node per different set; a doc_id may stand for several texts, then it has several sets.
    reps = stored(known.join(firsts, (known.set_key == firsts.set_key) & (known.doc_id == firsts.rep), "left_semi").dropDuplicates(["doc_id", "set_key"]), "reps")
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count_distinct("id").alias("size")).where("size > 1")
    members = stored(keyed.join(shared, "key").select("key", "id", "size").distinct(), "members")
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    members = stored(members.join(weight, "id").select("key", "id", "weight"), "weighed")
    hubs = members.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("id")).alias("neg"))).alias("m")).select("key", (-F.col("m.neg")).alias("hub"))
    pairs = members.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = stored(_confirmed(pairs, reps, docs, shingle, num, den).unionByName(_own_links(known, firsts)), "links")
    labels = components(links)
    at = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    parts = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"))
    # Per bucket: its size, largest component and a mark of its members; buckets with the same members are one.
    whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.bit_xor("mark").alias("mark"), F.max(F.struct("n", "label")).alias("m")).where("parts > 1")
    once = whole.groupBy("mark", "size").agg(F.min(F.struct("key", F.col("m.label").alias("main"))).alias("k")).select("k.key", "k.main", "size")
    open_ = stored(at.join(once, "key"), "open")
    few = open_.where(F.col("size") <= SMALL)
    other = few.where("label <> main").select("key", F.col("id").alias("other"), F.col("label").alias("other_label"))
    pairs = few.join(other, "key").where("label <> other_label").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    links = links.unionByName(_confirmed(pairs, reps, docs, shingle, num, den))
    many = open_.where(F.col("size") > SMALL)
    if not many.isEmpty():
        links = links.unionByName(_block_links(many, docs, shingle, num, den))
    labels = components(stored(links, "links"))
    top = firsts.join(labels, firsts.rep == labels.node, "left").select("set_key", F.coalesce("label", "rep").alias("top"))
    return sig.join(top, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("top", "doc_id"), F.lit(True)).alias("kept"),
    )


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
u AS (SELECT doc_id, list_sort(list(hash(g))) AS k FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS r FROM u),
x AS (SELECT s.* FROM s WHERE doc_id IN (SELECT r FROM rep)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, top) AS (SELECT DISTINCT r, r FROM rep UNION SELECT e.b, reach.top FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT node, min(top) AS top FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.top, w.doc_id) AS component_id, w.doc_id = coalesce(comp.top, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN comp ON comp.node = rep.r
"""

QUERIES = {"op7_hyperminhash": op7_hyperminhash}
ORACLE_SQL = {"op7_hyperminhash": OP7_SQL}
