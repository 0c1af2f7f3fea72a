"""MinHash bands, duplicate clusters and their representatives, over five-word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from sievework.functions.text import normalized, shingles, tokens
from sievework.session import bound_batches, stored, table

#: 8 bands of 16 rows: a pair of Jaccard j is linked with chance 1 - (1 - j^16)^8, one half at 0.878.
NUM_PERM, ROWS_PER_BAND = 128, 16
SHINGLE = 5
BUCKETS = 1 << 20  # of shingles by hash, whose counts order a split's shingles (8 bytes each in a task)
SIGN_BLOCK = 512  # shingles at a time, so that the products stay in the cache
#: Hashes are polynomials modulo 2^64: over the bytes of a word, then over the mixed hashes of a shingle's words.
BYTE_BASE, WORD_BASE, MIX, EMPTY_HASH = 0x100000001B3, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 1
_U = np.uint64


def shingled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, s``; tokens are a column of their own, or a lambda would make them again for every shingle."""
    return docs.select(key, tokens(F.col(text)).alias("t")).select(key, shingles(F.col("t")).alias("s"))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the affine maps modulo 2^64 that stand for permutations."""
    at = lambda kind, i: int.from_bytes(hashlib.md5(f"{kind}:{i}".encode()).digest()[:8], "big")
    return np.array([[at("a", i) | 1] for i in range(NUM_PERM)], np.uint64), np.array([[at("b", i)] for i in range(NUM_PERM)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(MIX)
    return x ^ (x >> _U(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per text, the hashes of its shingles. Texts are normalised, one after another in ``raw``, text i up to ``ends[i]``."""
    letter = raw != 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = np.concatenate(([0], ends[:-1]))
    inner = begins[(begins > 0) & (begins < len(raw))]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.array([EMPTY_HASH], np.uint64) for _ in ends]
    sizes = np.diff(np.concatenate((starts, [len(raw)])))
    place = np.zeros(len(raw), np.int64)  # within a word; what lies before the first word is blank
    place[starts[0] :] = np.arange(len(raw) - starts[0]) - np.repeat(starts - starts[0], sizes)
    values = np.where(letter, raw.astype(np.uint64) + _U(1), _U(0))
    words = mixed(np.add.reduceat(values * _powers(BYTE_BASE, int(place.max()) + 1)[place], starts))
    step = _powers(WORD_BASE, SHINGLE)
    of = np.searchsorted(starts, np.concatenate(([0], ends)))  # words of text i: of[i] up to of[i + 1]
    n = max(len(words) - SHINGLE + 1, 0)
    every = mixed(sum((words[k : k + n] * step[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(of[:-1], of[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(every[a : b - SHINGLE + 1])
        elif b > a:
            out.append(mixed((words[a:b] * step[: b - a]).sum(keepdims=True)))
        else:
            out.append(np.array([EMPTY_HASH], np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The ``NUM_PERM`` minima of shingle hashes, 32 bits each."""
    low = np.full(NUM_PERM, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), SIGN_BLOCK):
        np.minimum(low, (a * shingles[k : k + SIGN_BLOCK] + b).min(axis=1), out=low)
    return (low >> _U(32)).astype(">u4").tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = permutations()
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        out = [signature(s, a, b) for s in shingle_hashes(raw, offsets[1:] - offsets[0])] if len(texts) else []
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=[batch.schema.names[0], "sig"])


def bands(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, band, key``: each band's key is ``ROWS_PER_BAND`` minima of the document's ``NUM_PERM``, side by side."""
    bound_batches(docs.sparkSession)
    signed = docs.select(key, normalized(F.col(text)).alias("t")).mapInArrow(_sign, StructType([docs.schema[key], StructField("sig", BinaryType())]))
    size = 4 * ROWS_PER_BAND
    each = F.array(*(F.struct(F.lit(b).alias("band"), F.substring("sig", size * b + 1, size).alias("key")) for b in range(NUM_PERM // ROWS_PER_BAND)))
    return signed.select(key, F.explode(each).alias("x")).select(key, "x.*")


def connected(links: DataFrame) -> DataFrame:
    """``node, label``: smallest reachable node of links ``u, v``; rounds are stored, so lineage stays short.

    No side of a round's joins is small by itself, so none passes the driver to be broadcast.
    """
    both = stored(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        low = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        new = stored(low.join(top.hint("merge"), "label").select("node", "old", F.least("label", "top").alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def clusters(docs: DataFrame, key: str, text: str, day: str) -> DataFrame:
    """``key, cluster_id, kept``: a cluster is represented by its earliest day, then smallest key.

    Equal band keys link documents to the smallest document of the bucket: no pairs within a bucket.
    """
    b = stored(bands(docs, key, text), "bands")
    hub = b.groupBy("band", "key").agg(F.min(key).alias("v"))
    links = b.join(hub.hint("merge"), ["band", "key"]).select(F.col(key).alias("u"), "v")
    labels = connected(links)
    rows = docs.select(key, day).join(labels.hint("merge"), F.col(key) == F.col("node"))
    rep = rows.groupBy("label").agg(F.min(F.struct(day, key)).alias("m")).select("label", F.col(f"m.{key}").alias("cluster_id"))
    return rows.join(rep.hint("merge"), "label").select(key, "cluster_id", (F.col(key) == F.col("cluster_id")).alias("kept"))


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many hashes of all ``s`` fall into each of ``BUCKETS``: a bounded stand-in for the frequency of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], names=["b", "n"])

    bound_batches(sets.sparkSession)
    got = sets.select("s").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def _heads(rarity: np.ndarray, num: int, den: int):
    """Of ``side, id, s`` the prefix of each set, a row per shingle, with the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(2).flatten().to_numpy()
            n = b.column(2).value_lengths().to_numpy()
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((g, rarity[g & (BUCKETS - 1)], own))
            place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)  # owners stay in place
            kept = place < (n - -(-n * num // den) + 1)[own]
            of = pa.array(own[kept])
            yield pa.record_batch([b.column(0).take(of), b.column(1).take(of), pa.array(n.astype(np.int32)).take(of), pa.array(g[order][kept])], names=["side", "id", "n", "g"])

    return run


def split_leaks(docs: DataFrame, key: str, text: str, first: Column, num: int = 90, den: int = 100) -> DataFrame:
    """Texts of the two sides of a split (``first``: on the one side) that share ``num/den`` of their shingles' union.

    ``first_id, second_id, shared, n_union, n_first, n_second``: a row per pair of different shingle sets, one of each
    side, by their smallest keys and how many texts have them; copies are not paired one by one. Exact: sets that are
    so alike have one of their rarest shingles in common (a prefix in any order that all sets share, here by how full a shingle's
    bucket of hashes is, then by hash), and only sets that meet there, of sizes that allow it, are compared. Texts
    without tokens are left out.
    """
    sets = docs.select(key, first.alias("side"), tokens(F.col(text)).alias("t")).where(F.size("t") > 0).select(key, "side", shingles(F.col("t")).alias("s"))
    hashed = sets.select(key, "side", F.array_sort(F.transform("s", lambda g: F.xxhash64(g))).alias("s"))
    one = stored(hashed.groupBy("side", "s").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n_texts")), "sets")
    rarity = _bucket_counts(one)
    heads = stored(one.select("side", "id", "s").mapInArrow(_heads(rarity, num, den), StructType([one.schema["side"], one.schema["id"]]).add("n", "integer").add("g", "long")), "prefixes")
    left, right = (heads.where("side" if x else "not side").select(F.col("id").alias(f"id{x}"), F.col("n").alias(f"n{x}"), "g") for x in (1, 0))
    sized = (den * F.least("n1", "n0") >= num * F.greatest("n1", "n0"))
    pairs = left.join(right, "g").where(sized).select("id1", "id0").distinct()
    of = lambda x: one.where("side" if x else "not side").select(F.col("id").alias(f"id{x}"), F.col("s").alias(f"s{x}"), F.col("n_texts").alias(f"k{x}"))
    both = pairs.join(of(1), "id1").join(of(0), "id0").withColumn("shared", F.size(F.array_intersect("s1", "s0")))
    got = both.withColumn("n_union", F.size("s1") + F.size("s0") - F.col("shared")).where(den * F.col("shared") >= num * F.col("n_union"))
    return got.select(F.col("id1").alias("first_id"), F.col("id0").alias("second_id"), F.col("shared").cast("long").alias("shared"), F.col("n_union").cast("long").alias("n_union"), F.col("k1").alias("n_first"), F.col("k0").alias("n_second"))


def first_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def shared_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, shared, n_doc, n_item`` of documents and benchmark items with a shingle in common."""
    d = shingled(table(spark, sf_dir, "documents"), "doc_id", "text")
    b = shingled(table(spark, sf_dir, "benchmark"), "item_id", "text")
    dx = d.select("doc_id", F.size("s").alias("n_doc"), F.explode_outer("s").alias("g"))
    bx = b.select("item_id", F.size("s").alias("n_item"), F.explode_outer("s").alias("g"))
    return dx.join(bx, "g").groupBy("doc_id", "item_id", "n_doc", "n_item").agg(F.count(F.lit(1)).alias("shared"))
