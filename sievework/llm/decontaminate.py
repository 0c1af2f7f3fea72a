"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are words between ASCII white space, A-Z lower-cased. Every window of ``SEED_WORDS`` words of the corpus that
may be one of a test item's (a bitmap tells, of 16 bits a window of the benchmark up to a bound) becomes a row
(document, place, hash), and rows meet the items' windows in an equi-join. Every window that a document shares with an item is a
seed of that pair, however many documents hold it: a pair is found or not by its two texts alone. Around the seeds of
a document and an item the words themselves are aligned (match +2, mismatch -1, gap -1); the best local score, as a
share of an unedited copy's, is the pair's score. A pair counts from ``MIN_SCORE`` on, or where the alignment is worth
``LONG_MATCH`` matching words, so that a passage of a long item counts by itself. Stretches with too few of the item's words for the least score
(``most_matches``, an upper bound) are not aligned.

Defined cases: null or empty texts hold nothing; items and documents shorter than a window have one, the whole text, so
an item of one or two words is found in documents that are nothing else (inside others it can't be told from chance);
rows that repeat a doc_id or item_id are
searched each and the best score of the pair of ids counts; null ids pass through as null; ties go to the earlier
place; extra columns are ignored; empty tables give an empty result. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.hashing import window_hashes, word_hashes
from sievework.operators.bounded import at_most, only
from sievework.session import bound_batches, stored, table

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, 1, 1
MIN_SCORE = 0.5
LONG_MATCH = 30
#: The bitmap is at most 16 MB; a benchmark of more windows lets more rows through to the join.
BITMAP_BITS = (20, 27)
#: Up to this many windows of items are broadcast (about 30 bytes each), more are joined by a shuffle.
BROADCAST_GRAMS = 500_000
_U = np.uint64

ITEM_GRAMS = "item_key long, item_pos int, gram long"
HITS = "doc_key long, pos int, gram long"


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, words in zip(b.column(0).to_pylist(), word_hashes(b.column(1)), strict=True):
            if len(words):
                g = window_hashes(words, SEED_WORDS)
                yield pa.record_batch([pa.array(np.full(len(g), key, np.int64)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g.view(np.int64))], names=["item_key", "item_pos", "gram"])


def _finder(packed: bytes, bits_log: int):
    """Windows whose bit is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for b in batches:
            keys, places, grams = [], [], []
            for key, words in zip(b.column(0).to_pylist(), word_hashes(b.column(1)), strict=True):
                g = window_hashes(words, SEED_WORDS)
                at = np.flatnonzero(bits[g >> _U(64 - bits_log)])
                if len(at):
                    keys.append(np.full(len(at), key, np.int64))
                    places.append(at.astype(np.int32))
                    grams.append(g[at].view(np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams))], names=["doc_key", "pos", "gram"])

    return run


def bitmap(grams: DataFrame) -> tuple[bytes, int]:
    """2^bits bits over the high bits of the items' windows, gathered 4,096 bits a row, and how many."""
    bits = min(max(BITMAP_BITS[0], math.ceil(math.log2(16 * grams.count() + 1))), BITMAP_BITS[1])
    word = F.shiftrightunsigned("gram", 64 - bits)
    rows = grams.select((F.shiftright(word, 12)).alias("block"), word.bitwiseAND(4095).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << bits, bool)
    got = rows.groupBy("block").agg(F.collect_set("bit").alias("bits"))  # at most 2^15 rows of at most 2^12 bits
    for r in got.toLocalIterator():
        out[(r.block << 12) + np.array(r.bits, np.int64)] = True
    return np.packbits(out).tobytes(), bits


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of ``item`` in ``doc`` and the place after its last word."""
    ramp = GAP * np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(doc == w, MATCH, -MISMATCH), row[1:] - GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k
        row = new
    return best, end


def windows(n: int, m: int, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of a document around seeds (place, place in the item), long enough for every gap that can pay."""
    pad = m + SEED_WORDS
    out: list[list[int]] = []
    for a, b in sorted((max(0, p - i - pad), min(n, p + (m - i) + pad)) for p, i in hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def most_matches(doc: np.ndarray, item: np.ndarray) -> int:
    """No alignment of the two matches more words: those in common, as often as both have them."""
    n = 1 + int(max(doc.max(initial=0), item.max(initial=0)))
    return int(np.minimum(np.bincount(doc, minlength=n), np.bincount(item, minlength=n)).sum()) if len(doc) and len(item) else 0


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCORED = "doc_id long, item_id long, score double, end_word long, n_seeds long"


def _aligner(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids: dict[bytes, int] = {}
                number = lambda t: np.array([ids.setdefault(w, len(ids)) for w in t.encode("utf-8").translate(_LOWER).split()], np.int64)  # noqa: E731, B023
                doc = number(text)
                for it in items.as_py():
                    item = number(it["text"])
                    hits = [(h["pos"], h["item_pos"]) for h in it["hits"]]
                    best, end = 0, 0
                    local = {w: k for k, w in enumerate(dict.fromkeys(item.tolist()))}
                    small = np.array([local[w] for w in item.tolist()], np.int64)
                    codes = np.full(len(ids), len(local), np.int64)
                    codes[list(local)] = list(local.values())
                    for lo, hi in windows(len(doc), len(item), hits):
                        if most_matches(codes[doc[lo:hi]], small) < min(least * len(item), LONG_MATCH):
                            continue
                        s, e = align(doc[lo:hi], item)
                        if s > best:
                            best, end = s, lo + e
                    score = best / (MATCH * len(item))
                    if score >= least or best >= MATCH * LONG_MATCH:
                        out.append((doc_id, it["item_id"], score, end, len(hits)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "end_word", "n_seeds"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``doc_id, item_id, score, end_word, n_seeds`` of every pair that counts (see above)."""
    bound_batches(docs.sparkSession)
    key = lambda c: F.xxhash64(c, "text")
    items = benchmark.where("text is not null").select(key("item_id").alias("item_key"), F.col("item_id").cast("long"), "text").dropDuplicates(["item_key"])
    d = docs.where("text is not null").select(key("doc_id").alias("doc_key"), F.col("doc_id").cast("long"), "text")
    grams = stored(items.select("item_key", "text").mapInArrow(_item_grams, ITEM_GRAMS), "item-grams")
    known = grams.select(F.col("gram").alias("g")).distinct()
    hits = d.select("doc_key", "text").mapInArrow(_finder(*bitmap(grams)), HITS)
    small = at_most(grams, BROADCAST_GRAMS)
    side = F.broadcast if small else lambda x: x
    hits = stored(hits.join(side(known), hits.gram == known.g, "left_semi"), "hits")
    met = hits.join(side(grams), "gram").groupBy("doc_key", "item_key").agg(F.collect_list(F.struct("pos", "item_pos")).alias("hits"))
    per_doc = met.join(items, "item_key").groupBy("doc_key").agg(F.collect_list(F.struct("item_id", "text", "hits")).alias("items"))
    per_doc = stored(per_doc, "met")
    # Only the texts of candidate documents travel (all, once their keys are too many to broadcast).
    full = only(d, "doc_key", per_doc.select(F.col("doc_key").alias("k"))).join(per_doc, "doc_key").select("doc_id", "text", "items")
    scored = full.mapInArrow(_aligner(least), SCORED)
    best = F.max_by(F.struct("score", "end_word", "n_seeds"), F.struct("score", -F.col("end_word"))).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict[str, str] = {}
