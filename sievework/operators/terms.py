"""Terms of documents, counted where the documents lie: what leaves a task is sums per term, not a row per occurrence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sievework.session import bound_batches, stored

SLICE_WORDS = 1 << 18  # words at a time (one document at least), so that a worker's arrays stay small
SLICE_ROWS = 1 << 17  # rows of a batch that is handed back


@dataclass(frozen=True)
class Terms:
    """Terms made of an array of words (a null word parts texts): word n-grams of ``words`` lengths, or, with ``chars``,
    character n-grams of such lengths within words padded by a blank (a shorter word gives itself once)."""

    of: Column
    words: tuple[int, int] = (1, 1)
    chars: tuple[int, int] | None = None


def one_per_key(docs: DataFrame, key: str, words: Column, *more: str) -> DataFrame:
    """``key, words``: a row per key; only texts of repeated keys are shuffled to be put together, parted by a null."""
    rows = docs.select(key, *more, words.alias("_words"))
    repeated = stored(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key")), "repeated")
    if repeated.isEmpty():
        return rows
    same = F.col(key).eqNullSafe(F.col("_key"))
    parted = F.flatten(F.collect_list(F.concat("_words", F.array(F.lit(None).cast("string")))))
    return rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").groupBy(key, *more).agg(parted.alias("_words")))


def _char_grams(words: list[str], n: int, low: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per padded word the numbers of its n-grams (flat, with sizes), and the grams; for n of ``low`` - 1, short words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if n < low:
        short = np.flatnonzero(sizes < low)
        return np.arange(len(short)), (sizes < low).astype(np.int64), pa.array([words[i] for i in short], pa.string())
    text = "".join(words)
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    alphabet, letters = np.unique(letters, return_inverse=True)
    here = np.maximum(sizes - n + 1, 0)
    begins = np.cumsum(sizes) - sizes
    at = np.repeat(begins - (np.cumsum(here) - here), here) + np.arange(here.sum())
    gram, width = letters[at], len(alphabet)
    for j in range(1, n):
        if width * len(alphabet) >= 1 << 62:
            gram = np.unique(gram, return_inverse=True)[1]
            width = int(gram.max(initial=0)) + 1
        gram, width = gram * len(alphabet) + letters[at + j], width * len(alphabet)
    _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
    return gram, here, pa.array([text[i : i + n] for i in at[first].tolist()], pa.string())


def _tallied(owner: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of owner and term, and how often they come."""
    both = owner * n_terms + term
    both.sort()
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(both)])))
    both = both[first]
    return both // max(n_terms, 1), both % max(n_terms, 1), counts


def tallies(words: pa.Array, owner: np.ndarray, grams: tuple[int, int], chars: tuple[int, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of lists of words with an owner each: ``owner, term, count`` of distinct pairs, and the terms that places stand for.

    A part per length of n-grams; terms of parts differ.
    """
    coded = words.flatten().cast(pa.string()).dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
    names, size = coded.dictionary, max(len(coded.dictionary), 1)
    own = owner[ends]
    if chars:
        seen, low, high = code >= 0, *chars
        code, own = code[seen], own[seen]
        padded = [f" {x} " for x in names.to_pylist()]
        for size in range(low - 1, high + 1):
            flat, sizes, terms = _char_grams(padded, size, low)
            if len(terms):
                n = sizes[code]
                at = np.repeat((np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield *_tallied(np.repeat(own, n), flat[at], len(terms)), terms
        return
    low, high = grams
    place, now, terms = np.flatnonzero(code >= 0), code[code >= 0], names
    for n in range(1, high + 1):
        if n > 1:
            last = place + n - 1
            good = last < len(code)
            good[good] = (ends[last[good]] == ends[place[good]]) & (code[last[good]] >= 0)
            place, pairs = place[good], now[good] * size + code[last[good]]
            distinct, now = np.unique(pairs, return_inverse=True)
            terms = pc.binary_join_element_wise(terms.take(pa.array(distinct // size)), names.take(pa.array(distinct % size)), " ")
        if n >= low:
            yield *_tallied(own[place], now, len(terms)), terms


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    total = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_WORDS, "right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def _handed(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), SLICE_ROWS):
        yield pa.record_batch([c.slice(at, SLICE_ROWS) for c in columns], names=names)


def sums(docs: DataFrame, by: list[str], terms: Terms) -> DataFrame:
    """``by, tok, df, n``: rows of ``docs`` with a term, and its occurrences, per values of ``by`` (none: of all rows)."""
    bound_batches(docs.sparkSession)
    grams, chars = terms.words, terms.chars
    rows = docs.select(*by, terms.of.alias("_words"))
    names = [*by, "tok", "df", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                code = np.zeros(b.num_rows, np.int64)
                for c in b.columns[:-1]:
                    d = c.dictionary_encode(null_encoding="encode")
                    code = np.unique(code * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                first = np.unique(code, return_index=True)[1]
                for doc, term, count, told in tallies(b.column(b.num_columns - 1), np.arange(b.num_rows), grams, chars):
                    both, at = np.unique(code[doc] * max(len(told), 1) + term, return_inverse=True)
                    n = np.bincount(at, count, len(both)).astype(np.int64)
                    rep = pa.array(first[both // max(len(told), 1)])
                    yield from _handed([*(c.take(rep) for c in b.columns[:-1]), told.take(pa.array(both % max(len(told), 1))), pa.array(np.bincount(at, minlength=len(both))), pa.array(n)], names)

    kinds = StructType([*(StructField(c, docs.schema[c].dataType) for c in by)]).add("tok", "string").add("df", "long").add("n", "long")
    return rows.mapInArrow(run, kinds).groupBy(*by, "tok").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def counts(docs: DataFrame, key: str, terms: Terms) -> DataFrame:
    """``key, tok, tf`` of frames with a row per key."""
    return _per_document(docs, key, terms, "tf", "long", None)


def weighted(docs: DataFrame, key: str, terms: Terms, idf: pa.Table) -> DataFrame:
    """``key, tok, w`` of frames with a row per key: sublinear tf times ``idf`` (``tok, idf``), L2-normalised per row."""
    return _per_document(docs, key, terms, "w", "double", idf.combine_chunks())


def _per_document(docs: DataFrame, key: str, terms: Terms, name: str, kind: str, idf: pa.Table | None) -> DataFrame:
    bound_batches(docs.sparkSession)
    grams, chars = terms.words, terms.chars
    if idf is not None:
        vocabulary, factor = pa.array(idf["tok"].to_pylist(), pa.string()), idf["idf"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                parts = []
                for doc, term, count, told in tallies(b.column(1), np.arange(b.num_rows), grams, chars):
                    if idf is None:
                        yield from _handed([b.column(0).take(pa.array(doc)), told.take(pa.array(term)), pa.array(count)], [key, "tok", name])
                        continue
                    place = pc.index_in(told, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)[term]
                    kept = place >= 0
                    parts.append((doc[kept], place[kept], (1 + np.log(count[kept])) * factor[place[kept]]))
                if parts:
                    doc, place, w = (np.concatenate(x) for x in zip(*parts, strict=True))
                    w = w / np.sqrt(np.bincount(doc, w * w, b.num_rows))[doc]
                    yield from _handed([b.column(0).take(pa.array(doc)), vocabulary.take(pa.array(place)), pa.array(w)], [key, "tok", name])

    return docs.select(key, terms.of.alias("_words")).mapInArrow(run, StructType([docs.schema[key]]).add("tok", "string").add(name, kind))
