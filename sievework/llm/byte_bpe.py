"""Byte-level BPE by higher-order functions.

The ranks become a literal of the plan: an array of longs that maps a pair of token ids to the rank of their merge.
Pairs with the same left token are a row, and rows are laid over one another where they don't collide, so a lookup is
one read at (the row's offset + the right token). A word's bytes become an array of entries, each a token with the rank
of its merge with the next one; the fold merges the pair of the lowest rank, leftmost first, with two lookups a merge.
Its first ``WRITTEN_OUT`` steps are columns over columns, which Spark compiles; lambdas are interpreted, so ``aggregate``
folds only what is left (a few in a hundred words). Decoding concatenates the binary pieces of a word's ids.

Nothing is shuffled and nothing but the rank map is broadcast. Three narrow steps follow one another in a task:

1. ``_cutter`` (Arrow) cuts texts into words and gives a row for each word that the task has not had yet, then a row
   per text with the numbers of its words;
2. the fold, a projection over these rows: every distinct word is folded once;
3. ``_joiner`` (Arrow) reads the same rows in order, learns each word's ids, decodes them, and joins both text by text.

A task that knows ``WORDS`` words forgets the half that it has used least, so its memory does not grow with its
partition; a forgotten word is folded again where it comes back. Small splits of a scan are read several to a task (as
long as every core has two), since a task folds fewer words the more text it sees. Words of more than ``LONG_BYTES``
bytes would cost as many merges over arrays of as many ids; they are merged with a heap in step 3, in the same order.

Defined cases: null text is empty: no ids, the digests of no bytes; texts are taken whole; null doc_id passes
through; repeated rows get a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import bound_batches, table

#: Distinct words that a task knows at a time.
WORDS = 3 << 16
LONG_BYTES = 256
#: Steps of the fold that are written out.
WRITTEN_OUT = 8
#: Splits of a scan that one task may read.
SPLITS_A_TASK = 4
# Fixed value: the pattern that ``words`` cuts by without a regular expression.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_NONE = 1 << 17  # above every rank
_FREE = 1 << 34  # above every entry that merges
_SPAN, _ROW = 1 << 19, 1 << 16
_EDGE = _NONE - 1  # no token has this id
_REST = 1 << 30


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, rank) of every pair of tokens whose joined bytes are a token, sorted."""
    out = array("I")
    for tok, r in ranks.items():
        for i in range(1, len(tok)):
            a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
            if a is not None and b is not None:
                out.extend((a, b, r))
    pairs = np.array(out, np.int64).reshape(-1, 3)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each left token's row, the table): an entry is ``left << 34 | rank << 17``."""
    pairs = merge_pairs(ranks)
    lefts, first, size = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    offsets = np.zeros(max(ranks.values()) + 1, np.int32)
    out = np.full(_SPAN + _ROW, 1 << 62, np.int64)
    rng = np.random.Generator(np.random.PCG64(5))
    for k in np.argsort(-size, kind="stable"):
        row = pairs[first[k] : first[k] + size[k]]
        for _ in range(10_000):
            offset = int(rng.integers(0, _SPAN))
            if (out[offset + row[:, 1]] == 1 << 62).all():
                break
        else:
            raise ValueError("the merge table is too small for these ranks")
        offsets[lefts[k]] = offset
        out[offset + row[:, 1]] = (lefts[k] << 34) + (row[:, 2] << 17)
    return offsets, out


class Codec:
    """The rank map of one file, as session variables of ``spark``.

    Names are fixed, so a later codec takes the place of an earlier one and frees its values; frames made before keep
    the values that they were made with.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        self.spark, self.pattern, self.ranks = spark, pattern, load_ranks(path)
        offsets, merges = merge_table(self.ranks)
        self.offsets = self._literal("sievework_offsets", "array<int>", pa.array([offsets], pa.list_(pa.int32())))
        self.merges = self._literal("sievework_merges", "array<bigint>", pa.array([merges], pa.list_(pa.int64())))
        self.bytes = self._literal("sievework_bytes", "array<int>", pa.array([[self.ranks[bytes([i])] for i in range(256)]], pa.list_(pa.int32())))

    def _literal(self, name: str, kind: str, value: pa.Array) -> Column:
        """A one-row frame's value; as a variable's value it is one flat block of bytes in the plan."""
        self.spark.createDataFrame(pa.table({"v": value})).createOrReplaceTempView(name)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
        self.spark.sql(f"SET VAR {name} = (SELECT v FROM {name})")
        self.spark.catalog.dropTempView(name)
        return F.expr(name)

    def entry(self, a: Column, b: Column) -> Column:
        """A token and what it makes with the next one: ``rank << 17 | a``; ``_FREE`` or more where they don't merge."""
        found = F.get(self.merges, F.get(self.offsets, a) + b) - a.cast("long") * (1 << 34)
        return F.coalesce(found.bitwiseAND((1 << 63) - 1), F.lit(1 << 62)).bitwiseOR(a.cast("long"))

    def entries(self, word: Column) -> Column:
        """The bytes of a word as entries, after one that merges with nothing."""
        letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        tokens = F.concat(F.array(F.lit(_EDGE)), F.transform(letters, lambda c: F.get(self.bytes, F.ascii(c))))
        return _let(tokens, lambda p: F.zip_with(p, F.slice(p, F.lit(2), _REST), self.entry))

    def merge(self, e: Column, low: Column, i: Column) -> Column:
        """Joins the tokens at places i and i + 1, whose entry is ``low``; only the entries beside them change."""
        token = F.shiftright(low, 17).cast("int")
        left, new = self.entry(_token(F.get(e, i - 2)), token), self.entry(token, _token(F.get(e, i + 1)))
        return F.concat(F.slice(e, F.lit(1), F.greatest(i - 2, F.lit(0))), F.array(left, new), F.slice(e, F.greatest(i + 2, F.lit(1)), _REST))

    def fold(self, rows: DataFrame, word: Column) -> DataFrame:
        """``rows`` and the token ids of a word of each (null: null) as ``ids``."""
        keep, e, low = rows.columns, F.col("_sw_e"), F.col("_sw_low")
        q = rows.select(*keep, F.when(word.isNotNull(), self.entries(word)).alias("_sw_e"))
        for _ in range(WRITTEN_OUT):
            q = q.select("*", F.array_min(e).alias("_sw_low"))
            # The lambda ends a span of generated code: steps in one span would be too long a method to be compiled.
            q = q.select(*keep, e, _let(low, lambda x: x).alias("_sw_low"), F.array_position(e, low).cast("int").alias("_sw_at"))
            q = q.select(*keep, F.when(low < _FREE, self.merge(e, low, F.col("_sw_at"))).otherwise(e).alias("_sw_e"))

        def step(x: Column, _: Column) -> Column:
            return _let(F.array_min(x), lambda m: F.when(m < _FREE, _let(F.array_position(x, m).cast("int"), lambda i: self.merge(x, m, i))).otherwise(x))

        more = F.aggregate(F.sequence(F.lit(1), F.size(e)), e, step)
        q = q.select(*keep, F.when(F.array_min(e) < _FREE, more).otherwise(e).alias("_sw_e"))
        return q.select(*keep, F.transform(F.slice(e, F.lit(2), _REST), _token).alias("ids"))

    def encode(self, docs: DataFrame, words: int | None = None) -> DataFrame:
        """``doc_id, ids, decoded`` per row of ``docs``: ids as little-endian 32-bit integers, and the bytes they give."""
        bound_batches(self.spark, 1 << 20)
        of = docs.schema["doc_id"].dataType.simpleString()
        cut = _fewer_tasks(docs.select("doc_id", "text")).mapInArrow(_cutter(self.pattern, words or WORDS), f"doc_id {of}, word string, refs binary")
        short = F.octet_length("word").between(1, LONG_BYTES)
        rows = self.fold(cut, F.when(short, F.col("word"))).select("doc_id", "refs", "ids", F.when(~short, F.col("word")).alias("word"))
        return rows.mapInArrow(_joiner(self.ranks), f"doc_id {of}, ids binary, decoded binary")


def _fewer_tasks(docs: DataFrame) -> DataFrame:
    splits = docs.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    return docs.coalesce(max(1, -(-splits // SPLITS_A_TASK), min(splits, 2 * docs.sparkSession.sparkContext.defaultParallelism)))


def _token(entry: Column) -> Column:
    return entry.bitwiseAND(_NONE - 1).cast("int")


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 0 letter, 1 number, 2 other, 3 white space."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, np.uint8)
    for kind, what in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = 2
    return out


def words(text: str) -> list[str]:
    """The matches of ``PATTERN``, one after another: they cover the text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    starts = np.ones(len(points), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    white = kinds == 3
    # The last white space before something else stands alone, or is a blank and goes with what follows.
    after = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    starts[after - 1] = True
    starts[after] = points[after - 1] != 0x20
    quotes = np.flatnonzero((points[:-1] == 0x27) & starts[:-1] & (kinds[1:] == 0))
    for q in quotes.tolist():
        for e in ENDINGS:
            if text.startswith(e, q + 1):
                starts[q + 1] = False
                if q + 1 + len(e) < len(text):
                    starts[q + 1 + len(e)] = True
                break
    at = np.flatnonzero(starts).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]  # noqa: B905


def _cutter(pattern: str, most: int):
    """A row per new word, then a row per text with its words' numbers.

    A row with the empty word says that words are forgotten: its refs are the numbers of those that stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        # White space as the pattern means it: the Unicode property, without the separators 0x1C to 0x1F.
        cut = words if pattern == PATTERN else regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        new: list[str] = []

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(self)
                new.append(word)
                return n

        known = Known()
        uses = np.zeros(0, np.int64)

        def rows(ids: pa.Array | None, names: list, refs: list) -> pa.RecordBatch:
            n = max(len(names), len(refs))
            return pa.record_batch([pa.nulls(n, kind) if ids is None else ids, pa.array(names or [None] * n, pa.string()), pa.array(refs or [None] * n, pa.binary())], names=["doc_id", "word", "refs"])

        for b in batches:
            kind, at, refs = b.column(0).type, 0, []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                refs.append(array("I", map(known.__getitem__, cut(text))).tobytes() if text else b"")
                full = len(known) > most
                if full or i + 1 == b.num_rows:
                    for k in range(0, len(new), 10_000):
                        yield rows(None, new[k : k + 10_000], [])
                    new.clear()
                    yield rows(b.column(0).slice(at, len(refs)), [], refs)
                    now = np.bincount(np.frombuffer(b"".join(refs), np.uint32), minlength=len(known))
                    now[: len(uses)] += uses
                    uses, at, refs = now, i + 1, []
                if full:
                    stay = np.sort(np.argsort(-uses, kind="stable")[: most // 2])
                    names = list(known)
                    known.clear()
                    known.update((names[k], n) for n, k in enumerate(stay.tolist()))
                    uses = uses[stay] // 2
                    yield rows(None, [""], [stay.astype("<u4").tobytes()])

    return run


class _Words:
    """Ids and bytes of numbered words; ids lie in one array."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.by_id = {r: t for t, r in ranks.items()}
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self.pieces: list[bytes] = []

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words by their ids, one after another, and how many ids each has."""
        self.ids.append(ids.astype(np.uint32))
        self.ends.append(np.cumsum(sizes) + self.ends[-1][-1])
        tokens, at = [self.by_id[k] for k in ids.tolist()], [0, *np.cumsum(sizes).tolist()]
        self.pieces += [b"".join(tokens[a:b]) for a, b in zip(at, at[1:])]  # noqa: B905

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        starts = self.ends[0][numbers]
        sizes = self.ends[0][numbers + 1] - starts
        return self.ids[0][np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes

    def only(self, numbers: np.ndarray) -> None:
        """Forgets all other words; these are numbered anew, in their order."""
        ids, sizes = self.ids_of(numbers)
        self.ids, self.ends = [ids], [np.concatenate(([0], np.cumsum(sizes)))]
        self.pieces = [self.pieces[k] for k in numbers.tolist()]


def _joiner(ranks: dict[bytes, int]):
    """Learns words from their rows and joins ids and bytes of the texts that refer to them."""

    def texts(doc_ids: pa.Array, refs: list[bytes], known: _Words) -> pa.RecordBatch:
        numbers = np.frombuffer(b"".join(refs), np.uint32).astype(np.int64)
        ids, sizes = known.ids_of(numbers)
        ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in refs])))
        offsets = (4 * np.concatenate(([0], np.cumsum(sizes)))[ends]).astype(np.int32)
        pieces = [b"".join(map(known.pieces.__getitem__, array("I", r))) for r in refs]
        coded = pa.Array.from_buffers(pa.binary(), len(refs), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
        return pa.record_batch([doc_ids, coded, pa.array(pieces, pa.binary())], names=["doc_id", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(ranks)
        for b in batches:
            doc_ids, refs, ids, names = (b.column(k) for k in range(4))
            at, named = refs.to_pylist(), names.to_pylist()
            kinds = ["text" if r is not None and n is None else "stay" if r is not None else "word" if n is None else "long" for r, n in zip(at, named, strict=True)]
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            i = 0
            while i < len(kinds):
                j = i + 1
                while j < len(kinds) and kinds[j] == kinds[i] and kinds[i] in ("text", "word"):
                    j += 1
                if kinds[i] == "text":
                    for k in range(i, j, 1000):
                        yield texts(doc_ids.slice(k, min(1000, j - k)), at[k : min(k + 1000, j)], known)
                elif kinds[i] == "word":
                    known.add(flat[ends[i] : ends[j]], np.diff(ends[i : j + 1]))
                elif kinds[i] == "long":
                    got = np.array(merged(named[i].encode("utf-8"), ranks))
                    known.add(got, np.array([len(got)]))
                else:
                    known.only(np.frombuffer(at[i], np.uint32).astype(np.int64))
                i = j

    return run


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: lowest rank first, leftmost first, from a heap of pairs over linked parts."""
    start, end = list(range(len(word))), list(range(1, len(word) + 1))
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(word) and (r := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(len(word) - 1):
        offer(i)
    live = [True] * len(word)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else len(word)
        if j >= len(word) or end[j] != stop:
            continue  # one of its parts has been merged with another
        end[i], live[j], after[i] = stop, False, after[j]
        if after[j] < len(word):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[start[i] : end[i]]] for i in range(len(word)) if live[i]]


def public_codec(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    return codec.encode(docs).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_codec(spark))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
