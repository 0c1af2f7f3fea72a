"""Token ids as one wavelet matrix per shard.

A shard is a run of documents in ascending doc_id order. Its image is one self-contained compressed file:

    b"SWM2" | head | 16 x (directory | u32 number of pieces | pieces), each frame u32 length | zstd

The head holds the counts, the documents' ids and their token counts. A plane is a bit per token in the order of
its level, packed and cut into pieces of ``PIECE`` bytes; its directory holds the ones before every 512 bits. So
``access``, ``rank`` and ``select`` (token access, counting, occurrence lookup) work on the compressed file: they
inflate the pieces that they touch, and no tokens are unpacked. Images are rows of a table
written by Spark (part, shard, tokens before the shard in its part, image), whose commit survives lost tasks.

The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks between ASCII
white space, one after another; each different chunk is encoded by the tokenizers library once per worker (which
remembers at most about ``CACHE`` of them). Chunks are found by 64-bit hashes and compared byte by byte; where two of
one hash differ, the texts around are encoded whole. Tests hold this against encoding whole texts.

Defined cases: null text is empty and has the end id only; order is by (doc_id with nulls first, a hash of the text),
so repeated rows and null ids have a place of their own; a document longer than a shard is a shard; texts are taken
whole; an empty table writes no shard and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.hashing import BLOCK, SPACE, located
from sievework.session import bound_batches, new_path, stored, table, written

END_ID = 2
BITS = 16
SHARD_TOKENS = 1 << 19
CACHE, CACHE_BYTES = 3_000_000, 1 << 28
BATCH_BYTES = 1 << 20
#: Chunks given to the library at once; its results are large.
BLOCK_CHUNKS = 4096
#: More parts than this are joined by a shuffle.
BROADCAST_PARTS = 500_000
_MAGIC = b"SWM2"
_BLOCK = 512
PIECE = 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """The bytes of a plane, inflated piece by piece when they are read."""

    def __init__(self, size: int, frames: list[bytes | memoryview]) -> None:
        import zstandard

        self.size, self.frames, self.z = size, frames, zstandard.ZstdDecompressor()
        self.inflated: dict[int, np.ndarray] = {}

    def _piece(self, k: int) -> np.ndarray:
        if k not in self.inflated:
            self.inflated[k] = np.frombuffer(self.z.decompress(self.frames[k]), np.uint8)
        return self.inflated[k]

    def __getitem__(self, at: int | slice) -> np.ndarray:
        if isinstance(at, int):
            return self._piece(at // PIECE)[at % PIECE]
        a, b, _ = at.indices(self.size)
        if a >= b:
            return np.zeros(0, np.uint8)
        first = a // PIECE
        got = [self._piece(k) for k in range(first, (b - 1) // PIECE + 1)]
        return (got[0] if len(got) == 1 else np.concatenate(got))[a - first * PIECE : b - first * PIECE]


class WaveletMatrix:
    """Sixteen bit-planes over a sequence of ids below 65,536."""

    def __init__(self, n: int, planes: list[np.ndarray] | list[Pieces], counts: list[np.ndarray]) -> None:
        self.n, self.planes, self.counts = n, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        a, planes, counts = ids.astype(np.uint16), [], []
        for level in reversed(range(BITS)):
            bit = (a & np.uint16(1 << level)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            counts.append(_directory(packed))
            a = np.concatenate((a[~bit], a[bit]))
        return cls(len(ids), planes, counts)

    @cached_property
    def zeros(self) -> list[int]:
        return [self.n - int(c[-1]) for c in self.counts]

    def ids(self) -> np.ndarray:
        """All ids, from the last plane to the first."""
        cur = np.zeros(self.n, np.uint16)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane[:], count=self.n).view(bool)
            up = np.empty_like(cur)
            up[~bit] = cur[:z]
            up[bit] = cur[z:] | np.uint16(1 << level)
            cur = up
        return cur

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _BLOCK
        part = self.planes[level][block * (_BLOCK // 8) : (i + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            ones -= int(part[-1] & ((1 << (8 - i % 8)) - 1)).bit_count()
        return int(self.counts[level][block]) + ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(BITS):
            ones = self._ones(level, i)
            bit = int(self.planes[level][i // 8] >> (7 - i % 8)) & 1
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(BITS):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (BITS - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences among the first ``i`` ids."""
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0)."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(BITS)):
            at = self._find(level, at - self.zeros[level], 1) if token >> (BITS - 1 - level) & 1 else self._find(level, at, 0)
        return at

    def _find(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th ``bit`` of a plane, by its directory."""
        c = self.counts[level].astype(np.int64)
        if not bit:
            c = np.minimum(np.arange(len(c)) * _BLOCK, self.n) - c
        block = int(np.searchsorted(c, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)])
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(c[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before every block of 512 bits, and of the whole plane."""
    size = _BLOCK // 8
    per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), size), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
    return np.concatenate((np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)))


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    w = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], bool)
    head = struct.pack("<QI", len(ids), len(doc_ids)) + np.packbits(known).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
    out = [_MAGIC, *_framed(z.compress(head))]
    for plane, counts in zip(w.planes, w.counts, strict=True):
        out += _framed(z.compress(counts.astype("<u4").tobytes()))
        pieces = [plane[k : k + PIECE].tobytes() for k in range(0, len(plane), PIECE)]
        out.append(struct.pack("<I", len(pieces)))
        for piece in pieces:
            out += _framed(z.compress(piece))
    return b"".join(out)


def _framed(data: bytes) -> list[bytes]:
    return [struct.pack("<I", len(data)), data]


def unpack(image: bytes | memoryview) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the documents' ids and their token counts."""
    import zstandard

    z, at = zstandard.ZstdDecompressor(), 4
    if bytes(image[:4]) != _MAGIC:
        raise ValueError("not a shard image")

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from("<I", image, at - 4)[0]

    def frame() -> memoryview:
        nonlocal at
        size = number()
        at += size
        return memoryview(image)[at - size : at]

    head = z.decompress(frame())
    n, docs = struct.unpack_from("<QI", head)
    k = 12 + (docs + 7) // 8
    known = np.unpackbits(np.frombuffer(head, np.uint8, k - 12, 12), count=docs)
    ids = np.frombuffer(head, "<i8", docs, k)
    lengths = np.frombuffer(head, "<u8", docs, k + 8 * docs).astype(np.int64)
    planes, counts = [], []
    for _ in range(BITS):
        counts.append(np.frombuffer(z.decompress(frame()), "<u4"))
        planes.append(Pieces((n + 7) // 8, [frame() for _ in range(number())]))
    return WaveletMatrix(n, planes, counts), [int(d) if ok else None for d, ok in zip(ids, known, strict=True)], lengths


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after another."""
    place = np.repeat((starts - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
    place += np.arange(len(place), dtype=np.int32)
    return values.take(place)


def _with(buffer: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``buffer`` with ``more`` from place ``used`` on; it doubles where it is too short."""
    while used + len(more) > len(buffer):
        buffer = np.concatenate((buffer, np.zeros_like(buffer)))
    buffer[used : used + len(more)] = more
    return buffer


class Encoder:
    """Ids of whole texts (UTF-8 bytes), as little-endian 16-bit integers, with the end id.

    Texts are hashed in blocks; a block's different chunks are looked up in a sorted array of hashes, new ones go to the library, and the block's ids are one gather. Hashes and the comparison of bytes
    take A-Z as a-z, as the tokenizer must do (that is checked); texts with the start of a special token's string, which
    it does not lower-case, are encoded directly.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("a little-endian machine is needed")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << BITS:
            raise ValueError("ids of at most 16 bits are supported")
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if any(one(c) != one(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") or one("a b\tc\nD") != [i for c in "abcd" for i in one(c)]:
            raise ValueError("a tokenizer is needed that lower-cases and drops white space")
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        # Sorted hashes and the number of each one's chunk; what a chunk is stands at its number, in order of arrival.
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.places, self.lengths, self.starts, self.sizes = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.store, self.used = np.zeros(1 << 16, "<u2"), 0  # ids
        self.own, self.owned = np.zeros(1 << 16, np.uint8), 0  # bytes

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        run: list[bytes] = []
        size = 0
        for t in texts:
            alone = len(t) >= BLOCK or b"<|" in t
            if run and (alone or size + len(t) + 1 > BLOCK):
                out += self._block(run)
                run, size = [], 0
            if alone:
                out.append(np.array([*self._direct(t), self.end_id], "<u2").tobytes())
            else:
                run.append(t)
                size += len(t) + 1
        return out + (self._block(run) if run else [])

    def _direct(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids

    def _block(self, texts: list[bytes]) -> list[bytes]:
        raw = b" ".join(texts)
        hashes, starts, ends = located(np.frombuffer(raw, np.uint8))
        which, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, which)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == which[known]
        if not known.all():
            new = first[~known]
            self._learn(which[~known], at[~known], [raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, which)
        chunk = self.row[at][back]
        if not self._same(raw, starts, ends, chunk):
            return [np.array([*self._direct(t), self.end_id], "<u2").tobytes() for t in texts]
        length = self.lengths[chunk]
        upto = np.cumsum(length)
        ids = _runs(self.store, self.places[chunk], length)
        bounds = np.cumsum([len(t) + 1 for t in texts])  # a text's words start before its bound
        cut = np.concatenate(([0], upto))[np.searchsorted(starts, bounds)].tolist()
        full = ids.tobytes()
        end = struct.pack("<H", self.end_id)
        got = [full[2 * i : 2 * j] + end for i, j in zip([0, *cut], cut, strict=False)]
        if len(self.keys) > CACHE or self.owned > CACHE_BYTES:
            self._clear()
        return got

    def _same(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> bool:
        """Whether every chunk's bytes are those of the chunk that it was taken for."""
        size = (ends - starts).astype(np.int32)
        if not np.array_equal(size, self.sizes[at]):
            return False
        data = np.frombuffer(raw, np.uint8)
        here = _LOWER[data[~SPACE[data]]]  # the chunks' bytes, one after another
        return bool((here == _runs(self.own, self.starts[at], size)).all())

    def _learn(self, keys: np.ndarray, at: np.ndarray, chunks: list[bytes]) -> None:
        pieces = []
        for i in range(0, len(chunks), BLOCK_CHUNKS):
            pieces += self._encode_chunks(chunks[i : i + BLOCK_CHUNKS])
        n, more = len(self.keys), len(chunks)
        lengths, sizes = np.array([len(x) for x in pieces], np.int32), np.array([len(c) for c in chunks], np.int32)
        ids, letters = np.concatenate(pieces), _LOWER[np.frombuffer(b"".join(chunks), np.uint8)]
        self.store, self.own = _with(self.store, self.used, ids), _with(self.own, self.owned, letters)
        self.places, self.lengths = _with(self.places, n, self.used + np.cumsum(lengths) - lengths), _with(self.lengths, n, lengths)
        self.starts, self.sizes = _with(self.starts, n, self.owned + np.cumsum(sizes) - sizes), _with(self.sizes, n, sizes)
        self.used, self.owned = self.used + len(ids), self.owned + len(letters)
        self.keys, self.row = np.insert(self.keys, at, keys), np.insert(self.row, at, np.arange(n, n + more, dtype=np.int32))

    def _encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Chunks in one call, a blank between them; a token belongs to the chunk in which it starts."""
        texts = [c.decode("utf-8") for c in chunks]
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(got.ids, "<u2")
        starts = np.array([a for a, _ in got.offsets], np.int64)
        cut = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
        return [ids[i:j] for i, j in zip([0, *cut], cut, strict=False)]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One per worker process, so what it knows serves all of its tasks."""
    return Encoder(path)


SHARDS = "part int, shard int, before long, n_tokens long, image binary"


def _writer(path: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        shard = before = tokens = 0
        pieces: list[bytes] = []
        ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, tokens, pieces, ids
            image = pack(np.frombuffer(b"".join(pieces), "<u2"), ids, [len(p) // 2 for p in pieces])
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([tokens], pa.int64()), pa.array([image], pa.binary())], names=["part", "shard", "before", "n_tokens", "image"])
            shard, before, tokens, pieces, ids = shard + 1, before + tokens, 0, [], []
            return out

        for doc_ids, texts in _groups(batches):
            for doc_id, coded in zip(doc_ids, encoder.encode(texts), strict=True):
                n = len(coded) // 2
                if pieces and tokens + n > shard_tokens:
                    yield flush()
                pieces.append(coded)
                ids.append(doc_id)
                tokens += n
        if pieces:
            yield flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in runs of about BATCH_BYTES of text."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(doc_id)
            texts.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Documents dealt by ranges of (doc_id, hash of the text), so a repeated id can't gather in one task."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written(dealt.mapInArrow(_writer(tokenizer_path, shard_tokens), SHARDS), path)


READ = "doc_id long, base long, n_tokens long, ids_crc32 long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            matrix, doc_ids, lengths = unpack(memoryview(image.as_buffer()))
            ids = matrix.ids().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "base", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: its start among all ids, token count and checksum.

    Starts need the sizes of the parts before: one row per part (a part is a task's output), summed up in order;
    within a part the writer has counted already, so images are never shuffled.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = stored(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")), "parts")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    if sizes.count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    placed = shards.join(offsets, "part").select((F.col("offset") + F.col("before")).alias("base"), "image")
    return placed.mapInArrow(_reader, READ).withColumnRenamed("base", "start")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_shards(spark, path)


QUERIES = {"op1_wavelet_tokens": op1_wavelet_tokens}
ORACLE_SQL: dict[str, str] = {}
