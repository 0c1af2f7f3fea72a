"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text; a preference pair (a document of label 1 over one of label
0) has the logistic probability of the difference of their strengths, so the weights come from logistic loss on
feature differences. Strengths become probabilities by a logistic fit on the same labelled rows. ``quantile_cut``
gives the score below which a stated share of the labelled good documents of the training side lies.

Nothing is sampled: means, weights, calibration and quantile come from passes over all labelled rows of the training
side, whose features are stored once, and the loss is that of all pairs of a good and a bad row. A pair's loss depends
on the difference of two strengths alone, so a pass spreads each row over the ``NODES`` nearest nodes of a grid of
strengths (Lagrange interpolation), and the driver sums over pairs of nodes instead of pairs of rows. The nodes replace
the logistic function by a polynomial that is off by less than 1e-7; a quantile is exact. A pass takes at most ``TASKS``
tasks, each of which sends the driver one sum per node. Inputs of a score are features of the text alone.

Defined cases: null and empty texts have the features of no words and get a score like any other; labels that are
null or on unknown documents are ignored; of several labels of a document the lowest counts; without labels of both
kinds nothing can be learnt and every score is 0.5; null doc_id counts as remainder -1 (not held out, never a
training row); repeated rows get a row each; texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.bounded import BROADCAST_KEYS, at_most
from sievework.session import bound_batches, stored, table

#: Spacing of the grid of strengths, and the nodes a strength is spread over.
STEP, NODES = 0.25, 10
#: Tasks of a pass over the labelled rows.
TASKS = 64
#: Bits of a score that a pass of ``quantile_cut`` settles: five passes.
DIGIT = 13
HELD_OUT = 2
PREDICT_AT = 0.7
L2 = 1e-3

_SYMBOLS = b"#*$%&|<>!@^~=+{}[]_\\/"
_STOPS = b".,;:?'\"()-"
_DIGITS = b"0123456789"
FEATURES = ("log_words", "symbols", "stops", "digits", "upper_words", "adjacent_repeats", "repeats", "top_word", "symbol_words", "word_chars", "repeated_lines", "empty")


def features(text: bytes) -> list[float]:
    """Shares of symbols, capitals and repeats in a text, squashed so that a small share already shows."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    size = len(text)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    strs = text.decode("utf-8").split()
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    root = lambda x: min(x, 1.0) ** 0.5
    return [
        min(float(np.log1p(n)), 8.0),
        root(share(_SYMBOLS)),
        root(share(_STOPS)),
        root(share(_DIGITS)),
        root(sum(map(str.isupper, strs)) / max(len(strs), 1)),
        root(sum(map(eq, words, words[1:])) / n),
        1 - len(counts) / n,
        root(max(counts.values()) / n),
        root(sum(not any(map(str.isalnum, w)) for w in set(strs)) / len(counts)),
        min(size / n, 40.0) / 10,
        root(1 - len(set(lines)) / len(lines)),
        0.0,
    ]


Sums = dict[tuple[int, int], np.ndarray]
#: From features and labels of some rows to keyed sums over them.
Task = Callable[[np.ndarray, np.ndarray], Sums]


def _added(parts: Iterator[Sums]) -> Sums:
    out: Sums = {}
    for part in parts:
        for key, v in part.items():
            out[key] = out[key] + v if key in out else v
    return out


class Rows:
    """Labelled rows in memory, passed over as often as a fit needs."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = x, label

    def total(self, task: Task) -> Sums:
        return task(self.x, self.label)


class StoredRows(Rows):
    """Labelled rows of a stored frame (quality, x); each task adds up its own rows."""

    def __init__(self, frame: DataFrame):
        self.frame = frame.coalesce(TASKS)

    def total(self, task: Task) -> Sums:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _added(task(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), b.column(0).to_numpy()) for b in batches if b.num_rows)
            kind, place = ([key[i] for key in got] for i in (0, 1))
            yield pa.record_batch([pa.array(kind, pa.int64()), pa.array(place, pa.int64()), pa.array([v.tobytes() for v in got.values()], pa.binary())], names=["kind", "place", "sums"])

        rows = self.frame.mapInArrow(each, "kind long, place long, sums binary").collect()
        return _added({(r.kind, r.place): np.frombuffer(r.sums)} for r in rows)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    rows: Rows | None = None  # all labelled rows of the training side

    def plain(self) -> Model:
        """Without the rows, as tasks take it."""
        return replace(self, rows=None)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.strengths(x) + self.offset, -40, 40)))

    def quantile_cut(self, share: float, most: float = 0.5) -> float:
        """The ``share``-quantile of the scores of all good rows (between neighbours linear), at most ``most``."""
        if self.rows is None:
            return 0.0
        model, heads, ranks, part = self.plain(), [0, 0], [], 0.0
        # The bits of positive floats are in their order: the two neighbours' are found digit by digit, by counting.
        for shift in range(4 * DIGIT, -1, -DIGIT):

            def counts(x: np.ndarray, label: np.ndarray, shift: int = shift, heads: tuple[int, ...] = tuple(heads)) -> Sums:
                bits = model.scores(x[label == 1]).view(np.int64) >> shift
                return {(0, i): np.bincount(bits[bits >> DIGIT == h] & (1 << DIGIT) - 1, minlength=1 << DIGIT).astype(float) for i, h in enumerate(heads)}

            got = self.rows.total(counts)
            below = [np.cumsum(got[0, i]).astype(int) for i in (0, 1)]
            if not ranks:
                last = int(below[0][-1]) - 1
                ranks = [int(share * last), min(int(share * last) + 1, last)]
                part = share * last - ranks[0]
            for i in (0, 1):
                digit = int(np.searchsorted(below[i], ranks[i], side="right"))
                ranks[i] -= int(below[i][digit - 1]) if digit else 0
                heads[i] = heads[i] << DIGIT | digit
        low, high = np.array(heads).view(np.float64)
        return float(min(low + (high - low) * part, most))


def _newton(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], k: int, steps: int = 60) -> np.ndarray:
    """The minimum of a convex function given with gradient and Hessian, damped; rounded beyond what the order of sums changes."""
    beta = np.zeros(k)
    loss, grad, hess = evaluate(beta)
    for _ in range(steps):
        step, t = np.linalg.solve(hess + 1e-9 * np.eye(k), grad), 1.0
        if np.abs(step).max() < 1e-6:
            beta = beta - step
            break
        new = evaluate(beta - step)
        while t > 1e-6 and new[0] > loss + 1e-8:
            t /= 2
            new = evaluate(beta - t * step)
        beta, (loss, grad, hess) = beta - t * step, new
    return np.round(beta, 9)


_NEAR = np.arange(NODES) - (NODES // 2 - 1)


def _spread(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the grid and the weights of the nodes around them, for places in units of ``STEP``."""
    cell = np.floor(at)
    away = (at - cell)[:, None] - _NEAR
    weights = [np.delete(away, j, 1).prod(axis=1) / np.delete(_NEAR[j] - _NEAR, j).prod() for j in range(NODES)]
    return cell.astype(np.int64), np.column_stack(weights)


def _on_nodes(model: Model) -> Task:
    """Per label and node, sums of 1, z and z z' (the upper triangle of (1, z) (1, z)')."""

    def task(x: np.ndarray, label: np.ndarray) -> Sums:
        z = (x - model.mean) / model.scale
        v = np.column_stack((np.ones(len(z)), z))
        i, j = np.triu_indices(v.shape[1])
        squares, out = v[:, i] * v[:, j], {}
        cell, weights = _spread(model.strengths(x) / STEP)
        for q in (0, 1):
            mine = np.flatnonzero(label == q)
            mine = mine[np.argsort(cell[mine], kind="stable")]
            cells, starts = np.unique(cell[mine], return_index=True)
            for c, rows in zip(cells.tolist(), np.split(mine, starts[1:]), strict=False):
                for near, sums in zip(_NEAR.tolist(), weights[rows].T @ squares[rows], strict=True):
                    key = (q, c + near)
                    out[key] = out[key] + sums if key in out else sums
        return out

    return task


def _pair_loss(sums: Sums, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs with the ridge term, its gradient and Hessian, from sums on nodes."""
    k = len(weights)
    place = {q: np.array(sorted(c for kind, c in sums if kind == q)) for q in (0, 1)}
    good, bad = (np.array([sums[q, c] for c in place[q].tolist()]) for q in (1, 0))

    def square(v: np.ndarray) -> np.ndarray:
        m = np.zeros((k + 1, k + 1))
        m[np.triu_indices(k + 1)] = v
        return (m + np.triu(m, 1).T)[1:, 1:]

    loss, grad, hess = 0.0, np.zeros(k), np.zeros((k, k))
    for at in range(0, len(good), 256):  # pairs of nodes in blocks
        g = good[at : at + 256]
        behind = (place[0][None, :] - place[1][at : at + 256, None]) * STEP
        p = np.exp(-np.logaddexp(0, -behind))
        w = p * np.exp(-np.logaddexp(0, behind))
        loss += g[:, 0] @ np.logaddexp(0, behind) @ bad[:, 0]
        grad += (g[:, 0] @ p) @ bad[:, 1 : k + 1] - (p @ bad[:, 0]) @ g[:, 1 : k + 1]
        cross = g[:, 1 : k + 1].T @ w @ bad[:, 1 : k + 1]
        hess += square((w @ bad[:, 0]) @ g) + square((g[:, 0] @ w) @ bad) - cross - cross.T
    pairs = good[:, 0].sum() * bad[:, 0].sum()
    return loss / pairs + 0.5 * L2 * float(weights @ weights), grad / pairs + L2 * weights, hess / pairs + L2 * np.eye(k)


def _calibration(model: Model, stands: dict[int, float], ab: np.ndarray) -> Task:
    """Weighted logistic loss of slope and offset over strengths, its gradient and Hessian."""

    def task(x: np.ndarray, label: np.ndarray) -> Sums:
        s = np.column_stack((model.strengths(x), np.ones(len(x))))
        w, m = np.where(label == 1, stands[1], stands[0]), s @ ab
        p = np.exp(-np.logaddexp(0, -m))
        return {(0, 0): np.concatenate(([w @ (np.logaddexp(0, m) - label * m)], (w * (p - label)) @ s, ((s * (w * p * (1 - p))[:, None]).T @ s).ravel()))}

    return task


def _fitted(rows: Rows, k: int, totals: dict[int, int] | None = None) -> Model:
    got = rows.total(lambda x, label: {(q, 0): np.append(x[label == q].sum(axis=0), (label == q).sum().astype(float)) for q in (0, 1)})
    n = {q: float(got[q, 0][k]) if (q, 0) in got else 0.0 for q in (0, 1)}
    if not n[0] or not n[1]:
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0)
    mean = np.round((got[0, 0] + got[1, 0])[:k] / (n[0] + n[1]), 12)
    scale = np.round(np.sqrt(rows.total(lambda x, _: {(0, 0): ((x - mean) ** 2).sum(axis=0)})[0, 0] / (n[0] + n[1])), 12)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(k), 0.0, 0.0)
    model = replace(model, weights=_newton(lambda w: _pair_loss(rows.total(_on_nodes(replace(model, weights=w))), w), k))
    stands = {q: totals[q] / n[q] if totals else 1.0 for q in (0, 1)}
    ridge, whole = np.array([1e-4, 0.0]), sum(stands[q] * n[q] for q in (0, 1))

    def loss(ab: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = rows.total(_calibration(model, stands, ab))[0, 0] / whole
        return v[0] + 0.5 * float(ridge @ (ab * ab)), v[1:3] + ridge * ab, v[3:].reshape(2, 2) + np.diag(ridge)

    slope, offset = _newton(loss, 2)
    return replace(model, slope=float(slope), offset=float(offset), rows=rows)


def fit(x: np.ndarray, label: np.ndarray, totals: dict[int, int]) -> Model:
    """The model of rows in memory that stand for ``totals`` rows of each label."""
    return _fitted(Rows(x, label), x.shape[1] if x.ndim == 2 else len(FEATURES), totals)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[b.schema.names[0], "x"])


def remainder(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    bound_batches(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(~remainder().isin(-1, HELD_OUT))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    known, texts = stored(known, "known-labels"), docs.select("doc_id", "text")
    if at_most(known, BROADCAST_KEYS):
        x = texts.join(F.broadcast(known), "doc_id").select("quality", "text").mapInArrow(_feature_rows, "quality int, x array<double>")
    else:  # features travel, not texts
        x = texts.where(~remainder().isin(-1, HELD_OUT)).mapInArrow(_feature_rows, "doc_id long, x array<double>").join(known, "doc_id").select("quality", "x")
    return _fitted(StoredRows(stored(x, "labelled")), len(FEATURES))


def _scorer(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(b.num_columns - 1)], float)
            got = model.scores(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], names=[*b.schema.names[:-1], name])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns (one called ``name`` is replaced) and the score of each document as ``name``, without a shuffle."""
    bound_batches(docs.sparkSession)
    d = docs.select(*(F.col(f"`{k}`") for k in keep if k != name), F.col("text").alias("_scored_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(_scorer(model.plain(), name), f"{kinds}, `{name}` double")


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    )


QUERIES = {"op4_pairwise_quality": op4_pairwise_quality}
ORACLE_SQL: dict[str, str] = {}
