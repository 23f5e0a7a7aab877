"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Inputs of a score are the text's distinct words (hashed into ``BUCKETS`` places, with
equal weights of unit length together), statistics of its structure, and its
length. Labels, language, source and id are never inputs. Every pair of inputs
interacts through low-rank factors, and the sum over pairs takes time linear in
the inputs: half of (sum v x)^2 minus the sum of (v x)^2, for each factor.

Training uses at most ``max_rows`` labelled rows, those with the smallest hash of
their id (a fixed, documented bound), and AdaGrad on the logistic loss on the
driver. Scoring needs one pass and no shuffle; the model is broadcast and has a
fixed size.

Defined results: null texts count as empty and get a score like any text; a null id
is never held out and never trains; of repeated ids one row trains; labels that
are null or contradict each other within an id do not train; without labels of
both kinds every score is the share of label 1 (0.5 without any); very long texts count
whole; equal texts have equal scores, so ties need no order; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.session import prepare

BUCKETS, RANK, STATISTICS = 1 << 14, 4, 11
MAX_ROWS = 6_000
TABLE_SIZE = 300_000
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:!?"

_buckets: dict[bytes, int] = {}


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def inputs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the statistics, each in about 0 to 1."""
    data = (text or "").encode()
    words = data.lower().split()
    counts = Counter(words)
    if len(_buckets) > TABLE_SIZE:
        _buckets.clear()
    found = []
    for w in counts:
        b = _buckets.get(w)
        if b is None:
            b = _buckets[w] = zlib.crc32(w) % BUCKETS
        found.append(b)
    size, n = max(len(data), 1), max(len(words), 1)
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    stats = [
        1.0, np.log1p(len(data)) / 12, np.log1p(n) / 10, min(sum(map(len, words)) / n / 20, 3), share(SYMBOLS) ** 0.5, share(UPPER) ** 0.5, share(DIGITS) ** 0.5, share(MARKS) ** 0.5,
        1 - len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1),
    ]
    return np.array(found, dtype=np.int32), np.array(stats, dtype=np.float32)


class Machine:
    """Weights w and factors v; statistics come after the buckets."""

    def __init__(self, prior: float = 0.5, seed: int = 7):
        size = BUCKETS + STATISTICS
        self.bias = float(np.log(prior / (1 - prior)))
        self.w = np.zeros(size, np.float64)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, RANK))
        self.fixed: float | None = None

    @staticmethod
    def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b) + STATISTICS for b, _ in rows])
        tail = BUCKETS + np.arange(STATISTICS)
        index = np.concatenate([np.concatenate([b, tail]) for b, _ in rows])
        value = np.concatenate([np.concatenate([np.full(len(b), 1 / np.sqrt(max(len(b), 1))), s]) for b, s in rows])
        return index, value, np.r_[0, np.cumsum(lengths)[:-1]]

    def _raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + pairs, sums, vx

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows or self.fixed is not None:
            return np.full(len(rows), 0.5 if self.fixed is None else self.fixed)
        raw, _, _ = self._raw(*self._flat(rows))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 11) -> Machine:
        rng, gw, gv = np.random.default_rng(seed), np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                chosen = order[at : at + batch]
                index, value, starts = self._flat([rows[i] for i in chosen])
                raw, sums, vx = self._raw(index, value, starts)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
                each = np.repeat(error, np.diff(np.r_[starts, len(index)]))
                row = np.repeat(np.arange(len(chosen)), np.diff(np.r_[starts, len(index)]))
                unique, where = np.unique(index, return_inverse=True)
                dw = np.bincount(where, weights=each * value) + decay * self.w[unique]
                slope = (each * value)[:, None] * (sums[row] - vx)
                dv = np.stack([np.bincount(where, weights=slope[:, f]) for f in range(RANK)], axis=1) + decay * self.v[unique]
                gw[unique] += dw**2
                gv[unique] += dv**2
                self.w[unique] -= rate * dw / np.sqrt(gw[unique])
                self.v[unique] -= rate * dv / np.sqrt(gv[unique])
        return self


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """A machine fitted on at most ``max_rows`` labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [inputs(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["doc_id", "y", "words", "stats"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int"))
    rows = rows.mapInArrow(prepared, "doc_id long, y int, words binary, stats binary").groupBy("doc_id").agg(F.min(F.struct("words", "stats", "y")).alias("x"))
    got = sorted(rows.collect(), key=lambda r: r.doc_id)
    y = np.array([r.x.y for r in got], dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    machine = Machine(min(max(prior, 0.02), 0.98))
    if len(set(y)) < 2:
        machine.fixed = prior
        return machine
    return machine.fit([(np.frombuffer(r.x.words, np.int32), np.frombuffer(r.x.stats, np.float32)) for r in got], y)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, **options))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            score = []
            for at in range(0, b.num_rows, 256):
                score.append(machine.scores([inputs(t) for t in b.column(2).slice(at, 256).to_pylist()]))
            score = np.concatenate(score) if score else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
