"""Best-fit packing in bulk-synchronous rounds.

Texts become ids (once per distinct word, see ``vocab``), end with a separator,
and texts beyond the sequence length are cut into full pieces and a rest. Pieces
are range-sorted by length, the longest first; a piece's place in that order is its
rank. Gaps (the sequences that still have room) are a relation of their own,
range-sorted by size in every round.

Pieces are taken in batches, whose lengths are within a factor of two. A round is
a superstep of two parts:

* Successor sweep: every unplaced piece of the batch looks for the smallest gap that
  holds it, the longest pieces first, and each gap takes one piece (or as many as fit
  whatever their lengths in the batch). Pieces that want one gap are told apart by
  rank: the first pieces of a length get the gaps of a size in the gaps' own order.
  The tasks that hold the gaps then give each gap its pieces and shrink it.
* Opening: of the pieces that no gap holds, the longest open new sequences, as many
  as fit in each, down to a share of the longest one's length (see ``OPENING``) or to where
  a gap just opened would do. Shorter ones wait for the next round's gaps.

Rounds repeat until the batch is placed. The driver sees counts only, of pieces by
length and of gaps by size, at most ``capacity`` of each; from these it works out which
ranks meet which gaps. Pieces, gaps and placements stay on the executors. A batch takes
a few rounds and halves the lengths, so rounds grow with the logarithm of the capacity
and not with the corpus.

Placements name ranks; they meet the pieces in one equality join by rank.

Defined results: a null text counts as empty and is one piece that holds only the
separator; very long texts are cut as any other; pieces of equal length are ranked by
row; repeated rows are packed each; null ids are carried through; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm.vocab import WordEncoder, opened
from rolloom.session import materialize, prepare

SEPARATOR = 1
#: Pieces open sequences together down to a share of the longest one's length: the nearer to 1, the fewer of them fit in a sequence.
OPENING = 0.7
#: Lengths up to which all that is left is one batch.
SMALL = 128
#: Gaps of a task: few while there are cores for more tasks, then many.
FEW_GAPS, TASK_GAPS = 20_000, 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, rid long"
RANKED = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long"
#: A gap has rank -1 and its size as value; a placement has a piece's rank and its offset as value.
STATE = "rank long, sequence_id long, value long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document with the CRC-32 of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = opened(WordEncoder, path), SEPARATOR.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            index, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(encoder.encode_all(t.as_py() for t in batch.column(1))):
                ids = found.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    index.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rows = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column(2).take(rows)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rid"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    return rows.mapInArrow(cut, PIECES)


def ranked_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with their rank, the longest first; equal lengths by row. Only counts of range partitions reach the driver."""
    rows = pieces.repartitionByRange(F.desc("length"), "rid", "piece").sortWithinPartitions(F.desc("length"), "rid", "piece")
    rows = materialize(rows).withColumn("part", F.spark_partition_id())
    counts = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    first, at = {}, 0
    for k in sorted(counts):
        first[k], at = at, at + counts[k]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            if b.num_rows:
                rank = first[b.column(6)[0].as_py()] + done + np.arange(b.num_rows)
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(rank, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "rank"])

    return rows.mapInArrow(numbered, RANKED)


class Lengths:
    """Lengths by rank: the steps of the sorted order, at most as many as the capacity."""

    def __init__(self, counts: dict[int, int]):
        self.values = np.array(sorted(counts, reverse=True), np.int64)
        self.starts = np.cumsum([0, *[counts[int(v)] for v in self.values]])[:-1].astype(np.int64)

    def of(self, ranks: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.starts, ranks, side="right") - 1]


Runs = list[tuple[int, int, int]]  # (length, first rank, end), the longest first


def meetings(gaps: dict[int, int], waiting: Runs) -> tuple[list[tuple[int, int, int, int]], Runs]:
    """Which ranks meet which gaps in a sweep: (gap size, first slot, first rank, n), and the runs that found none.

    gaps: how many gaps there are of each size. A gap of twice the longest length or more has a slot for
    each time that length fits, others have one.
    """
    longest, sizes, rules, rest, stack = waiting[0][0], sorted(gaps, reverse=True), [], [], []
    at = 0
    for length, rank, end in waiting:
        while at < len(sizes) and sizes[at] >= length:
            stack.append([sizes[at], 0, gaps[sizes[at]] * max(sizes[at] // longest, 1)])
            at += 1
        while rank < end and stack:
            top = stack[-1]
            n = min(end - rank, top[2] - top[1])
            rules.append((top[0], top[1], rank, n))
            rank, top[1] = rank + n, top[1] + n
            if top[1] == top[2]:
                stack.pop()
        if rank < end:
            rest.append((length, rank, end))
    return rules, rest


def openings(waiting: Runs, capacity: int, first: int) -> tuple[list[tuple[int, int, int]], np.ndarray, int, Runs]:
    """New sequences for the longest waiting pieces: blocks (first sequence, first piece, pieces a sequence), the
    waiting runs as rows (first piece, first rank), the end of the sequences, and the runs left."""
    longest, largest, chosen, rest = waiting[0][0], 0, [], []
    share = max(OPENING, 1 - capacity // longest / 20)
    for run in waiting:
        if not rest and (run[0] >= share * longest or run[0] > largest):
            chosen.append(run)
            largest = max(largest, capacity - capacity // run[0] * run[0])
        else:
            rest.append(run)
    starts = np.cumsum([0, *[b - a for _, a, b in chosen]])
    blocks, at = [], 0
    for (length, _, _), end in zip(chosen, starts[1:].tolist(), strict=True):
        while at < end:
            each = capacity // length
            full = (end - at) // each
            blocks.append((first, at, each))
            first, at = first + max(full, 1), at + max(full, 1) * each
    table = np.array([(s, a) for s, (_, a, _) in zip(starts.tolist(), chosen)], np.int64)
    return blocks, np.vstack([table, [[int(starts[-1]), 0]]]), first, rest


def _state(ranks: np.ndarray, sequences: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(sequences, pa.int64()), pa.array(values, pa.int64())], names=["rank", "sequence_id", "value"])


def _filled(sequences: np.ndarray, gaps: np.ndarray, owner: np.ndarray, ranks: np.ndarray, lengths: Lengths, capacity: int) -> Iterator[pa.RecordBatch]:
    """Placements of pieces (ranks, ordered by owner, a place in sequences) and the gaps that they leave."""
    sizes = lengths.of(ranks)
    ends = np.cumsum(sizes)
    used = np.bincount(owner, weights=sizes, minlength=len(gaps)).astype(np.int64)
    before = np.cumsum(used) - used
    yield _state(ranks, sequences[owner], capacity - gaps[owner] + ends - sizes - before[owner])
    yield _state(np.full(len(gaps), -1), sequences, gaps - used)


def swept(gaps: DataFrame, rules: list, longest: int, first: dict[tuple[int, int], int], lengths: Lengths, capacity: int) -> DataFrame:
    """One sweep over range-sorted gaps. first: the number of gaps of a size in earlier partitions."""
    span = 1 << 48
    table = np.array(sorted(rules), np.int64)
    keys = table[:, 0] * span + table[:, 1]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            sequences, sizes, part = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)[0].as_py()
            at = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]])
            base = np.array([first[part, int(s)] for s in sizes[at]])
            if sizes[0] == last:
                base[0] += seen
            place = np.repeat(base - at, np.diff(np.r_[at, len(sizes)])) + np.arange(len(sizes))
            seen, last = int(place[-1]) + 1 - first[part, int(sizes[-1])], int(sizes[-1])
            slots = np.maximum(sizes // longest, 1)
            owner = np.repeat(np.arange(len(sizes)), slots)
            slot = place[owner] * slots[owner] + np.arange(len(owner)) - (np.cumsum(slots) - slots)[owner]
            rule = table[np.maximum(np.searchsorted(keys, sizes[owner] * span + slot, side="right") - 1, 0)]
            hit = (rule[:, 0] == sizes[owner]) & (slot >= rule[:, 1]) & (slot < rule[:, 1] + rule[:, 3])
            yield from _filled(sequences, sizes, owner[hit], (rule[:, 2] + slot - rule[:, 1])[hit], lengths, capacity)

    return gaps.select("sequence_id", "value", F.spark_partition_id().alias("part")).mapInArrow(sweep, STATE)


def opened_sequences(spark: SparkSession, blocks: list, runs: np.ndarray, start: int, end: int, lengths: Lengths, capacity: int) -> DataFrame:
    """Sequences ``start`` to ``end`` with the pieces that open them."""
    table, n = np.array(blocks, np.int64), int(runs[-1, 0])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequences = b.column(0).to_numpy()
            block = table[np.searchsorted(table[:, 0], sequences, side="right") - 1]
            at = block[:, 1] + (sequences - block[:, 0]) * block[:, 2]
            count = np.minimum(block[:, 2], n - at)
            owner = np.repeat(np.arange(len(sequences)), count)
            piece = at[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            run = runs[np.searchsorted(runs[:, 0], piece, side="right") - 1]
            yield from _filled(sequences, np.full(len(sequences), capacity), owner, run[:, 1] + piece - run[:, 0], lengths, capacity)

    return spark.range(start, end, 1, -(-(end - start) // TASK_GAPS)).mapInArrow(fill, STATE)


def _sizes(gaps: DataFrame) -> DataFrame:
    """part, value, n: how many gaps of a size each partition of the range-sorted gaps holds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for b in batches:
            for v, n in zip(*np.unique(b.column(0).to_numpy(), return_counts=True), strict=True):
                key = (b.column(1)[0].as_py(), int(v))
                found[key] = found.get(key, 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([v for _, v in found], pa.int64()), pa.array(found.values(), pa.int64())], names=["part", "value", "n"])

    return gaps.select("value", F.spark_partition_id().alias("part")).mapInArrow(counted, "part int, value long, n long")


def placements(spark: SparkSession, counts: dict[int, int], capacity: int) -> list[DataFrame]:
    """The rounds: together they hold the placement of every piece (and gaps, with rank -1), given how many pieces there are of each length."""
    lengths, least = Lengths(counts), min(counts)
    runs = [(int(v), int(s), int(s) + counts[int(v)]) for v, s in zip(lengths.values, lengths.starts, strict=True)]
    gaps: DataFrame | None = None
    out: list[DataFrame] = []
    sizes: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    at, sequences = 0, 0

    def settled(rows: DataFrame) -> DataFrame:
        """Open gaps, range-sorted; and their counts, from which the driver knows the first of each size in each partition."""
        n = max(min(spark.sparkContext.defaultParallelism, -(-sequences // FEW_GAPS)), -(-sequences // TASK_GAPS))
        rows = rows.where((F.col("rank") < 0) & (F.col("value") >= least)).select("sequence_id", "value")
        rows = rows.repartitionByRange(n, "value", "sequence_id") if n > 1 else rows.coalesce(1)
        rows = materialize(rows.sortWithinPartitions("value", "sequence_id"))
        sizes.clear()
        first.clear()
        for r in sorted(_sizes(rows).collect(), key=lambda r: r.part):
            first[r.part, r.value] = sizes.get(r.value, 0)
            sizes[r.value] = sizes.get(r.value, 0) + r.n
        return rows

    while at < len(runs):
        low = (runs[at][0] + 1) // 2 if runs[at][0] > SMALL else 1
        waiting = []
        while at < len(runs) and runs[at][0] >= low:
            waiting.append(runs[at])
            at += 1
        while waiting:
            longest, step = waiting[0][0], []
            rules, rest = meetings({k: n for k, n in sizes.items() if k >= waiting[-1][0]}, waiting)
            if rules:
                step.append(swept(gaps, rules, longest, dict(first), lengths, capacity))
            elif gaps is not None:
                step.append(gaps.select(F.lit(-1).cast("long").alias("rank"), "sequence_id", "value"))
            if rest:
                start = sequences
                blocks, table, sequences, rest = openings(rest, capacity, sequences)
                step.append(opened_sequences(spark, blocks, table, start, sequences, lengths, capacity))
            out += step if rules or gaps is None else step[1:]
            waiting = rest
            if waiting or at < len(runs):
                gaps = settled(reduce(DataFrame.unionByName, step))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = prepare(docs.sparkSession)
    pieces = materialize(cut_pieces(docs, path, capacity, id_col, text_col))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = ranked_pieces(pieces)
    if not counts:
        return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").alias("sequence_id"), F.col("rank").alias("offset"))
    placed = reduce(DataFrame.unionByName, placements(spark, counts, capacity)).where("rank >= 0")
    return ranked.join(placed, "rank").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("value").alias("offset"))
