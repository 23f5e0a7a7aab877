"""Sharding by minimax contiguous partition (DataFrame operations only).

Rows with equal texts form an atomic group. The groups are put in the order of
their MD5, and the order is cut into at most ``n_shards`` contiguous runs so that
the largest run is as small as it can be. The smallest feasible capacity is found
by binary search, where each trial fills shards greedily; then the order is cut
at the places of the last successful trial.

The order is never collected. The driver sees sums over key prefixes (4,096 to
begin with) and asks for finer prefixes only where a cut can fall: a cut of the
true greedy run lies between the cut of a run that may cut inside a prefix and
the cut of one that may not. Each round multiplies the resolution by 256, and
the rounds end as soon as both runs agree, which proves the capacity minimal.

The order has groups larger than an even share at its end, by size (at most
``n_shards - 1`` such groups exist); each is a run of its own. A capacity that holds such a
group says nothing of the other shards, so these are cut for the smallest capacity of their
own: one hot text does not leave them uneven.

Defined results: a null text counts as an empty text (size 1, CRC 0, one group
with the empty ones); repeated rows each get a slot; null ids are carried
through; very long texts are sized whole; groups of one size go by their MD5, so ties have one
order; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rolloom.session import materialize, prepare

#: Hex digits of the first round's prefixes, and those added in each later round.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows of a ranking cell: slots are counted per cell, so no task ranks a whole shard.
CELL_ROWS = 50_000


def _walk(ends: np.ndarray, atomic: np.ndarray, capacity: int, k: int, split: bool) -> list[int]:
    """Positions in bytes after each of k greedy shards. split: inner parts of a prefix may be cut off."""
    at, out = 0, []
    for _ in range(k):
        limit = at + capacity
        i = int(np.searchsorted(ends, limit, side="right"))
        reach = int(ends[i - 1]) if i else 0
        if split and i < len(ends) and not atomic[i]:
            reach = limit
        at = max(at, reach)
        out.append(at)
    return out


def _smallest(ends: np.ndarray, atomic: np.ndarray, k: int, split: bool) -> int:
    total = int(ends[-1])
    low, high = max(1, -(-total // k)), total
    while low < high:
        mid = (low + high) // 2
        if _walk(ends, atomic, mid, k, split)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, k: int, key: str = "group_key", size: str = "bytes") -> tuple[int, list[str]]:
    """Smallest capacity of k contiguous shards, and the first key after each cut (at most k - 1).

    ``groups`` has one row per atomic group, with hex keys of 32 digits.
    """

    def sums(width: int, inside: list[str] | None) -> list[tuple[str, int, bool]]:
        rows = groups
        if inside is not None:
            wanted = groups.sparkSession.createDataFrame([(p,) for p in inside], "_prefix string")
            rows = rows.join(F.broadcast(wanted), F.substring(key, 1, len(inside[0])) == F.col("_prefix"), "left_semi")
        found = rows.groupBy(F.substring(key, 1, width).alias("p")).agg(F.sum(size).alias("b"), F.count("*").alias("n"))
        return [(r.p, r.b, r.n == 1) for r in found.collect()]

    width = FIRST_DIGITS
    parts = sorted(sums(width, None))
    if not parts:
        return 0, []
    while True:
        ends = np.cumsum(np.array([b for _, b, _ in parts], dtype=np.int64))
        atomic = np.array([a for _, _, a in parts])
        low, high = _smallest(ends, atomic, k, True), _smallest(ends, atomic, k, False)
        first, last = _walk(ends, atomic, low, k, False), _walk(ends, atomic, high, k, True)
        starts = ends - np.array([b for _, b, _ in parts])
        fine: set[int] = set()
        for a, b in zip(first, last, strict=True):
            fine.update(np.flatnonzero((ends > a) & (starts <= b) & ~atomic).tolist())
        if low == high or not fine or width >= 32:
            break
        by_width: dict[int, list[str]] = {}
        for i in fine:
            by_width.setdefault(len(parts[i][0]), []).append(parts[i][0])
        new = [p for i, p in enumerate(parts) if i not in fine]
        for w, inside in by_width.items():
            new += sums(w + MORE_DIGITS, inside)
        parts, width = sorted(new), width + MORE_DIGITS
    total, cuts = int(ends[-1]), []
    for at in _walk(ends, atomic, high, k, False)[:-1]:
        if at < total:
            cuts.append(parts[int(np.searchsorted(ends, at, side="right"))][0])
    return high, cuts


def slots(rows: DataFrame, shard: str, rid: str) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, without sorting a shard in one task.

    ``rid`` is unique and must already be materialised. Rows fall into cells by
    its hash; the counts of cells give offsets, and ranks are taken inside cells.
    """
    cells = max(16, -(-rows.count() // CELL_ROWS))  # as if all rows were in one shard
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(rid), F.lit(cells)))
    counts = rows.groupBy(shard, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(rid)) - 1)
    return ranked.join(offsets, [shard, "_cell"]).withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).drop("_cell", "_rank", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("group_key"), F.monotonically_increasing_id().alias("_rid"),
    ))
    groups = materialize(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    left, k, giants = total, n_shards, []
    for r in groups.orderBy(F.desc("bytes"), "group_key").limit(n_shards - 1).collect():
        if k > 1 and r.bytes * k >= left:
            giants.append(r.group_key)
            left, k = left - r.bytes, k - 1
        else:
            break
    rest = groups.where(~F.col("group_key").isin(giants)) if giants else groups
    _, cuts = minimax_cuts(rest, k)
    shard: Column = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("group_key") >= cut, 1).otherwise(0)
    for i, key in enumerate(giants):
        shard = F.when(F.col("group_key") == key, n_shards - 1 - i).otherwise(shard)
    out = slots(rows.withColumn("shard", shard.cast("int")), "shard", "_rid")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
