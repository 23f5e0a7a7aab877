"""Streams of rollouts and step metrics.

Keyed state is per partition id (a queue) or per stream name (a budget), so state
stays bounded: a queue holds at most its capacity, a budget a few numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


@dataclass
class BoundedQueue:
    """A queue that drops its oldest entry when full."""

    capacity: int
    produced: int = 0
    consumed: int = 0
    dropped: int = 0
    items: deque = field(default_factory=deque)

    def put(self, item: object) -> bool:
        """False if an older entry had to go."""
        self.produced += 1
        full = len(self.items) >= self.capacity
        if full:
            self.items.popleft()
            self.dropped += 1
        self.items.append(item)
        return not full

    def take(self, n: int) -> list | None:
        """n entries once there are as many, else None."""
        if len(self.items) < n:
            return None
        self.consumed += n
        return [self.items.popleft() for _ in range(n)]


def queue_batches(stream: DataFrame, partition: str, item: str, order: str, capacity: int, n: int) -> DataFrame:
    """Emits partition, batch, items whenever n entries of a partition are there; older entries beyond the capacity are dropped and counted."""
    out = f"{partition} string, batch long, items array<long>, produced long, dropped long"
    state = "items array<long>, produced long, consumed long, dropped long"

    def step(key: tuple, pdfs: Iterable[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        q = BoundedQueue(capacity)
        if s.exists:
            items, q.produced, q.consumed, q.dropped = s.get
            q.items.extend(items)
        rows = []
        for x in pd.concat(list(pdfs)).sort_values(order, kind="stable")[item]:
            q.put(int(x))
            if (got := q.take(n)) is not None:
                rows.append((key[0], q.consumed // n, got, q.produced, q.dropped))
        s.update((list(q.items), q.produced, q.consumed, q.dropped))
        yield pd.DataFrame(rows, columns=[partition, "batch", "items", "produced", "dropped"])

    return stream.groupBy(partition).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def running_totals(stream: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Budget counters as a complete-mode aggregate: built-in state, no Python."""
    return stream.groupBy(key).agg(*[F.sum(c).alias(f"total_{c}") for c in counters])


def windowed(stream: DataFrame, ts: str, value: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of event-time windows with a watermark; later rows are dropped."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


@dataclass
class StalenessBudget:
    """How many samples may be made before the next parameter sync."""

    required: int
    threshold: float
    sync_step: int = 1
    made: int = 0

    @property
    def limit(self) -> int:
        return int(self.required * (self.threshold + 1) * self.sync_step)

    def add(self, n: int = 1) -> bool:
        """Counts samples; True while making more is allowed."""
        self.made += n
        return self.made < self.limit

    def synced(self, pending: int = 0) -> None:
        """A new version: only what is still in flight counts."""
        self.made = pending


def enough(status: DataFrame, n: int, key: str = "status") -> DataFrame:
    """Whether n prompts are finished, with the number in each state."""
    return status.agg(*[F.count_if(F.col(key) == s).alias(s) for s in ("pending", "running", "finished", "failure")], (F.count_if(F.col(key) == "finished") >= n).alias("ready"))


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives every sink each batch once cached."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return write


def file_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One JSON folder per epoch: a repeated epoch overwrites itself."""
    return lambda batch, epoch: batch.write.mode("overwrite").json(f"{path}/epoch={epoch}")


def console_sink(rows: int = 20) -> Callable[[DataFrame, int], None]:
    return lambda batch, epoch: print(f"step:{epoch} - " + " | ".join(map(str, batch.limit(rows).collect())))


@dataclass
class TokenBucket:
    """A rate limit: ``rate`` tokens a second, at most ``most`` at once. Larger requests leave a debt."""

    rate: float
    most: float | None = None
    tokens: float | None = None
    last: float | None = None

    def acquire(self, n: float, now: float) -> float:
        """Takes n tokens at time ``now`` and returns the time to wait first."""
        most = self.most or self.rate
        if self.tokens is None or self.last is None:
            self.tokens, self.last = most, now
        self.tokens, self.last = min(most, self.tokens + (now - self.last) * self.rate), now
        wait = max(n - self.tokens, 0.0) / self.rate
        if wait and n <= most:  # the tokens that come while waiting are taken at once
            self.tokens, self.last = 0.0, now + wait
        else:
            self.tokens -= n
        return wait


def limited(requests: DataFrame, key: str, ts: str, cost: str, rate: float, most: float, concurrent: int, seconds: float) -> DataFrame:
    """key, ts, cost, started of every request of a client: it starts when the bucket has its cost and fewer than
    ``concurrent`` requests, which take ``seconds`` each, run. A client's requests are one queue, so one task."""
    types = dict(requests.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, cost], kind="stable")
        bucket, running, started = TokenBucket(rate, most), deque(), []
        clock = 0.0
        for at, n in zip(pdf[ts], pdf[cost], strict=True):
            clock = max(clock, float(at))
            while running and running[0] <= clock:
                running.popleft()
            if len(running) >= concurrent:
                clock = running.popleft()
            clock += bucket.acquire(float(n), clock)
            running.append(clock + seconds)
            started.append(clock)
        return pdf.assign(started=started)

    return requests.select(key, ts, cost).groupBy(key).applyInPandas(one, f"{key} {types[key]}, {ts} {types[ts]}, {cost} {types[cost]}, started double")


def staleness_trace(events: DataFrame, stream: str, order: str, kind: str, required: int, threshold: float, sync_step: int = 1) -> DataFrame:
    """stream, order, made, paused after each event: "sample" counts while not paused, "sync" sets the count back to what is queued.

    Samples since the last sync are numbered by a window, so no state is kept outside of Spark; a sample beyond the limit is not made.
    """
    limit = StalenessBudget(required, threshold, sync_step).limit
    w = Window.partitionBy(stream).orderBy(order)
    version = F.sum((F.col(kind) == "sync").cast("int")).over(w)
    rows = events.withColumn("_v", version)
    wanted = F.sum((F.col(kind) == "sample").cast("int")).over(Window.partitionBy(stream, "_v").orderBy(order))
    return rows.select(stream, order, kind, F.least(wanted, F.lit(limit)).alias("made"), (wanted >= limit).alias("paused"), ((F.col(kind) == "sample") & (wanted <= limit)).alias("is_made"))


def whole_batches(rows: DataFrame, partition: str, order: str, n: int) -> DataFrame:
    """Rows with ``batch``: the k-th n rows of a partition, by order; an incomplete last batch is left out."""
    by = Window.partitionBy(partition)
    at, count = F.row_number().over(by.orderBy(order)) - 1, F.count("*").over(by)
    return rows.withColumns({"batch": F.floor(at / n), "_whole": F.floor(count / n)}).where("batch < _whole").drop("_whole")


def take_oldest(status: DataFrame, key: str, step: str, now: int, n: int, max_age: int) -> DataFrame:
    """The n finished or failed prompts with the smallest step (then key), less those older than ``max_age`` steps; nothing if fewer than n are there."""
    ready = status.where(F.col("status").isin("finished", "failure"))
    chosen = ready.orderBy(step, key).limit(n)
    enough_rows = ready.agg((F.count("*") >= n).alias("_enough"))
    return chosen.crossJoin(F.broadcast(enough_rows)).where("_enough").drop("_enough").withColumn("dropped", F.lit(now) - F.col(step) > max_age)


def with_retries(f: Callable[[pd.DataFrame], pd.DataFrame], attempts: int = 16) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A mapInPandas function that tries each batch up to ``attempts`` times; the last error is raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(attempts):
                try:
                    yield f(b)
                    break
                except Exception:
                    if k + 1 == attempts:
                        raise

    return run
