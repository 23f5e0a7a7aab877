"""Column builders shared by the native operators: words, window hashes and covered positions."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.session import materialize, relieve

#: Rows of a small table that may be broadcast; beyond, keys with more than one row in so many are joined apart.
MAX_BROADCAST, HOT = 100_000, 200
#: Words of 64 row numbers that may be broadcast (16 million rows where they are dense).
MAX_WORDS = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators (a regular expression for one run)."""
    return F.filter(F.split(text, separators, -1), lambda w: w != "")


def _joined(a: Column, b: Column, shift: int) -> Column:
    """hash(a[i], b[i + shift]) for every i for which both exist."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + shift, n), lambda x, y: F.xxhash64(x, y))


def window_hashes(df: DataFrame, words_col: str, lengths: Iterable[int]) -> DataFrame:
    """Adds columns h<L> for each length: 64-bit hashes of every run of L words, empty where there are fewer.

    A window's hash is put together from windows of powers of two, so the work is a
    few hashes a word whatever the length. Each step is a projection of its own:
    nothing inside a lambda refers to a computed array, which Spark would work
    out again for each element.
    """
    lengths = sorted(set(lengths))
    df = df.withColumn("_p1", F.transform(words_col, lambda w: F.xxhash64(w)))
    power = 1
    while lengths and 2 * power <= lengths[-1]:
        df = df.withColumn(f"_p{2 * power}", _joined(F.col(f"_p{power}"), F.col(f"_p{power}"), power))
        power *= 2
    for length in lengths:
        done, name = 0, None
        for p in reversed([1 << i for i in range(power.bit_length())]):
            if length & p:
                if name is None:
                    df = df.withColumn(f"h{length}", F.col(f"_p{p}"))
                else:
                    df = df.withColumn(f"h{length}", _joined(F.col(f"h{length}"), F.col(f"_p{p}"), done))
                name, done = f"h{length}", done + p
    return df.drop(*[f"_p{1 << i}" for i in range(power.bit_length())])


def covered(intervals: Column) -> Column:
    """Positions covered by sorted structs (start, end)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc.end, x.end).alias("end"), (acc.n + F.greatest(x.end - F.greatest(x.start, acc.end), F.lit(0))).alias("n"))
    return F.aggregate(intervals, zero, step, lambda acc: acc.n)


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def meet(rows: DataFrame, small: DataFrame, keys: list[str], most: int = MAX_BROADCAST, how: str = "inner", n: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``small``, which has at most one row for each key (nulls are equal). how: inner or left.
    n: a number that ``small`` has at most, where it is known; else its rows are counted.

    ``small`` is counted: up to ``most`` rows it is broadcast. Beyond, keys that hold more than one row in ``HOT``
    (there are fewer of them than ``HOT``) are joined by broadcasting their rows of ``small``, and all others by a
    shuffle, in which no key has a larger share.
    """
    small = small.withColumnsRenamed({k: f"_{k}" for k in keys})
    names = [*rows.columns, *[c for c in small.columns if c not in {f"_{k}" for k in keys}]]
    same = total_and(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)
    if n is None:
        small = materialize(small)
        n = small.count()
    if n <= most:
        return rows.join(F.broadcast(small), same, how).select(*names)
    rows, small = materialize(rows), materialize(small)
    least = rows.count() / HOT
    hot = materialize(rows.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).agg(F.count("*").alias("_c")).where(F.col("_c") > least).drop("_c"))
    is_hot = lambda prefix: total_and(F.col(f"{prefix}{k}").eqNullSafe(F.col(f"_hot_{k}")) for k in keys)
    few = rows.join(F.broadcast(hot), is_hot(""), "left_semi").join(F.broadcast(small.join(F.broadcast(hot), is_hot("_"), "left_semi")), same, how)
    rest = rows.join(F.broadcast(hot), is_hot(""), "left_anti").join(small.hint("merge"), same, how)
    return few.select(*names).unionByName(rest.select(*names))


def of_rows(rows: DataFrame, number: str, listed: DataFrame, there: bool = True, most: int = MAX_WORDS) -> DataFrame:
    """The rows whose number (column ``number``, from monotonically_increasing_id) is in ``listed`` (one column; repeats don't matter), or is not (there=False).

    64 neighbouring numbers are one word of bits, so what is broadcast (counted first, up to ``most`` words; beyond, a
    shuffled join) has a row for 64 rows where many are listed, and never more rows than are listed.
    """
    word, bits, r = free_name(rows.columns, "_word"), free_name(rows.columns, "_bits"), F.col(listed.columns[0])
    words = listed.select(F.shiftright(r, 6).alias(word), (r.bitwiseAND(63)).cast("int").alias("_place")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias(bits))
    words = materialize(words)
    words = F.broadcast(words) if words.count() <= most else words.hint("merge")
    found = F.getbit(F.col(bits), F.col(number).bitwiseAND(63).cast("int")) == 1
    both = rows.join(words, F.shiftright(F.col(number), 6) == F.col(word), "inner" if there else "left")
    return both.where(found if there else F.col(bits).isNull() | ~found).select(*rows.columns)


def total_and(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def written(df: DataFrame) -> DataFrame:
    """The rows from a table written in the shared folder: like a checkpoint, but later scans read only the columns that they need."""
    spark = df.sparkSession
    relieve(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """A column name that is not taken (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in taken}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


class BitFilter:
    """A set of 64-bit hashes as bits in the plan: what is in the set always passes, little else does.

    The filter has ``BITS`` bits a hash and at most ``MOST`` bits (16 MB), however large the set is; with more
    hashes more of the others pass, which whoever uses it must sort out by an exact test.
    """

    BITS, MOST = 64, 1 << 27

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: one column of longs, of which there are about n."""
        self.size = 64
        while self.size < min(self.BITS * n, self.MOST):
            self.size *= 2
        h = F.col(hashes.columns[0])
        places = hashes.select(F.explode(F.array(*self._places(h))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("w")).toArrow()
        bits = np.zeros(self.size // 64, ">i8")
        bits[words.column("i").to_numpy()] = words.column("w").to_numpy()
        sc = hashes.sparkSession.sparkContext
        array = sc._gateway.new_array(sc._jvm.long, len(bits))
        sc._jvm.java.nio.ByteBuffer.wrap(bytearray(bits.tobytes())).asLongBuffer().get(array)
        self.words = Column(sc._jvm.org.apache.spark.sql.functions.lit(array))

    def _places(self, h: Column) -> list[Column]:
        return [x.bitwiseAND(self.size - 1).cast("int") for x in (h, F.shiftrightunsigned(h, 32))]

    def passes(self, h: Column) -> Column:
        on = [F.getbit(F.get(self.words, F.shiftright(p, 6)), p.bitwiseAND(63)) == 1 for p in self._places(h)]
        return on[0] & on[1]
