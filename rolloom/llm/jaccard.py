"""N-gram Jaccard join by T-occurrence search, and the components of its links.

A text's set holds 64-bit hashes of its distinct five-word shingles. Texts with
equal sets are one class from the start. Classes link when
``100 * |a & b| >= 80 * |a | b|``.

The search is DivideSkip over an inverted index. All shingles are put in one
order, frequent ones last. A class of n shingles has p = n - ceil(0.8 n) + 1 short
lists (its first p shingles in that order) and n - p long ones. Two classes that
link share T = ceil(4 (m + n) / 9) shingles, and at most ceil(0.8 n) - 1 of them lie
in the long lists of the class whose short lists end first, so they meet in at
least T - max(ceil(0.8 m), ceil(0.8 n)) + 1 short lists. The short lists are merged
by a sorted shuffle that counts how often two classes meet; candidates that reach
the bound are decided by binary probes: whether a class is in the long list of a
shingle is whether the shingle is in the class's sorted set, so long lists are
never built.

Texts are hashed once. What later steps need of a class is the first part of its
set in hash order (its head, two fifths of it), kept as a table in the shared
folder. Only texts whose head holds too few rare shingles, and those of candidates, are read again.

Frequent shingles (a passage in every third text) would make long merges. They
are counted first, over each text's first shingles in hash order and, where some of
these are frequent, over those that would take their place; the most frequent
ones, at most ``max_frequent`` of either count, go to the end of the order. Any set of
them gives exact results, since the order is the same for all texts. Short lists
of other shingles stay short, and their pairs are counted in one shuffle.

Two classes that meet in no short list of a rare shingle can link only if both
have frequent shingles among their first p, that is, consist of frequent
shingles by four fifths: members of large groups of near copies. These classes
are gathered by the frequent shingles that they share. In each such group a few
classes are pivots, and every member is compared with them: members that link to one
pivot are one part, in a pass that is linear in the group. What is left are links
between parts. Jaccard distances obey the triangle inequality, so a member can link
into another part only if its distance from each pivot is within 0.2 of a distance
that occurs there; all others are done. The few members left are cut into chunks by
their number of shingles, and each pair of chunks of different parts is one task's
work. A task builds its own lists and runs DivideSkip in them: short lists are merged
by counting, candidates with at least T - L occurrences are probed in the L long
lists, and candidates already known to be in the query's component are skipped.
A task returns at most one link per class, never all pairs of a group.

Defined results: null and empty texts and texts of white space have an empty set and
are linked with nothing; shorter texts are one shingle; texts that occur again
are copies, also under the same id; null ids take part and are never the smallest
id unless there is no other; very long texts are hashed whole; ties need no order, as
links are symmetric; an empty table gives an empty result; other columns are ignored,
whatever their names. The scan of ``docs`` must give the same rows in the same partitions
when read again (any file source does).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloom.llm.columns import MAX_BROADCAST as MAX_ROWS
from rolloom.llm.columns import meet, of_rows, written
from rolloom.session import materialize, prepare, release

SHINGLE = 5
#: A shingle that more short lists than this hold, in hash order, counts as frequent.
FREQUENT = 8
MAX_FREQUENT = 2_000_000
#: For each frequent shingle among a set's first ones, so many of the next are counted too, since they would take its place.
REACH = 4
#: Shingles of a chunk of a group of near copies; a task compares two chunks.
CHUNK = 1_000_000
#: Pivots of a group of near copies, and bytes of all pivots up to which they are broadcast.
PIVOTS, PIVOT_BYTES = 8, 8 << 20
#: Groups of near copies up to which the ranges of their parts are broadcast.
MAX_GROUPS = 10_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_random = np.random.default_rng(20240101)
#: A random number for each byte and an odd base: hashes are polynomials modulo 2^64.
BYTE_CODES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = int(_random.integers(0, 1 << 62)) * 2 + 1
STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n places."""
    size = max(STEP, 1 << (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    return _tables[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        width = 1
    else:
        width = SHINGLE
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    powers, inverse = _power_tables(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_CODES[flat] * powers[: len(flat)], dtype=np.uint64, out=sums[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    first = (ends - lengths)[: len(words) - width + 1]
    return np.unique(_mixed((sums[ends[width - 1 :]] - sums[first]) * inverse[first]))


def _ceil(n: np.ndarray | int):
    return -(-4 * n // 5)


def needed(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Short lists in which linked classes of m and n shingles meet at least."""
    return np.maximum(1, -(-4 * (m + n) // 9) - np.maximum(_ceil(m), _ceil(n)) + 1)


def _class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.bitwise_xor.reduce(_mixed(s + np.uint64(len(s))))) - (1 << 63) if len(s) else 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first(n: int) -> int:
    """Short lists of a class of n shingles."""
    return n - _ceil(n) + 1


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class of each text's set; its head where the partition has not had the class."""
    seen: set[int] = set()
    for b in batches:
        n, names, heads = [], [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            c = _class_of(s)
            n.append(len(s))
            names.append(c)
            heads.append(s[: 2 * _first(len(s)) + SHINGLE].tobytes() if len(s) and c not in seen else None)
            seen.add(c)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(heads, pa.binary())], names=["doc_id", "rid", "n", "class", "head"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """class, size and the first part of the set of rows (class, n, set)."""
    for b in batches:
        yield [(c, n, np.frombuffer(s, np.uint64)) for c, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]


def _counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if parts:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n.astype(np.int64))], names=["h", "n"])


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for sets in _parts(batches):
        yield from _counted([s[: _first(n)] for _, n, s in sets])


def _among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which members of s are in a sorted array."""
    if not len(known):
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n over runs of equal h; those above the limit. Rows come sorted by h."""
    last, held = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        h, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        keys, sums = h[at], np.add.reduceat(n, at)
        if last is not None and keys[0] == last:
            sums[0] += held
        elif last is not None:
            keys, sums = np.r_[last, keys], np.r_[held, sums]
        last, held = int(keys[-1]), int(sums[-1])
        keep = np.flatnonzero(sums[:-1] > FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(sums[keep])], names=["h", "n"])
    if last is not None and held > FREQUENT:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held], pa.int64())], names=["h", "n"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes in each list, with sizes that can link. Rows come sorted by h."""
    rest = None
    for b in _with_end(batches):
        if b is not None:
            part = np.stack([b.column(i).to_numpy() for i in range(3)])
            rest = part if rest is None else np.concatenate([rest, part], axis=1)
            cut = int(np.searchsorted(rest[0], rest[0, -1]))
        else:
            cut = 0 if rest is None else rest.shape[1]
        if rest is None or not cut:
            continue
        rows, rest = rest[:, :cut], rest[:, cut:]
        rows = rows[:, np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]]
        shift = 1
        while shift < rows.shape[1]:  # members of a list that are ``shift`` places apart
            i = np.flatnonzero(rows[0, shift:] == rows[0, :-shift])
            if not len(i):
                break
            m, n = rows[2, i], rows[2, i + shift]
            i = i[(5 * n >= 4 * m) & (4 * n <= 5 * m)]
            if len(i):
                yield _pair_batch(rows[1, i], rows[1, i + shift], rows[2, i], rows[2, i + shift])
            shift += 1


def _pair_batch(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    swap = a > b
    return pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, n, m)), pa.array(np.where(swap, m, n))], names=["a", "b", "na", "nb"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (a, b, text of a, text of b), by binary probes."""
    last, own = None, None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(a), bool)
        for i, (x, ta, tb) in enumerate(zip(a, batch.column(2), batch.column(3), strict=True)):
            if x != last:
                last, own = x, shingles(ta.as_py())
            other = shingles(tb.as_py())
            both = _shared(own, other)
            keep[i] = 100 * both >= 80 * (len(own) + len(other) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


class _Roots:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.of(i), self.of(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def divide_skip(sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (places of sets) that join all linked sets into their components.

    sides: where given, only sets of different sides are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    side = np.array([sides[i] for i in order]) if sides else None
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(flat, kind="stable")
    postings, starts = owner[by], np.r_[0, np.cumsum(np.bincount(flat, minlength=len(names)))]
    ends, roots, out = np.cumsum(sizes), _Roots(len(order)), []
    for q in range(1, len(order)):
        low = int(np.searchsorted(sizes[:q], _ceil(int(sizes[q]))))
        if low == q:
            continue
        t = flat[ends[q] - sizes[q] : ends[q]]
        lists = [postings[starts[x] : starts[x + 1]] for x in t]
        lists = [x[np.searchsorted(x, low) : np.searchsorted(x, q)] for x in lists]
        lists = sorted((x for x in lists if len(x)), key=len)
        least = _ceil(int(sizes[q]))  # shared shingles at the fewest, for the smallest partner
        if len(lists) < least:
            continue
        middle = len(lists[len(lists) // 2])
        n_long = min(least - 1, sum(len(x) > 4 * middle for x in lists))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        counts = np.bincount(np.concatenate(short) - low, minlength=q - low)
        found = np.flatnonzero(counts >= least - n_long)
        if side is not None:
            found = found[side[found + low] != side[q]]
        own = roots.of(q)
        found = np.array([j for j in found if roots.of(int(j) + low) != own], dtype=np.int64)
        both = counts[found]
        for x in long:
            at = np.minimum(np.searchsorted(x, found + low), len(x) - 1)
            both = both + (x[at] == found + low)
        for j in found[100 * both >= 80 * (sizes[q] + sizes[found + low] - both)] + low:
            if roots.join(q, int(j)):
                out.append((order[q], order[int(j)]))
    return out


def _block(pdf):
    """Links of one task: all pairs of a chunk, or pairs across two chunks."""
    import pandas as pd

    across = pdf["x"].iloc[0] != pdf["y"].iloc[0]
    sides = pdf["side"].tolist()
    links = divide_skip([np.frombuffer(x, np.uint64) for x in pdf["set"]], sides if across else None) if len(pdf) > 1 and (not across or len(set(sides)) > 1) else []
    names = pdf["class"].to_numpy()
    return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype="int64")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share, by binary probes of the smaller one in the other."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of rows (label, class, n, set, pivots) from the pivots of their group, and the pivots that they link to."""
    last, sets = None, []
    for b in batches:
        distances, linked = [], []
        for label, s, pivots in zip(b.column(0).to_pylist(), b.column(3), b.column(4), strict=True):
            if label != last:
                last, sets = label, [(p["class"], np.frombuffer(p["set"], np.uint64)) for p in pivots.as_py()]
            own, d, names = np.frombuffer(s.as_py(), np.uint64), [], []
            for name, other in sets:
                both = _shared(own, other)
                d.append(1 - both / (len(own) + len(other) - both))
                if 100 * both >= 80 * (len(own) + len(other) - both):
                    names.append(name)
            distances.append(d)
            linked.append(names)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(distances, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.int64()))], names=["label", "class", "n", "d", "linked"])


def near_copies(heavy: DataFrame, chunk: int, n_pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) among classes (class, n, tokens, set) that share a token."""
    rows = heavy.select("class", F.explode("tokens").alias("token"))
    first = rows.groupBy("token").agg(F.min("class").alias("first"), F.count("*").alias("c")).where("c > 1").select("token", "first")
    edges = meet(rows, first, ["token"]).where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b")).distinct()
    named = materialize(heavy.join(components(edges), "class").select("label", "class", "n", "set"))

    # Pivots: at most ``n_pivots`` a group, the smallest class of each part of the classes by hash.
    picked = named.groupBy("label", F.pmod(F.xxhash64("class"), F.lit(n_pivots)).alias("b")).agg(F.min("class").alias("class")).select("class")
    chosen = named.join(picked, "class", "left_semi")
    pivots = materialize(chosen.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("class", "set"))).alias("pivots")))
    size, n = pivots.select(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda a, p: a + F.length(p["set"]))), F.count("*")).first()
    seen = meet(named, pivots, ["label"], MAX_ROWS if (size or 0) <= PIVOT_BYTES else -1, n=n).select("label", "class", "n", "set", "pivots")
    seen = materialize(seen.mapInArrow(_to_pivots, "label long, class long, n long, d array<double>, linked array<long>"))
    links = materialize(seen.select(F.col("class").alias("a"), F.explode("linked").alias("b")))

    # Parts of a group: what its pivots hold together, and the rest (null).
    parts = components(links).withColumnRenamed("label", "part")
    members = materialize(seen.drop("linked").join(parts, "class", "left"))
    ranges = F.array(*[F.struct(F.min(F.get("d", F.lit(i))).alias("low"), F.max(F.get("d", F.lit(i))).alias("high")) for i in range(n_pivots)])
    both = members.groupBy("label", "part").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"), F.filter(ranges, lambda r: r["low"].isNotNull()).alias("ranges"))
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("start", F.coalesce(F.sum("chunks").over(before), F.lit(0)).cast("int"))
    groups = both.groupBy("label").agg(F.collect_list(F.struct("part", "start", "chunks", "ranges")).alias("groups")).where((F.size("groups") > 1) | F.exists("groups", lambda g: g["part"].isNull()))
    near = meet(members, groups, ["label"], MAX_GROUPS, n=n)
    # Bounds are a little wider than 0.2, for the rounding of distances.
    reaches = lambda g: F.forall(F.zip_with(F.col("d"), g["ranges"], lambda x, r: (x >= r["low"] - 0.2000001) & (x <= r["high"] + 0.2000001)), lambda ok: ok)
    others = F.filter("groups", lambda g: (~g["part"].eqNullSafe(F.col("part")) | g["part"].isNull()) & reaches(g))
    own = F.filter("groups", lambda g: g["part"].eqNullSafe(F.col("part")))[0]
    near = near.select("label", "class", own.alias("own"), F.flatten(F.transform(others, lambda g: F.sequence(g["start"], g["start"] + g["chunks"] - 1))).alias("others"))
    near = near.where(F.size("others") > 0).withColumn("side", F.col("own.start") + F.pmod(F.hash("class"), F.col("own.chunks")))
    near = near.select("class", "side", F.explode("others").alias("other")).join(named.select("label", "class", "set"), "class")
    tasks = near.select("label", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "class", "side", "set")
    return links.unionByName(materialize(tasks.groupBy("label", "x", "y").applyInPandas(_block, "a long, b long")))


def components(links: DataFrame) -> DataFrame:
    """class, label over the classes in ``links`` (a, b): the smallest class of each component.

    Labels spread to neighbours and jump to their label's own label, so the number of
    rounds grows with the logarithm of a component's diameter.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).toDF("class", "other").distinct())
    labels = both.groupBy("class").agg(F.min("other").alias("m")).select("class", F.least("class", "m").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.min("label").alias("m"))
        spread = labels.join(near, "class").select("class", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("class").alias("label"), F.col("label").alias("up"))
        new = materialize(spread.join(up, "label", "left").select("class", F.least("label", "up").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def _texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """rid and text of the rows wanted (rid)."""
    return of_rows(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text")), "rid", wanted)


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) that link."""
    for c in ("b", "a"):
        pairs = pairs.join(reps.select(F.col("class").alias(c), F.col("rid").alias(f"r{c}")), c)
    pairs = materialize(pairs)
    texts = materialize(_texts(docs, pairs.select(F.explode(F.array("ra", "rb")).alias("rid")), text_col))
    rows = pairs.join(texts.select(F.col("rid").alias("rb"), F.col("text").alias("tb")), "rb").join(texts.select(F.col("rid").alias("ra"), F.col("text").alias("ta")), "ra")
    return materialize(rows.select("a", "b", "ta", "tb").mapInArrow(_decided, "a long, b long"))


def _rare_and_frequent(n: int, s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rare and frequent shingles among a class's first ones, from the first part of its set; whether that part is enough to tell."""
    common, p = _among(s, frequent), _first(n)
    rare = s[~common][:p]
    return rare, s[common][: p - len(rare)], len(rare) == p or len(s) == n


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_frequent: int = MAX_FREQUENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, with its class, its component's label (null for empty sets) and its row number (rid)."""
    spark = prepare(docs.sparkSession)
    release(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    nodes = written(ids.mapInArrow(_nodes, "doc_id long, rid long, n long, class long, head binary"))
    heads = nodes.where("head IS NOT NULL").select("class", "n", "head")

    def counted(rows: DataFrame) -> np.ndarray:
        found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_frequent, "h long, n long")
        top = found.orderBy(F.desc("n"), "h").limit(max_frequent).select("h").toArrow()
        return np.sort(top.column("h").to_numpy().astype(np.int64).view(np.uint64))

    first = spark.sparkContext.broadcast(counted(heads.mapInArrow(_prefix_counts, "h long, n long")))
    release(spark)

    def short_of(n: int, s: np.ndarray) -> bool:
        """Whether a head ends before the shingles that would take the places of its frequent ones."""
        return len(s) < n and _first(n) + REACH * int(_among(s[: _first(n)], first.value).sum()) > len(s)

    def next_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _parts(batches):
            found = []
            for _, n, s in sets:
                p = _first(n)
                if (f := int(_among(s[:p], first.value).sum())) and not short_of(n, s):
                    found.append(s[p : p + REACH * f])
            yield from _counted(found)

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c for c, n, s in sets if short_of(n, s)], pa.int64())], names=["class"])

    def unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c for c, n, s in sets if not short_of(n, s) and not _rare_and_frequent(n, s, shared.value)[2]], pa.int64())], names=["class"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "set"])

    def settled(sets: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """class, size, part of the set, rare and frequent shingles of what need not be read again."""
        return [(c, n, s, rare, common) for c, n, s in sets if not short_of(n, s) for rare, common, enough in [_rare_and_frequent(n, s, shared.value)] if enough]

    def short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _parts(batches):
            if found := settled(sets):
                lengths = [len(x[3]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate([x[3] for x in found])), pa.array(np.repeat(np.array([x[0] for x in found], np.int64), lengths)), pa.array(np.repeat(np.array([x[1] for x in found], np.int64), lengths))], names=["h", "class", "n"])

    def frequent_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _parts(batches):
            if found := [x for x in settled(sets) if len(x[4])]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[4].view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([x[2].tobytes() for x in found], pa.binary())],
                    names=["class", "n", "tokens", "set"])

    def read_again(classes: DataFrame) -> DataFrame:
        wanted = classes.distinct().join(reps.select("class", "rid"), "class").select("rid")
        return written(_texts(docs, wanted, text_col).mapInArrow(whole_sets, "class long, n long, set binary"))

    reps = materialize(nodes.where("n > 0").groupBy("class").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id")))
    known = heads.withColumnRenamed("head", "set").unionByName(read_again(heads.mapInArrow(lacking, "class long")))
    late = counted(known.mapInArrow(next_counts, "h long, n long")) if len(first.value) else first.value
    shared = spark.sparkContext.broadcast(np.union1d(first.value, late))
    release(spark)
    known = known.unionByName(read_again(heads.mapInArrow(unsettled, "class long")))

    pairs = known.mapInArrow(short_lists, "h long, class long, n long").repartition("h").sortWithinPartitions("h", "class").mapInArrow(_pairs, "a long, b long, na long, nb long")
    need = F.greatest(F.lit(1), F.ceil(4 * (F.col("na") + F.col("nb")) / 9) - F.greatest(F.ceil(4 * F.col("na") / 5), F.ceil(4 * F.col("nb") / 5)) + 1)
    pairs = materialize(pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= need).select("a", "b"))
    release(spark)
    links = _verified(docs, reps.select("class", "rid"), pairs, text_col)

    heavy = known.mapInArrow(frequent_sets, "class long, n long, tokens array<long>, set binary")
    release(spark)
    heavy = materialize(heavy.groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("set").alias("set")))
    labels = components(links.unionByName(near_copies(heavy, chunk)))
    release(spark)

    named = reps.join(labels, "class", "left").select("class", "first_id", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("first_id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    by_class = materialize(meet(named, least, ["label"], how="left").select("class", F.coalesce("least", "first_id").alias("component_id"), "label"))
    linked = nodes.where("n > 0").join(by_class, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class", "label", "rid")
    return linked.unionByName(nodes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "class", F.lit(None).cast("long").alias("label"), "rid"))
