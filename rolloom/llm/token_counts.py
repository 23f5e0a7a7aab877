"""Token counts without materialised ids.

1. All texts are cut into pre-tokens, which are counted in each task and then over
   the corpus: one row per distinct pre-token, with its occurrences.
2. The number of pieces is worked out once for each of these rows. This is the
   dictionary, a table.
3. Each text is cut again and becomes its own pre-token frequencies, which meet the
   dictionary: at most ``head`` of its entries, the most frequent ones, are broadcast
   and met in the same task; frequencies of all other pre-tokens go through an
   equality join. A text's count is the sum of frequency times pieces.

The head is cut at a number of occurrences, so that at most ``head`` entries have as
many; entries have a bounded size, since a pre-token longer than ``KEY`` characters is
known by a 128-bit digest. What is left for the join is rare by construction, so no
key of the join holds a large share of the rows.

Defined results: a null text counts as empty (0 bytes, 0 tokens); very long texts are
counted whole; special strings inside texts are one token each, as the library has it;
repeated rows are counted each; there is nothing to tie; null ids are carried through;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.vocab import BytePieces, opened
from rolloom.session import materialize, prepare

#: Dictionary entries that are broadcast at most, characters of a key, and distinct pre-tokens a task gathers before it sends them on.
HEAD, KEY, GATHERED = 500_000, 64, 300_000
KNOWN = "doc_id long, rid long, n_bytes long, known long, rest array<struct<key:string,n:long>>"


def _key(piece: str) -> str:
    """A pre-token's name: itself, or for a long one a longer string with its digest."""
    return piece if len(piece) <= KEY else "\0" * KEY + blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def dictionary(texts: DataFrame, path: str) -> DataFrame:
    """key, pieces, n (occurrences) of every distinct pre-token of the texts (one column)."""

    def made(held: Counter) -> pa.RecordBatch:
        # Only a long pre-token has to come along beside its key.
        return pa.RecordBatch.from_arrays([pa.array(map(_key, held), pa.string()), pa.array((p if len(p) > KEY else None for p in held), pa.string()), pa.array(held.values(), pa.int64())], names=["key", "piece", "n"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = opened(BytePieces, path), Counter()
        for batch in batches:
            for block in pieces.blocks(t.as_py() for t in batch.column(0)):
                get = held.get
                for word, n in zip(block.words, np.bincount(block.at, minlength=len(block.words)).tolist(), strict=True):
                    if n:
                        for p in pieces.of_word(word):
                            held[p] = get(p, 0) + n
                for counts in block.others:
                    for p, n in counts.items():
                        held[p] = get(p, 0) + n
                if len(held) > GATHERED:
                    yield made(held)
                    held = Counter()
        yield made(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = opened(BytePieces, path)
        for b in batches:
            sizes = [pieces.size(k if p is None else p) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(2)], names=["key", "pieces", "n"])

    distinct = texts.mapInArrow(gathered, "key string, piece string, n long").groupBy("key", "piece").agg(F.sum("n").alias("n"))
    return materialize(distinct.mapInArrow(counted, "key string, pieces long, n long"))


def _least(known: DataFrame, head: int) -> int:
    """The smallest number of occurrences that at most ``head`` entries reach: by powers of two."""
    sizes = {r.b: r["count"] for r in known.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()}
    at, total = max(sizes, default=0) + 1, 0
    while at > 0 and total + sizes.get(at - 1, 0) <= head:
        total += sizes.get(at - 1, 0)
        at -= 1
    return 1 << at


def count_tokens(docs: DataFrame, path: str, limit: int = 512, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, under the tokenizers file at ``path``."""
    spark = prepare(docs.sparkSession)
    known = dictionary(docs.select(F.col(text_col).alias("text")), path)
    least = _least(known, head)
    top = known.where(F.col("n") >= least).select("key", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((top.column("key").to_pylist(), top.column("pieces").to_numpy().astype(np.int64)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sizes = opened(BytePieces, path), dict(zip(shared.value[0], shared.value[1].tolist(), strict=True))

        def met(found: Iterable[tuple[str, int]], left: Counter) -> int:
            """Pieces of pre-tokens that are in the head; the others go to ``left``."""
            total = 0
            for p, n in found:
                size = sizes.get(p) if len(p) <= KEY else sizes.get(_key(p))
                if size is None:
                    left[_key(p)] += n
                else:
                    total += n * size
            return total

        for batch in batches:
            n_bytes, total, rest = [], [], []
            for block in pieces.blocks(t.as_py() for t in batch.column(2)):
                of_word, lacking = np.zeros(len(block.words), np.int64), {}
                for j, word in enumerate(block.words):
                    size = sizes.get(" " + word)  # most words are one pre-token
                    if size is None or not (word.isascii() and word.isalpha()):
                        left: Counter = Counter()
                        size = met(((p, 1) for p in pieces.of_word(word)), left)
                        if left:
                            lacking[j] = left
                    of_word[j] = size
                n = len(block.texts)
                here = np.bincount(block.doc, weights=of_word[block.at], minlength=n).astype(np.int64)
                more: list[Counter] = [Counter() for _ in range(n)]
                flags = np.zeros(len(block.words), bool)
                flags[list(lacking)] = True
                hit = flags[block.at]
                pairs, times = np.unique(block.doc[hit] * len(block.words) + block.at[hit], return_counts=True)
                for pair, k in zip(pairs.tolist(), times.tolist(), strict=True):
                    i, j = divmod(pair, len(block.words))
                    for key, c in lacking[j].items():
                        more[i][key] += c * k
                total += [int(h) + met(o.items(), m) for h, o, m in zip(here, block.others, more, strict=True)]
                rest += [[{"key": k, "n": c} for k, c in m.items()] for m in more]
                n_bytes += [len(t.encode()) for t in block.texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())])))],
                names=["doc_id", "rid", "n_bytes", "known", "rest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(summed, KNOWN))
    tail = rows.select("rid", F.explode("rest").alias("x")).select("rid", "x.key", "x.n").join(known.where(F.col("n") < least).select("key", "pieces"), "key")
    found = tail.groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.join(found, "rid", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
