"""Language identification by rank-order profiles.

Training counts character n-grams of lengths 1 to 3 (words padded with a blank on
both sides) over all training texts, in each task first, so the shuffle is bounded
by the alphabet and not by the corpus. The ``top`` most frequent n-grams of a
language are its profile. A text is ranked the same way and takes the language
with the smallest out-of-place distance: the sum, over the text's own most frequent
n-grams, of how far each is from its place in the profile (``top`` if absent).

An n-gram is one whole number, three code points of 21 bits, so a text is counted
by sorting numbers. Numbers have the order of the n-grams as strings.

The score is 1 minus the distance as a share of the largest possible distance.
Ties in frequency go by the n-gram, ties in distance by the language's name.

Defined results: null texts and texts without a letter give ``und`` with score 0;
without any training row every text gives ``und``; a null id is never held out;
repeated rows are counted each; very long texts are counted in blocks of
``BLOCK`` characters, with the same result; an empty table gives an empty result;
other columns are ignored, whatever their names. The number of languages is taken
to be small (profiles are broadcast: ``top`` n-grams each, at most ``max_langs``
languages, beyond which an error is raised).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloom.session import prepare

#: Characters counted at once, and n-grams a worker gathers before it sums them.
BLOCK, TABLE_SIZE = 1 << 20, 2_000_000
BITS, BLANK = 21, 32


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a blank."""
    table = np.arange(sys.maxunicode + 1, dtype=np.int64)
    table[[not chr(i).isalpha() for i in range(len(table))]] = BLANK
    return table


def _padded(text: str) -> np.ndarray:
    """Code points of the lower-cased words with one blank before, between and after them; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[BLANK], _letters()[codes], [BLANK]])
    blank = codes == BLANK
    codes = codes[np.r_[True, ~(blank[1:] & blank[:-1])]]
    return codes if len(codes) > 1 else codes[:0]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[at], np.add.reduceat(counts, at)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams, in order, and how often each occurs; empty without a letter."""
    codes = _padded(text or "")
    parts = []
    for at in range(0, max(len(codes) - 1, 0), BLOCK):  # two more characters than a block, for the n-grams that begin in it
        c = codes[at : at + BLOCK + 2]
        one, two, three = c[:BLOCK], c[:-1][:BLOCK], c[:-2]
        pairs = two << 2 * BITS | c[1 : len(two) + 1] << BITS
        triples = (three << 2 * BITS | c[1:-1] << BITS | c[2:])[c[1:-1] != BLANK]
        grams = np.concatenate([one[one != BLANK] << 2 * BITS, pairs, triples])
        grams.sort()
        starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        parts.append((grams[starts], np.diff(np.r_[starts, len(grams)])))
    if not parts:
        return codes, codes
    return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def corpus_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over rows (lang, text)."""

    def made(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = gram_counts(text.as_py())
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts))
                    size += len(codes)
                if size > TABLE_SIZE:
                    for k, parts in held.items():
                        held[k] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if 2 * size > TABLE_SIZE:
                        yield from made(held)
                        held, size = {}, 0
        yield from made(held)

    return rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(rows: DataFrame, top: int, max_langs: int = 1000) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams by rank; at most ``top`` a language reach the driver."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    found = corpus_counts(rows).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    held: dict[str, list[tuple[int, int]]] = {}
    for r in found.select("lang", "rank", "gram").limit(max_langs * top + 1).collect():
        held.setdefault(r.lang, []).append((r["rank"], r.gram))
    if len(held) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    return {lang: np.array([g for _, g in sorted(ranked)], np.int64) for lang, ranked in held.items()}


class Ranker:
    """Distances of texts to profiles."""

    def __init__(self, by_lang: dict[str, np.ndarray], top: int, own: int):
        self.langs, self.top, self.own = sorted(by_lang), top, own
        self.known = np.unique(np.concatenate([by_lang[x] for x in self.langs])) if by_lang else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.known)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        if len(codes) > self.own:  # all that tie with the last place stay for now
            least = np.partition(counts, len(counts) - self.own)[len(counts) - self.own]
            codes, counts = codes[counts >= least], counts[counts >= least]
        best = codes[np.argsort(-counts, kind="stable")[: self.own]]
        at = np.minimum(np.searchsorted(self.known, best), len(self.known) - 1)
        known = self.known[at] == best
        ranks, place = self.ranks[:, at[known]], np.flatnonzero(known)
        away = np.where(ranks >= 0, np.minimum(np.abs(ranks - place), self.top), self.top)
        distance = away.sum(axis=1) + self.top * (len(best) - len(place))
        k = int(np.argmin(distance))
        return self.langs[k], float(1 - distance[k] / (self.top * len(best)))


def identify(docs: DataFrame, top: int = 400, own: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    spark = prepare(docs.sparkSession)
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(profiles(train, top))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value, top, own)
        for batch in batches:
            out = [ranker.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
