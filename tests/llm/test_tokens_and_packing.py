import random
import zlib
from array import array
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolloom.llm import packing, token_counts, vocab
from rolloom.llm.vocab import BytePieces, WordEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a", "a  b", "a   b", "a \n b", "\n x", "x\n\n  y", "a\t b \t c ", "it's'll ''s", "I'Ve", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "日本語 text", "é", "İstanbul ıo",
    "\x1c a\x1d", "\x85b \xa0c", "1234 5²¼", "ªº µ", "a\x00b", " x", "ß straße ĸʼn", "Ɓa ɓ ǅ", "😀 ok", "x" * 5000, "!?#  $%", " \n", "end \n ",
]


def frequencies(byte, texts):
    out = []
    for block in byte.blocks(texts):
        own = [Counter(o) for o in block.others]
        for i, j in zip(block.doc, block.at):
            own[i].update(byte.of_word(block.words[j]))
        out += own
    return out


def test_equal_to_the_library(monkeypatch):
    byte, word = BytePieces(BYTE), WordEncoder(WORD)
    lib_b, lib_w = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x180)]
    texts = ODD + letters + [f"a{c}b {c}c" for c in letters]
    texts += ["".join(rng.choice(["a", "B", " ", " ", "\n", "'s", "!", "7", "é", "\t", "\xa0", "ll", "'ll"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for size in (1, 200, 1 << 22):
        monkeypatch.setattr(vocab, "SLICE", size)
        for t, found in zip(texts, frequencies(byte, texts), strict=True):
            assert sum(n * byte.size(p) for p, n in found.items()) == len(lib_b.encode(t, add_special_tokens=False).ids), repr(t)
        for t, ids in zip(texts, word.encode_all(texts), strict=True):
            assert ids.tolist() == lib_w.encode(t, add_special_tokens=False).ids, repr(t)


def test_pre_tokens_are_the_library_s():
    byte, lib = BytePieces(BYTE), Tokenizer.from_file(BYTE)
    back = {chr(c): b for b, c in byte.letters.items()}
    rng = random.Random(6)
    texts = ["“quoted” – 5 € " * 50, "日本語 text " * 30, "слово и слово, ещё слово", "😀  ok \u2003 x\u3000", "‘it’s’ it's", "plain words and plain words"]
    texts += ["".join(rng.choice(["я", "’", "–", " ", "  ", "\n", "'s", "7", "٣", "語", "\u2009", "é", "x", "<"]) for _ in range(rng.randrange(40))) + "€" for _ in range(2000)]
    for t, got in zip(texts, frequencies(byte, texts), strict=True):
        want = Counter(bytes(back[c] for c in p).decode() for p, _ in lib.pre_tokenizer.pre_tokenize_str(t))
        assert got == want
        assert sum(n * byte.size(p) for p, n in got.items()) == len(lib.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("head", [0, 3, 500_000])
def test_counts(spark, head):
    rows = [(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "x"), (3, "word " * 60000), (4, "=" * 900 + " " + "=" * 900), (5, "a<|endoftext|>b <|startoftext|>"), (6, "語 “x” 語"), (7, "=" * 900)]
    rows += [(10 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_tokens int, key string").withColumns({"rid": F.lit("r"), "pieces": F.lit(1), "known": F.lit(2)})
    lib = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(docs, BYTE, head=head).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0), BYTE, head=head).count() == 0


def test_dictionary_counts_each_pre_token_once(spark):
    docs = spark.createDataFrame([("the cat the cat",), ("the cat",), (None,), ("=" * 100,)], "text string")
    got = {r.key: (r.pieces, r.n) for r in token_counts.dictionary(docs, BYTE).collect()}
    assert {k: v for k, v in got.items() if len(k) < 60} == {"the": (1, 2), " cat": (1, 3), " the": (1, 1)} and len(got) == 4
    known = spark.createDataFrame([(str(i), 1, i) for i in range(1, 65)], "key string, pieces long, n long")
    for head in (0, 1, 2, 32, 33, 34, 64, 1000):
        least = token_counts._least(known, head)
        assert known.where(f"n >= {least}").count() <= head and (least == 1 or known.where(f"n >= {least // 2}").count() > head)


def best_fit_decreasing(items, capacity):
    gaps: list[int] = []
    for x in sorted(items, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_meetings_are_successor_sweeps():
    rng = random.Random(8)
    for _ in range(200):
        lengths = sorted({rng.randrange(20, 40) for _ in range(rng.randrange(1, 8))}, reverse=True)
        runs, rank = [], 0
        for x in lengths:
            n = rng.randrange(1, 5)
            runs.append((x, rank, rank + n))
            rank += n + rng.randrange(3)
        gaps = {g: rng.randrange(1, 4) for g in rng.sample(range(15, 130), rng.randrange(0, 9))}
        rules, rest = packing.meetings(gaps, runs)
        slots = sorted(g for g, n in gaps.items() for _ in range(n * max(g // lengths[0], 1)))
        met, left = {}, []
        for x, a, b in runs:  # piece by piece: the smallest slot that holds it
            for r in range(a, b):
                fit = [g for g in slots if g >= x]
                if fit:
                    slots.remove(fit[0])
                    met[r] = fit[0]
                else:
                    left.append(r)
        assert met == {r + i: g for g, _, r, n in rules for i in range(n)}
        assert left == [r for _, a, b in rest for r in range(a, b)]
        taken = [(g, s + i) for g, s, _, n in rules for i in range(n)]
        assert len(taken) == len(set(taken)) and all(s < gaps[g] * max(g // lengths[0], 1) for g, s in taken)


@pytest.mark.parametrize("kind", ["mixed", "tiny", "middle", "one length", "long"])
def test_rounds_place_every_rank(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "TASK_GAPS", 40)  # several partitions
    monkeypatch.setattr(packing, "SMALL", 6)
    rng = random.Random(kind)
    draw = {"mixed": lambda: rng.choice([1, 5, 30, 64, rng.randrange(1, 65)]), "tiny": lambda: rng.randrange(1, 4), "middle": lambda: rng.randrange(15, 40), "one length": lambda: 22, "long": lambda: rng.randrange(33, 65)}[kind]
    items = sorted((draw() for _ in range(600)), reverse=True)
    rows = [r for df in packing.placements(spark, Counter(items), 64) for r in df.where("rank >= 0").collect()]
    assert sorted(r["rank"] for r in rows) == list(range(600))
    seqs = check_packing([Row(sequence_id=r.sequence_id, offset=r.value, length=items[r["rank"]]) for r in rows], 64)
    assert len(seqs) <= 1.03 * best_fit_decreasing(items, 64) + 1


def check_packing(rows, capacity):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_seq


def test_packing_small(spark):
    texts = [None, "", "a", "a", "b " * 300, "c d " * 40, "the same", "the same"] + [f"w{i} " * (i % 37) for i in range(150)]
    docs = spark.createDataFrame([(i % 140, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string").withColumns({"rank": F.lit("x"), "sequence_id": F.lit(1), "value": F.lit(2), "part": F.lit(3)})
    rows = packing.pack(docs, WORD, 64).collect()
    seqs = check_packing(rows, 64)
    lib = Tokenizer.from_file(WORD)
    want = []
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((i % 140, k // 64, k, len(part), zlib.crc32(array("I", part).tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    total = sum(r.length for r in rows)
    assert len(seqs) <= -(-total // 64) + 1
    assert packing.pack(docs.limit(0), WORD, 64).count() == 0
