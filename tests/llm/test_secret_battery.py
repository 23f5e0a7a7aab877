"""The whole verdict on random tokens, recomputed in plain Python from the docstring of secrets."""

import math
import random
import re
from collections import Counter, defaultdict

import brute

from rolloom.llm import secrets


def phi(z):
    return 1 / (1 + math.exp(-1.5976 * z - 0.070566 * z**3))


def judged(value):
    """Encoding, size class, p of the battery, p against text."""
    bare = value.rstrip("=")
    _, alphabet, k = next(a for a in secrets.ALPHABETS if re.search(a[0], value))
    at = [alphabet.index(c if k == 64 else c.lower()) for c in bare]
    n, bins = len(bare), 4 if len(bare) < 40 else 8 if len(bare) < 80 else 16
    u = [(a + 0.5) / k - 0.5 for a in at]
    seen = Counter(math.floor((x + 0.5) * bins) for x in u)
    share = Counter(math.floor((i + 0.5) / k * bins) for i in range(k))
    chi2 = sum((seen[b] - share[b] * n / k) ** 2 / (share[b] * n / k) for b in range(bins))
    d = bins - 1
    p_chi = max(1 - phi(((chi2 / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))), 1e-12)
    high = [x > 0 for x in u]
    n1 = sum(high)
    mean = 2 * n1 * (n - n1) / n + 1
    z = (1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    serial = sum(a * b for a, b in zip(u, u[1:])) / max(sum(x * x for x in u), 1e-9) * math.sqrt(n)
    p_runs, p_serial = (max(2 * (1 - phi(abs(v))), 1e-12) for v in (z, serial))
    x = -math.log(p_chi) - math.log(p_runs) - math.log(p_serial)
    classes = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in bare]
    moved = sum(a != b for a, b in zip(classes, classes[1:]))
    held, weights = secrets._text_model(alphabet)
    chain = moved * math.log(secrets.TEXT_CHANGES / (held - 1)) + (n - 1 - moved) * math.log(1 - secrets.TEXT_CHANGES)
    return k, int(math.log2(n)), math.exp(-x) * (1 + x + x * x / 2), math.exp(-max(sum(weights[a] for a in at) + math.log(held) - chain, 0))


def bin_of(p):
    return min(math.floor(-4 * math.log2(max(p, 1e-30))), 400)


def rejected_from(bins, fdr):
    """The least bin that the Benjamini-Hochberg rule rejects."""
    return min((b for b in set(bins) if 2 ** (-b / 4) <= fdr * sum(x >= b for x in bins) / len(bins)), default=None)


def plain_spans(texts, fdr=0.01, least=0.001):
    found = []
    for i, t in enumerate(texts):
        base = [(s, e) for _, s, e in brute.base_spans(t)]
        for m in re.finditer(secrets.PATTERNS["random"], t or ""):
            found.append((i, m.start(), m.end(), judged(m[0]), any(s < m.end() and m.start() < e for s, e in base)))
    groups = defaultdict(list)
    for x in found:
        groups[x[3][:2]].append(x[3])
    limits = {g: (rejected_from([bin_of(j[3]) for j in js], fdr), rejected_from([bin_of(j[2]) for j in js], fdr)) for g, js in groups.items()}
    out = {i: list(brute.base_spans(t)) for i, t in enumerate(texts)}
    for i, s, e, j, overlaps in found:
        text_limit, random_limit = limits[j[:2]]
        if not overlaps and text_limit is not None and bin_of(j[3]) >= text_limit and j[2] >= least and (random_limit is None or bin_of(j[2]) < random_limit):
            out[i].append(("random", s, e))
    return {i: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(x, key=lambda x: (x[1], secrets.KINDS.index(x[0])))) for i, x in out.items()}


def test_spans_against_plain_python(spark):
    rng = random.Random(12)
    letters = {16: "0123456789ABCDEF", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "abcdefghijklmnopqrstuvwxyz0123456789", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    words = "handler internal request Controller abstract Factory session user23 index07 path/to/some/file2 value".split()
    texts = [None, "", "plain words", "AAAAAAAAAAAAAAAAAAAAAAAA1", "x" * 50000 + "1" + "y" * 100]
    for k, alphabet in letters.items():
        for n in (20, 24, 32, 40, 64, 90):
            texts += ["see " + "".join(rng.choice(alphabet) for _ in range(n)) + ("==" if k == 64 and n == 24 else "") + " here" for _ in range(6)]
    for _ in range(120):
        texts.append("name " + "".join(rng.choice(words) for _ in range(rng.randrange(3, 7))) + "2 end")
        texts.append("token=" + "".join(rng.choice(letters[64]) for _ in range(30)) + " " + "ab12" * rng.randrange(5, 20))
    texts += texts[5:9]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start int")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    want = plain_spans(texts)
    assert got == want
    assert sum("random" in s for s in want.values()) > 60
