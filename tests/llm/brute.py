"""Plain Python versions of the contracts, one document at a time."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_spans(text):
    text = text or ""
    out = []
    for k, (p, least, group) in enumerate((
        (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
        (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group(group)) >= least]
    kinds = ("assign", "access", "hex")
    return [(kinds[k], s, e) for s, k, e in sorted(out)]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    grams = {}
    for i, t in items:
        w = bench_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w, hit, seen = bench_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    seen |= found
                    hit.update(range(k, k + n))
        sha = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(seen), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(sets):
    """Smallest index of each component; sets by index."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]
