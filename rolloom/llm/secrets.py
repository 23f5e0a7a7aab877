"""Secret scans with a randomness test battery (DataFrame operations only).

Base spans come from three patterns. The battery looks at further tokens (runs of
20 or more letters, digits, ``+`` and ``/`` that hold a digit and a letter): the
encoding is inferred (hexadecimal, base32, lower-case or mixed alphanumeric,
base64), each character becomes its place in that alphabet, and three tests ask
whether the places look random: chi-squared uniformity over bins of the alphabet
(more bins for longer tokens), Wald-Wolfowitz runs about the middle, and lag-one
serial correlation. Fisher's method combines them; a token that looks
non-random is dropped.

The false-discovery rate is controlled at ``fdr`` by the Benjamini-Hochberg rule,
twice, within each encoding and length class (powers of two):
* over the battery's p-values, hypothesis "random": tokens found non-random are
  dropped (as is any token below the fixed floor ``least_random``);
* over p-values against written text in the token's own encoding, hypothesis
  "text": only tokens found not to be text are reported. Text is a chain over the
  encoding's classes (small letters, capitals, digits, signs) that changes class at
  a rate of 0.15, with letters by their frequency in European languages. The ratio
  of its likelihood to that of random places is a valid p-value (Markov), and it has
  power also where an encoding changes class rarely (base32, capital hexadecimal).
The rule works on counts of p-values in a bounded number of bins, so no task sorts
all tokens.

Positions: between two matches lie the pieces that ``split`` gives, so a running
sum of lengths over the matches of a row and kind gives starts in code points.

Defined results: a null text counts as empty; a text without spans has an empty
span list (and the SHA-256 of the empty string); very long texts are scanned whole;
spans that begin at one place are listed by kind; repeated rows are scanned each; null
ids are carried through; an empty table gives an empty result; other columns are
ignored, whatever their names. Tokens that overlap a base span are not reported again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloom.llm.columns import total
from rolloom.session import materialize, prepare

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "random": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{20,}={0,2}",
}
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 20}
ALPHABETS = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 16),
    (r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 32),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 36),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64),
)
#: Share of class changes in written tokens, under the hypothesis to reject.
TEXT_CHANGES = 0.15
#: Letters a to z in per mille of written text (the mean of English, German, French and Spanish), and the share of letters at random in it, for names.
TEXT_LETTERS = (85, 16, 32, 45, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 61, 19, 6, 66, 74, 68, 40, 12, 11, 2, 8, 5)
TEXT_NOISE = 0.1


def _matches(text: Column, kind: str) -> Column:
    """Structs (kind, k, gap, value, size) of all matches of a kind, null where there is none."""
    p = PATTERNS[kind]
    group = 2 if kind == "assign" else 0
    gaps = F.transform(F.split(text, p, -1), lambda x: F.char_length(x))
    full = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    tail = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(group)), lambda x: F.char_length(x))
    both = F.zip_with(gaps, F.zip_with(full, tail, lambda a, b: F.struct(a.alias("v"), b.alias("s"))), lambda g, m: F.struct(F.lit(kind).alias("kind"), g.alias("gap"), m.v.alias("value"), m.s.alias("size")))
    return F.when(text.rlike(p), F.filter(both, lambda x: x["value"].isNotNull()))


def _phi(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.070566 * z * z * z))


def _text_model(letters: str) -> tuple[int, list[float]]:
    """Classes of an alphabet, and for each character the log of its chance at random over that within its class of written text."""
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in letters]
    mass = [TEXT_LETTERS[ord(c.lower()) - 97] / sum(TEXT_LETTERS) * (1 - TEXT_NOISE) + TEXT_NOISE / 26 if c.isalpha() else 1.0 for c in letters]
    whole = {x: sum(m for m, y in zip(mass, kind, strict=True) if y == x) for x in kind}
    return len(whole), [math.log(whole[x] / m / len(letters)) for m, x in zip(mass, kind, strict=True)]


def _tested(tokens: DataFrame) -> DataFrame:
    """Adds p_random (combined) and p_text to rows with a column ``value``; k, the size of the alphabet, names the encoding."""
    bare = F.regexp_replace("value", "=+$", "")
    df = tokens.withColumn("bare", bare)
    alphabet, folded, k = F.lit(ALPHABETS[-1][1]), F.col("bare"), F.lit(ALPHABETS[-1][2])
    for pattern, letters, size in reversed(ALPHABETS[:-1]):
        is_it = F.col("value").rlike(pattern)
        alphabet, k = F.when(is_it, F.lit(letters)).otherwise(alphabet), F.when(is_it, F.lit(size)).otherwise(k)
        folded = F.when(is_it, F.lower("bare")).otherwise(folded)
    df = df.withColumns({"alphabet": alphabet, "folded": folded, "k": k, "n": F.length("bare")})
    df = df.withColumn("at", F.transform(F.filter(F.split("folded", "", -1), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c) - 1))
    df = df.withColumn("u", F.transform("at", lambda x: (x + 0.5) / F.col("k") - 0.5)).withColumn("bins", F.when(F.col("n") < 40, 4).when(F.col("n") < 80, 8).otherwise(16))
    df = df.withColumn("cell", F.transform("u", lambda x: F.floor((x + 0.5) * F.col("bins")).cast("int")))
    counts = F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda b: F.size(F.filter("cell", lambda c: c == b)))
    # The share of the alphabet in a bin is not exactly 1 / bins where the sizes do not divide; expectations follow the alphabet.
    places = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.floor((i + 0.5) / F.col("k") * F.col("bins")).cast("int"))
    df = df.withColumns({"counts": counts, "places": places})
    expected = F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda b: F.size(F.filter("places", lambda c: c == b)) * F.col("n") / F.col("k"))
    df = df.withColumn("expected", expected)
    chi2 = F.aggregate(F.zip_with("counts", "expected", lambda o, e: (o - e) * (o - e) / e), F.lit(0.0), lambda a, x: a + x)
    d = F.col("bins") - 1
    wilson = (F.pow(chi2 / d, 1 / 3) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    high = F.transform("u", lambda x: (x > 0).cast("int"))
    df = df.withColumns({"p_chi": 1 - _phi(wilson), "high": high})
    pairs = F.zip_with(F.slice("high", 1, F.col("n") - 1), F.slice("high", 2, F.col("n") - 1), lambda a, b: (a != b).cast("int"))
    n1 = F.aggregate("high", F.lit(0), lambda a, x: a + x).cast("double")
    df = df.withColumns({"changes": F.aggregate(pairs, F.lit(0), lambda a, x: a + x) + 1, "n1": n1, "n0": F.col("n") - n1})
    mean = 2 * F.col("n1") * F.col("n0") / F.col("n") + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (F.col("n") - 1), F.lit(1e-9)))
    product = F.zip_with(F.slice("u", 1, F.col("n") - 1), F.slice("u", 2, F.col("n") - 1), lambda a, b: a * b)
    sum_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    serial = sum_of(product) / F.greatest(sum_of(F.transform("u", lambda x: x * x)), F.lit(1e-9)) * F.sqrt("n")
    two_sided = lambda z: F.greatest(2 * (1 - _phi(F.abs(z))), F.lit(1e-12))
    df = df.withColumns({"p_runs": two_sided((F.col("changes") - mean) / spread), "p_serial": two_sided(serial), "p_chi": F.greatest("p_chi", F.lit(1e-12))})
    x = -total(F.log(c) for c in ("p_chi", "p_runs", "p_serial"))
    # Changes of class between neighbours: small letters a, capitals A, digits 0.
    classes = F.translate("bare", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "a" * 26 + "A" * 26 + "0" * 10 + "++")
    chars = F.filter(F.split(classes, "", -1), lambda c: c != "")
    df = df.withColumns({"p_random": F.exp(-x) * (1 + x + x * x / 2), "chars": chars})
    moved = F.zip_with(F.slice("chars", 1, F.col("n") - 1), F.slice("chars", 2, F.col("n") - 1), lambda a, b: (a != b).cast("int"))
    df = df.withColumn("moved", F.aggregate(moved, F.lit(0), lambda a, c: a + c))
    weights, n_classes = F.lit(None).cast("array<double>"), F.lit(None).cast("int")
    for _, letters, size in ALPHABETS:
        held, ratios = _text_model(letters)
        weights, n_classes = F.when(F.col("k") == size, F.array(*map(F.lit, ratios))).otherwise(weights), F.when(F.col("k") == size, held).otherwise(n_classes)
    df = df.withColumns({"weights": weights, "n_classes": n_classes})
    chain = F.col("moved") * F.log(TEXT_CHANGES / (F.col("n_classes") - 1)) + (F.col("n") - 1 - F.col("moved")) * math.log(1 - TEXT_CHANGES)
    ratio = sum_of(F.transform("at", lambda x: F.get("weights", x))) + F.log("n_classes") - chain
    return df.withColumn("p_text", F.exp(-F.greatest(ratio, F.lit(0.0))))


def _bin(p: str) -> Column:
    """All p-values of a bin are at most 2^(-bin / 4)."""
    return F.least(F.floor(-4 * F.log2(F.greatest(p, F.lit(1e-30)))), F.lit(400)).cast("int")


def _limits(tested: DataFrame, bin_col: str, fdr: float, name: str) -> DataFrame:
    """k, size_class and the least bin that the Benjamini-Hochberg rule rejects, null if it rejects none."""
    bins = tested.groupBy("k", "size_class", F.col(bin_col).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("k", "size_class")
    bins = bins.withColumns({"below": F.sum("n").over(up.orderBy(F.desc("bin"))), "all": F.sum("n").over(up)})
    return bins.groupBy("k", "size_class").agg(F.min(F.when(F.pow(F.lit(2.0), -F.col("bin") / 4) <= fdr * F.col("below") / F.col("all"), F.col("bin"))).alias(name))


def spans(docs: DataFrame, fdr: float = 0.01, least_random: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, kind, start, end: one row per span, and one with null kind for rows without any."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.concat(*[F.coalesce(_matches(F.col("text"), kind), F.array().cast("array<struct<kind:string,gap:int,value:string,size:int>>")) for kind in KINDS])
    flat = rows.select("rid", "doc_id", F.posexplode_outer(found).alias("k", "x")).select("rid", "doc_id", "k", "x.*")
    width = F.char_length("value")
    before = Window.partitionBy("rid", "kind").orderBy("k")
    flat = flat.withColumn("end", F.sum(F.col("gap") + width).over(before)).withColumn("start", F.col("end") - width)
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])
    flat = materialize(flat.withColumn("kind", F.when(F.col("size") >= least[F.col("kind")], F.col("kind"))).drop("gap", "size", "k"))

    tested = materialize(_tested(flat.where("kind = 'random'")).select(
        "rid", "start", "k", "p_random", F.floor(F.log2(F.col("n"))).alias("size_class"), _bin("p_random").alias("random_bin"), _bin("p_text").alias("text_bin")))
    limits = _limits(tested, "text_bin", fdr, "text_limit").join(_limits(tested, "random_bin", fdr, "random_limit"), ["k", "size_class"])
    is_random = (F.col("p_random") >= least_random) & F.coalesce(F.col("random_bin") < F.col("random_limit"), F.lit(True))
    chosen = tested.join(F.broadcast(limits), ["k", "size_class"]).where((F.col("text_bin") >= F.col("text_limit")) & is_random).select("rid", "start", F.lit(True).alias("chosen"))
    marked = flat.join(chosen.withColumn("kind", F.lit("random")), ["rid", "kind", "start"], "left")
    base = F.col("kind") != "random"
    order = Window.partitionBy("rid").orderBy("start", "end")
    marked = marked.withColumns({
        "base_end": F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "base_start": F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    clear = (F.coalesce(F.col("base_end"), F.lit(-1)) <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end")))
    keep = base | (F.col("chosen") & clear)
    return marked.select("rid", "doc_id", F.when(keep, F.col("kind")).alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and the sorted list span_list of every row."""
    rank = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))
    rows = spans(docs, **options).groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(one)).alias("list"), *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS[:3]])
    name = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    base = F.array_join(F.transform(F.filter("list", lambda x: x.kind != "random"), name), ",")
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("list", name), ",").alias("spans"),
        F.transform("list", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("span_list"))


def redacted(text: Column, span_list: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans (sorted structs start, end) put out by the mark. What is between stretches is cut out once."""
    zero = F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("gaps"), F.lit(0).alias("at"))
    gap = lambda start, stop: F.array(F.struct(start.alias("start"), stop.alias("stop")))
    step = lambda acc, s: F.when(s.start >= acc.at, F.struct(F.concat(acc.gaps, gap(acc.at, s.start)).alias("gaps"), s.end.alias("at"))).otherwise(F.struct(acc.gaps.alias("gaps"), F.greatest(acc.at, s.end).alias("at")))
    gaps = F.aggregate(span_list, zero, step, lambda acc: F.concat(acc.gaps, gap(acc.at, F.length(text))))
    return F.array_join(F.transform(gaps, lambda g: F.substring(text, g.start + 1, g.stop - g.start)), mark)
