import brute
import corpus_pipeline as cp
from conftest import DATA
from pyspark.sql import functions as F

from rolloom.llm import quality_rules

D = f"{DATA}/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    state, seen = docs, []
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, state, D)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        state = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id: r for r in state.collect()})
    kept = {r.doc_id for r in quality_rules.evaluate(docs).where("kept").collect()}
    assert set(seen[0]) == kept and all(seen[0][i] == rows[i] for i in kept)
    ids = sorted(kept)
    roots = brute.components([brute.shingles(rows[i].text) for i in ids])
    assert set(seen[1]) == {i for k, i in enumerate(ids) if roots[k] == k}
    bad = {r[0] for r in brute.contamination([(i, r.text) for i, r in seen[1].items()], bench) if r[5]}
    assert set(seen[2]) == set(seen[1]) - bad
    assert set(seen[3]) == set(seen[2])
    for i, r in seen[3].items():
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        if not brute.base_spans(rows[i].text) and "[SECRET]" not in r.text:
            assert r.text == rows[i].text
    pieces = cp.STAGES[-1][1](spark, state, D).collect()
    assert {r.doc_id for r in pieces} == set(seen[3])


def test_edges(spark, tmp_path):
    long = "alpha beta gamma delta " + " ".join(f"u{i} v{i}" for i in range(200))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (None, long, None, None, None), (2, None, "en", None, 0), (3, "", "en", "s", 0), (0, long + " x", "en", "s", 1), (9, long[::-1] + " token=abcdefghijklmnop1", "en", "s", 3)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, D).collect()) == [0, 2, 3, 9]
    assert {r.doc_id for r in cp.quality(spark, docs, D).collect()} == {0, 1, 9, None}
    assert cp.decontaminated(spark, docs, D).count() == 7
    out = {r.doc_id: r for r in cp.without_secrets(spark, docs, D).where("doc_id > 1").collect()}
    assert out[9].text.endswith("[SECRET]") and out[9].n_chars == len(out[9].text) and out[2].text is None
    empty = docs.where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, empty, D).count() == 0


def test_clashing_names_long_texts_and_missing_columns(spark, tmp_path):
    """Columns that have the operators' own names come back as they were."""
    clean = " ".join(f"a{i} b{i}" for i in range(300))
    rows = [(1, clean, "en", "s", f"v{1}"), (2, clean + " token=abcdefghijklmnop1", "en", "s", "v2"), (3, " ".join(f"x{i}" for i in range(60_000)), "en", "s", "v3"), (4, None, None, None, "v4")]
    names = ["_rid", "_rid_", "_text", "_spans", "span_list", "rid", "label", "kept", "pool", "w", "rank", "n", "piece", "places"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mine string").withColumns({n: F.col("mine") for n in names})
    path = str(tmp_path / "d")
    docs.coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[n] == f"v{r.doc_id}" for r in got for n in names), name
        assert sorted(r.doc_id for r in got) == ([1, 2, 3] if k == 0 else [1, 3, 4] if k == 1 else [1, 2, 3, 4]), name
    redacted = {r.doc_id: r.text for r in cp.without_secrets(spark, docs, D).collect()}
    assert redacted[2] == clean + " [SECRET]" and redacted[1] == clean
    assert {r.doc_id for r in cp.packed(spark, docs, D).collect()} == {1, 2, 3, 4}


def test_rows_that_go_are_broadcast_as_bits(spark, tmp_path, monkeypatch):
    from test_jaccard import broadcast_rows

    docs = spark.range(0, 8000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.expr("id div 2")).alias("text"))
    docs.write.parquet(str(tmp_path / "d"))
    sent = broadcast_rows(monkeypatch)
    got = cp.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), D)
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 8000, 2))
    assert max(sent) <= 400  # of 4,000 that go


def test_many_secrets_move_only_their_rows(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}" + (f" password = abcdefghij{i:06d}" if i % 3 == 0 else ""), i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(2)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    few = sorted(cp.without_secrets(spark, docs, D).collect())
    monkeypatch.setattr(cp, "MAX_BROADCAST", -1)
    assert sorted(cp.without_secrets(spark, docs, D).collect()) == few
    assert sum("[SECRET]" in r.text for r in few) == 30
