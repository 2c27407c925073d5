import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import cases
from test_joins_and_archives import brute_components, brute_leaks, brute_spans

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tickloom.llm import jaccard_join, quality_rules, source_mix

DATA = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "jaccard_join", "decontaminate", "secret_ledger", "source_mix"]

    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    docs = cp.quality(spark, docs, DATA).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == kept and len(kept) > 100

    firsts = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
    docs = cp.near_duplicates(spark, docs, DATA).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == firsts

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    some = [r for r in docs.collect() if r.n_chars < 3000]
    clean = {r.doc_id for r in some if not brute_leaks(r.text, items)}
    docs = cp.benchmark_leaks(spark, docs, DATA).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} & {r.doc_id for r in some} == clean

    before = {r.doc_id: r for r in docs.collect()}
    docs = cp.secrets(spark, docs, DATA).cache()
    assert docs.columns == columns and docs.count() == len(before)
    for r in docs.collect():
        assert (r.text != before[r.doc_id].text) == bool(brute_spans(before[r.doc_id].text) or "[SECRET]" in r.text)
        assert r.n_chars == len(r.text) if r.text != before[r.doc_id].text else r == before[r.doc_id]

    plan = {r.doc_id: r.taken // r["size"] for r in source_mix.plan(docs).collect() if r["size"]}
    mixed = cp.mixture(spark, docs, DATA)
    assert mixed.columns == [*columns, "mix_copy"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in plan.items() if n})


def test_stages_take_awkward_rows(spark):
    for docs in (cases.docs(spark), cases.empty(spark)):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, DATA).count() >= 0


def test_run(spark):
    out = cp.run(spark, DATA)
    assert out.count() > 50 and set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "mix_copy"}


def test_stages_keep_columns_with_any_name(spark):
    """Each row carries the same mark in every extra column; after every stage the marks of a row still agree and belong to it."""
    rows = [*cases.rows(), *[(None, "the same words of a text without an id, said again and again", None, None, None, None, None, None)] * 3]
    base = spark.createDataFrame(rows, cases.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for names in (("_key", "_gone", "_gone_key", "_repeated", "before", "key", "class", "best"), ("_KEY", "_GONE", "_Repeated", "component_id", "n_shingles", "blob", "rate", "copy")):
        docs = base.withColumns({n: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text")) for n in names})
        marks = {(r.doc_id, r[names[0]]) for r in docs.collect()}
        for name, stage in cp.STAGES:
            out = stage(spark, docs, DATA)
            assert [c for c in out.columns if c != "mix_copy"] == docs.columns, name
            for r in out.collect():
                assert len({r[n] for n in names}) == 1 and (r.doc_id, r[names[0]]) in marks, (name, r)


def test_equal_rows_without_an_id_leave_one(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text, "a")] * 3 + [(5, "other words that nobody else has here", "b")], "doc_id long, text string, _repeated string")
    assert sorted(r["_repeated"] for r in jaccard_join.keep_first(docs).collect()) == ["a", "b"]
