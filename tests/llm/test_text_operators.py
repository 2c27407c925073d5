import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from tickloom.llm import quality_rules, source_mix, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_quality_counts_equal_brute_force(spark):
    docs = cases.docs(spark).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    got = Counter(tuple(r)[:7] for r in quality_rules.judge(docs).collect())
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())


def test_quality_verdict(spark):
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert not any(r.kept for r in rows if r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    pairs = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    good, bad = [k for k, q in pairs if q == 1], [k for k, q in pairs if q == 0]
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.5 * len(bad)


def test_quality_filter_keeps_columns(spark):
    out = quality_rules.apply_rules(cases.docs(spark))
    assert out.columns == cases.docs(spark).columns
    assert quality_rules.judge(cases.empty(spark)).count() == 0 and quality_rules.apply_rules(cases.empty(spark)).count() == 0


def test_mix_targets_and_copies(spark):
    docs = cases.docs(spark)
    rows = source_mix.plan(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in source_mix.targets(docs.select("source", source_mix.size_of(docs.text).alias("size"))).collect()}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-9 for s, t in targets.values())
    assert {(r.source_size, r.target) for r in rows} == set(targets.values())
    assert all(r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in rows)
    mixed = source_mix.mix(docs)
    assert Counter(r.doc_id for r in mixed.collect())[8] == next(r.taken // r["size"] for r in rows if r.doc_id == 8)
    assert mixed.columns == [*docs.columns, "mix_copy"]
    assert source_mix.plan(cases.empty(spark)).count() == 0


def test_mix_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100)], "source string, size long")
    got = {r.source: r.target for r in source_mix.targets(sizes).collect()}
    # 315 in all; a stops at 20, the other 295 go 2 to 1, so b stops at 196.67
    assert got == pytest.approx({"a": 20.0, "b": 295 * 2 / 3, "c": 295 / 3})


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = cases.docs(spark).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False)), n > 512) for r in docs.collect())
    assert sorted((r[0] or -1, *r[1:]) for r in map(tuple, token_counts.count_tokens(docs, path).collect())) == want
    for text in (cases.LONG, "a  b" * 3000, "it 's <|endoftext|> x\xa0 y " * 900):
        assert "".join(token_counts.pieces(text, 50)) == text
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in token_counts.pieces(text, 50)) == len(t.encode(text, add_special_tokens=False))
