"""Collocations against plain counters, with every way of counting forced."""

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases

from tickloom.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count=10, longest=3, cover=50, top=2000):
    """rows: (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, words[i : i + m]] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    around = Counter()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                around[lang, words[i : i + m]] = max(around[lang, words[i : i + m]], a)
    out = {}
    for (lang, words), a in candidates.items():
        if 100 * around[lang, words] >= cover * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"broadcast_ids": 40, "tile": 8}, {"broadcast_ids": 3, "tile": 2}, {"longest": 4, "broadcast_ids": 200, "top": 50, "min_count": 5}, {"longest": 2}])
def test_mine_equals_plain_counters(spark, limits):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(cases.docs(spark), allowMissingColumns=True).repartition(5)
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = plain(rows, limits.get("min_count", 10), limits.get("longest", 3), top=limits.get("top", 2000))
    assert len(want) > 100
    assert got(collocations.mine(docs, **limits)) == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet/*.parquet'" if Path("/root/testdata/sf0.001/documents.parquet").is_dir() else "CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = queries.op12_collocations(spark, "/root/testdata/sf0.001")
    want = con.sql(queries.OP12_SQL)
    assert df.columns == want.columns
    assert got(df) == sorted(want.fetchall())


def test_filter_holds_what_is_left(spark):
    rest = spark.createDataFrame([("x", f"a{i}", None, None) for i in range(50)] + [(None, None, i, 7 * i) for i in range(50)], "lang string, phrase string, left long, right long")
    empty = rest.limit(0).withColumns({"id": F.lit(0).cast("long")}).toArrow()
    bits = collocations.level(empty, collocations.filter_of(rest).toArrow())["bits"]
    assert bits.sum() > 0 and 50 < sum(bin(int(b)).count("1") for b in bits[bits > 0]) <= 100
    words = collocations.Words("x", pa.array(["a1 a49 b1"]))
    empty_level = {"names": {}, "keys": np.empty(0, np.int64), "ids": np.empty(0, np.int64), "bits": bits}
    assert words.maybe([empty_level], 1, np.full(4, -1)).tolist() == [True, True, False, False]
    i = np.arange(50)
    assert collocations._in_filter(bits, (i * 2654435761 + 7 * i * 2246822519) >> 7).all()


def test_tiles_are_dense_or_sparse():
    rng = np.random.default_rng(1)
    counts = collocations.TileCounts(tile=4, dense_tiles=2, dense_hits=20)
    want = Counter()
    for _ in range(5):
        left, right = rng.zipf(1.5, 300) % 50, rng.zipf(1.5, 300) % 50
        counts.add(left, right)
        want.update(zip(left.tolist(), right.tolist()))
    assert len(counts.dense) == 2
    found = Counter()
    for keys, n in counts.take():
        for key, c in zip(keys.tolist(), n.tolist()):
            found[key >> 32, key & 0xFFFFFFFF] += c
    assert found == want and sum(len(n) for _, n in counts.take()) == 0


def test_awkward_rows(spark):
    assert collocations.mine(cases.empty(spark)).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("x", "")], "lang string, text string")).count() == 0
    rows = [(None, "A b. A b, a B")] * 3 + [("und", "a\tb \x0b ä b")] * 2 + [("xx", "Ä b c " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(collocations.mine(docs)) == plain(rows)
    assert collocations.mine(docs.selectExpr("lang AS _part", "text AS _place"), "_part", "_place").count() == len(plain(rows))


def test_large_counts_are_exact(spark):
    big = 9_000_000_000_000_000
    words = spark.createDataFrame([("x", "a", big), ("x", "b", big)], "lang string, phrase string, f long")
    pair = spark.createDataFrame([("x", "a b", big - 1)], "lang string, phrase string, f long")
    assert [tuple(r) for r in collocations._scored(pair, {1: words}, 2).collect()] == [("x", "a b", big - 1, big, big, 1000000 * (big - 1) ** 2 // big**2)]
