"""Periodic runs against a plain loop over all periods, digests included."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from tickloom.llm import common, period_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All runs, period by period; a stretch found before with a shorter period is not one of a longer."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q):
                found.setdefault((start, end + q), q)
            start = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = looped(doc_id, WORD.findall(text or ""))
    runs = plain_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def made_texts():
    rng = random.Random(3)
    for i in range(400):
        letters = "ab" if i % 3 else "abcdefgh"
        base = [rng.choice(letters) for _ in range(rng.randint(1, 40))]
        block = base * rng.randint(1, 9)
        if i % 4 == 0:  # a run inside a run
            block = (block[: rng.randint(1, len(block))] * 5 + [rng.choice("xyz")]) * rng.randint(1, 6)
        yield " ".join([rng.choice(letters) for _ in range(rng.randint(0, 9))] + block + [rng.choice(letters) for _ in range(rng.randint(0, 9))])
    for q in (5, 8, 9, 16, 17, 31, 32, 33, 64, 65, 127, 128, 129):  # four periods exactly, and one word less
        unit = [f"w{rng.randint(0, 4 * q)}" for _ in range(q)]
        yield " ".join(["x", *unit * 4, "y"])
        yield " ".join(["x", *(unit * 4)[:-1], "y"])


def test_runs_equal_a_plain_loop(spark):
    texts = [*made_texts(), *cases.TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    rows = {r.doc_id: r for r in period_runs.detect(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = plain_runs(words)
        assert [tuple(r) for r in rows[i].runs] == runs
        assert rows[i].collapsed == collapsed(words, runs)


def test_groups_of_texts_do_not_touch():
    codes = np.zeros(12, np.int64)
    assert period_runs.runs_of(codes, np.array([6, 0, 5, 1])).tolist() == [[0, 0, 6, 1]]
    assert period_runs.runs_of(codes[:0], np.array([0, 0])).shape == (0, 4)
    with pytest.raises(ValueError):
        period_runs.runs_of(codes, np.array([12]), repeats=3)
    texts = pa.array(["x" * n for n in (3, 9, 1, 1, 20, 0)])
    assert list(common.byte_groups(texts, 4)) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6)]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_period_runs(spark, f"/root/testdata/{size}").collect())
    if size == "sf0.01":  # the longest texts take the plain loop minutes
        short = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 12_000}
        assert len(got) == docs.count()
        got = [r for r in got if r[0] in short]
    else:
        short = {r.doc_id: r.text for r in docs.collect()}
    assert got == sorted(expected(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    looped_docs = docs.withColumn("text", period_runs.with_loops(docs.doc_id, docs.text))
    got = period_runs.digest_rows(period_runs.detect(looped_docs))
    assert cases.bag(got) == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert period_runs.digest_rows(period_runs.detect(cases.empty(spark))).count() == 0
