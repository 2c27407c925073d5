import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import cases

from tickloom.llm import run_index


def brute(rows):
    first: dict[bytes, int] = {}
    key = lambda d: run_index.NULL_ID if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            g = b[i : i + 50]
            first[g] = min(first.get(g, run_index.NULL_ID), key(d))
    out = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_removals_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(20)) for _ in range(4)]
    extra = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))] + [rng.choice(passage)[rng.randrange(20) :] for _ in range(rng.randrange(3))] + [word()]
        rng.shuffle(parts)
        extra.append((300_000 + rng.randrange(10_000), " ".join(parts)))
    extra += [(400_000, "ab" * 400), (400_001, "ab" * 300), (400_002, "z" * 49), (400_003, "z" * 50), (400_004, "z" * 51), (400_004, "z" * 52), (None, "z" * 60), (7, "\0" * 120), (8, "\0" * 90)]
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(None if r[0] is None else r[0] + 100_000, r[1]) for r in cases.rows()]
    rows = base + odd + extra
    got = run_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_small_chunks_and_indexes(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(run_index, "CHUNK", 256)
    monkeypatch.setattr(run_index, "FLUSH", 50)
    monkeypatch.setattr(run_index, "INDEX_BYTES", 2000)
    base = "".join(rng.choice("abcd ") for _ in range(1500))
    rows = [(i, base[rng.randrange(700) : rng.randrange(800, 1500)] + str(i)) for i in range(12)]
    assert Counter(map(tuple, run_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)
    assert run_index.remove_repeats(cases.empty(spark)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    draw = lambda n, s: bytes(rng.choice(s) for _ in range(n))
    strings = [draw(rng.randrange(1, 120), b"abc") for _ in range(40)] + [b"a" * 100, b"ab" * 60, b"\0\0\1" * 20, b""]
    patterns = [draw(rng.randrange(1, 90), b"abcx") for _ in range(60)] + [s[3:60] + b"q" for s in strings[:20]] + [b"a" * 80, b"\0\0"]
    index = run_index.RunLengthIndex(strings, np.arange(len(strings)), length=8)
    for back, live, length, row in index.matches(patterns):
        for k, n, r in zip(live, length, row):
            p = patterns[k][len(patterns[k]) - back :]
            want = max(n for n in range(min(len(p), index.DEPTH) + 1) if any(p[:n] in s for s in strings))
            assert n == want
            if n >= 8:
                assert index.least[index.interval[r]] == min(i for i, s in enumerate(strings) if p[:8] in s)
    assert len(index.starts) < index.n / 2 or len(index.starts) <= index.n


def test_anchors_agree_on_equal_strings():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 120, 50).astype(np.uint8)
    for _ in range(50):
        data = [np.concatenate([rng.integers(97, 120, rng.integers(0, 80)), shared, rng.integers(97, 120, rng.integers(0, 80))]).astype(np.uint8) for _ in range(2)]
        assert set(run_index.anchors(data[0])[1].tolist()) & set(run_index.anchors(data[1])[1].tolist())
