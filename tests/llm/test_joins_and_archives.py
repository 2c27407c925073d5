import gzip
import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from tickloom.llm import components, decontaminate, jaccard_join, langid, secret_ledger, warc_assembly

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def tables(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def with_cases(spark):
    odd = cases.docs(spark)
    return odd.withColumn("doc_id", odd.doc_id + 100_000).unionByName(tables(spark), allowMissingColumns=True)


# ---- secrets


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for *_, s in sorted(out)]


def test_secrets_equal_brute_force(spark):
    docs = with_cases(spark).unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), allowMissingColumns=True)
    want = Counter()
    for r in docs.collect():
        s = brute_spans(r.text)
        kinds = Counter(x.split(":")[0] for x in s)
        want[(r.doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
    rows = secret_ledger.report(docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 5
    assert secret_ledger.report(cases.empty(spark)).count() == 0


def test_ledger_scans_only_unseen_blobs(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    docs = tables(spark)
    first = secret_ledger.scan(docs.where("doc_id % 2 = 0"), path).count()
    every = secret_ledger.scan(docs, path)
    assert first < every.count() == docs.select("text").distinct().count() == every.select("blob").distinct().count()
    secret_ledger.scan(docs, path)
    assert spark.read.parquet(path).count() == every.count()
    assert secret_ledger.scan(docs, path, version="rules-2").count() == every.count()
    assert cases.bag(secret_ledger.report(docs, path)) == cases.bag(secret_ledger.report(docs))


def test_redaction(spark):
    docs = with_cases(spark)
    out = secret_ledger.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    left = [r for r in secret_ledger.report(out).collect() if r.n_hex or r.n_access]
    assert not left
    before = {r.doc_id: r.text for r in docs.where("doc_id <> 100003").collect()}
    for r in out.where("doc_id <> 100003").collect():
        assert r.text == before[r.doc_id] if not brute_spans(before[r.doc_id]) else "[SECRET]" in r.text


# ---- archives


def test_archive_round_trip(spark):
    pages = tables(spark, "pages").unionByName(spark.createDataFrame(
        [(9001, "http://a.example/x y", None), (9002, None, ""), (None, "http://b.example", "täg\r\n\r\nWARC/1.0\r\nx"), (9003, "u", "täg\r\n\r\nWARC/1.0\r\nx"), (9003, "u", "täg\r\n\r\nWARC/1.0\r\nx"), (9004, "big", "z" * 300_000)],
        "page_id long, url string, html string"))
    got = warc_assembly.digest_rows(warc_assembly.round_trip(pages)).collect()
    rows = pages.collect()
    import base64

    top = {}
    for r in rows:
        if r.page_id is not None:
            top[r.html or ""] = max(top.get(r.html or "", -1), r.page_id)
    want = Counter((r.page_id, len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()) for r in rows)
    assert Counter(tuple(r)[:3] for r in got) == want
    content = {(r.page_id): r.html or "" for r in rows}
    for r in got:
        if r.page_id != 9003:
            best = top.get(content[r.page_id])
            assert (r.record_type, r.refers_to) == (("response", None) if best == r.page_id else ("revisit", best))
    assert Counter(r.record_type for r in got if r.page_id == 9003) == {"response": 1, "revisit": 1}
    assert warc_assembly.round_trip(pages.limit(0)).count() == 0


def test_parser_reads_members_and_payloads(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: 28\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nxyz\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = warc_assembly.read_records(spark, str(tmp_path)).collect()
    assert [(r.type, r.payload_bytes, bytes(r.payload)) for r in rows] == [("response", 3, b"xyz")] * 2


# ---- Jaccard join


def brute_components(rows, width, percent):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            holders[t].append(i)
    pairs = {(i, j) for h in holders.values() for j in h for i in h if i < j}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[root(i)].append(doc)
    return Counter((doc, len(sets[i]), min((d for d in groups[root(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows))


def near_copies(seed, n, edits, length=60, words=400):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(words)}" for _ in range(length)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(length)] = f"w{rng.randrange(words)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    texts = near_copies(1, 60, 3) + near_copies(2, 30, 2, 25) + near_copies(3, 40, 1, 12, 30) + near_copies(4, 20, 6, 300) + near_copies(5, 30, 1, 6, 12) + near_copies(6, 20, 1, 3, 4)
    extra = spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = with_cases(spark).select("doc_id", "text").unionByName(extra)
    got = Counter(tuple(r)[:3] for r in jaccard_join.components(docs, width=width, percent=percent).collect())
    want = brute_components([tuple(r) for r in docs.collect()], width, percent)
    assert got == want
    assert len({c for _, _, c in got}) < len(got)


def test_sets_that_share_a_line_are_filed_again_once(spark, monkeypatch):
    """Many sets under one leader, most of them linked to none: rounds do not grow with their number, and blocks find all links."""
    rng = random.Random(7)
    line = " ".join(f"c{i}" for i in range(34))
    texts = [f"{line} " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(26)) for _ in range(90)]
    texts += [t.rsplit(" ", k)[0] + " end" * k for t in texts[:40:4] for k in (1, 2)]  # near copies
    texts += [f"{line} {' '.join(f'y{i + k}' for i in range(26))}" for k in range(0, 40, 2)]  # a chain: each is near the next
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute_components(rows, 5, 80)
    assert 80 < len({c for _, _, c in want}) < 110
    docs, rounds, led = spark.createDataFrame(rows, "doc_id long, text string"), [], jaccard_join._led

    def counted(*args, **names):
        rounds.append(1)
        assert len(rounds) <= 2, "filed again more than once"
        return led(*args, **names)

    monkeypatch.setattr(jaccard_join, "_led", counted)
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    for blocks, tokens in ((1, 1 << 22), (1, 200), (1000, 1 << 22), (1000, 200)):
        monkeypatch.setattr(jaccard_join, "BLOCKS", blocks, raising=False)
        monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
        rounds.clear()
        assert Counter(tuple(r)[:3] for r in jaccard_join.components(docs, width=5, percent=80).collect()) == want
        assert len(rounds) == 1 + ((blocks, tokens) != (1000, 1 << 22))


def test_keep_first_and_empty(spark):
    docs = with_cases(spark)
    kept = jaccard_join.keep_first(docs)
    found = jaccard_join.components(docs, width=5, percent=80).collect()
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in found if r.doc_id is not None and r.component_id is not None and r.component_id < r.doc_id}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in gone)
    assert jaccard_join.components(cases.empty(spark)).count() == 0


def test_keep_first_with_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, c), (None, c + " more"), (5, d), (5, d + " more"), (6, d), (None, d), (None, ""), (None, None), (9, "")]
    kept = [tuple(r) for r in jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    group = lambda r: (r[0], (r[1] or "-").split(" ")[0])
    assert Counter(map(group, kept)) == Counter([(3, "a0"), (7, "b0"), (None, "c0"), (5, "d0"), (None, "-"), (None, "-"), (9, "-")])


def test_connected_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# ---- decontamination


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    stored = rng.integers(0, 2**63, 300, dtype=np.uint64)
    asked = stored.copy()
    for i in range(len(asked)):
        for b in rng.choice(64, rng.integers(0, 20), replace=False):
            asked[i] ^= np.uint64(1 << int(b))
    q, s = decontaminate.HammingIndex(stored).query(asked)
    distance = np.bitwise_count(asked[:, None] ^ stored[None, :])
    assert set(zip(q.tolist(), s.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS))))


def brute_leaks(text, items, percent=80):
    words, out = decontaminate.words_of(text), {}
    for item, body in items:
        iw = decontaminate.words_of(body)
        width = min(5, len(iw))
        span = min(len(iw), len(words))
        if not width or span < width:
            continue
        bag = Counter(tuple(iw[i : i + width]) for i in range(len(iw) - width + 1))
        for s in range(len(words) - span + 1):
            mine = Counter(tuple(words[i : i + width]) for i in range(s, s + span - width + 1))
            a, b = sum((mine & bag).values()), sum((mine | bag).values())
            if 100 * a >= percent * b:
                out[item] = max(out.get(item, 0), a / b)
    return out


def test_leaks_equal_brute_force(spark):
    items = [(r.item_id, r.text) for r in tables(spark, "benchmark").collect()][:25] + [(900, "three short words"), (901, None), (902, "")]
    rng = random.Random(3)
    docs = [(r.doc_id, r.text[:3000]) for r in tables(spark).collect()][:40]
    for i, (_, t) in enumerate(items[:25]):
        w = t.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        docs.append((5000 + i, f"before it {' '.join(w)} and after it"))
    docs += [(6000, None), (6001, ""), (6002, "it has Three SHORT words."), (None, items[0][1])]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i): s for d, t in docs for i, s in brute_leaks(t, items).items()}
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(want)
    assert len(want) > 10


def borderline(n=600, length=200, changed=17):
    """Items, and documents with them in which a run of words in the middle differs: similarity 175 / 217."""
    rng = random.Random(5)
    make = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    items = [make(length) for _ in range(n)]
    return [(i, " ".join(w)) for i, w in enumerate(items)], [" ".join(make(20) + w[: length // 2] + make(changed) + w[length // 2 + changed :] + make(20)) for w in items]


def test_leaks_beyond_the_radius_are_found():
    items, docs = borderline()
    searcher = decontaminate.Searcher(items)
    zero = np.zeros(1, np.int64)
    print_of = lambda words: decontaminate.fingerprints(searcher.hashes(words), zero, 200)
    apart = [int(np.bitwise_count(print_of(text.split()) ^ print_of(doc.split()[20:220]))[0]) for (_, text), doc in zip(items, docs)]
    assert max(apart) > decontaminate.RADIUS
    assert [i for i, doc in enumerate(docs) if i not in searcher.search(doc)] == []
    for i in range(0, 600, 200):
        assert {k: v[0] for k, v in searcher.search(docs[i]).items()} == pytest.approx(brute_leaks(docs[i], items[i : i + 1]))


def test_repeated_shingles_count_as_often_as_the_item_has_them():
    items = [(1, "a " * 12 + "b c d e f g h i"), (2, "a " * 20), (3, "x y z " * 7), (4, "a b " * 10)]
    searcher = decontaminate.Searcher(items)
    for text in ("a " * 60, "a " * 40 + "b c d e f g h i j k", "x y z " * 30, "b a " * 25, "a " * 11 + "b c d e f g h i " * 3):
        assert {k: v[0] for k, v in searcher.search(text).items()} == pytest.approx(brute_leaks(text, items))


def test_drop_leaks(spark):
    docs = with_cases(spark)
    found = {r.doc_id for r in decontaminate.find_leaks(docs, tables(spark, "benchmark")).collect()}
    kept = decontaminate.drop_leaks(docs, tables(spark, "benchmark"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in docs.collect() if r.doc_id not in found)
    assert decontaminate.find_leaks(cases.empty(spark), tables(spark, "benchmark")).count() == 0
    assert decontaminate.find_leaks(docs, tables(spark, "benchmark").limit(0)).count() == 0


# ---- language


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(got[r.doc_id], r.lang) for r in docs.collect() if got[r.doc_id].held_out and r.lang]
    assert len(got) == 1000 and sum(g.lang_pred == lang for g, lang in held) > 0.95 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_cases(spark):
    rows = langid.identify(with_cases(spark)).collect()
    assert len(rows) == with_cases(spark).count()
    assert {r.lang_pred for r in rows if r.doc_id in (100_000, 100_001, 100_002)} == {"und"}
    assert langid.identify(cases.empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(tables(spark).selectExpr("doc_id", "text", "cast(null as string) AS lang").limit(3)).collect()} <= {"", "und"}


def test_leader_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    z, n = np.zeros((langid.BUCKETS, 2)), np.zeros((langid.BUCKETS, 2))
    rows = [(np.array([i % 2, 2 + int(rng.integers(50))]), np.array([0.8, 0.6]), i % 2) for i in range(400)]
    langid.train_pass(z, n, rows)
    w = langid.leader_weights(z, n)
    assert w[0, 0] > 0.5 > -0.5 > w[1, 0] and np.count_nonzero(w) < 110
