"""Clashing names, many matches, several slices, and methods against plain versions of themselves."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases
from test_joins_and_archives import brute_leaks, brute_spans, tables
from test_text_operators import brute_quality

import corpus_pipeline
from tickloom.llm import decontaminate, jaccard_join, langid, quality_rules, quote_links, secret_ledger, source_mix, token_counts, warc_assembly

# ---- clashing names


def test_helper_columns_never_clash(spark):
    rows = [(1, "password = hunter2hunter2 end", "a", 5, "k1"), (2, "nothing here", None, 6, "k2"), (2, "nothing here", None, 6, "k3")]
    for name in ("_key", "KEY", "row_spans", "_before", "before", "mix_rates"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, n_chars int, `{name}` string")
        out = secret_ledger.redact(docs)
        assert out.columns == docs.columns and sorted(r[4] for r in out.collect()) == ["k1", "k2", "k3"]
        assert {r.text for r in out.collect()} == {"[SECRET] end", "nothing here"}
        assert sorted((r.n_chars, r[4]) for r in corpus_pipeline.secrets(spark, docs, "").collect()) == [(6, "k2"), (6, "k3"), (12, "k1")]
        mixed = source_mix.mix(docs)
        assert mixed.columns == [*docs.columns, "mix_copy"] and {r[4] for r in mixed.collect()} <= {"k1", "k2", "k3"}
    docs = spark.createDataFrame([(*r[:4], 99) for r in rows], "doc_id long, text string, source string, n_chars int, mix_copy int")
    assert source_mix.mix(docs).columns == docs.columns and {r.mix_copy for r in source_mix.mix(docs).collect()} <= {1, 2}


# ---- secrets


def test_blobs_added_twice_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token: abcdefgh1"), (2, "token: abcdefgh1"), (3, None)], "doc_id long, text string")
    path = f"{tmp_path}/ledger"
    secret_ledger.scan(docs, path)
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert secret_ledger.report(docs, path).count() == 3 and secret_ledger.scan(docs, path).count() == 2
    assert cases.bag(secret_ledger.report_in_two_scans(docs)) == cases.bag(secret_ledger.report(docs))
    assert secret_ledger.report_in_two_scans(docs.limit(0)).count() == 0


def test_another_error_than_a_missing_ledger_is_raised(spark, tmp_path):
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="parquet|Parquet"):
        secret_ledger.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), f"{tmp_path}/ledger")


def test_texts_of_many_matches(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["token: abcdefgh1 ", "secret=short ", "AKIA" + "Q" * 14 + " ", "é\U0001f600 ", "ab12" * 9 + "\n", "api_key='x_y.z-0123' "])
    text = "".join(part() for _ in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "token: abcdefgh1" * 3), (3, "x" * 20_000 + " token: abcdefgh1 " + "y" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_ledger.report(docs).collect()}
    for r in docs.collect():
        kinds = Counter(s.split(":")[0] for s in brute_spans(r.text))
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert [s for s in got[r.doc_id].spans.split(",") if s.split(":")[0] in secret_ledger.BASE] == brute_spans(r.text)
    for r in secret_ledger.redact(docs).collect():
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in got[r.doc_id].spans.split(","))
        out, at, whole = [], 0, {d.doc_id: d.text for d in docs.collect()}[r.doc_id]
        for start, end in spans:
            if start >= at:
                out.append(whole[at:start] + "[SECRET]")
            at = max(at, end)
        assert r.text == "".join(out) + whole[at:]


# ---- decontamination


def test_several_slices_equal_one(spark, monkeypatch):
    rng = random.Random(7)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, make(rng.randrange(3, 60))) for i in range(60)] + [(900, None), (901, "")]
    rows = [(i, f"{make(40)} {items[i % 60][1]} {make(30)}" if i % 3 == 0 else make(90), "clash") for i in range(150)] + [(None, items[5][1], "clash"), (7, None, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(items, "item_id long, text string")
    one, kept = cases.bag(decontaminate.find_leaks(docs, benchmark)), cases.bag(decontaminate.drop_leaks(docs, benchmark))
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 9)
    assert decontaminate.slices(benchmark, "item_id", "text")[0] > 3
    assert cases.bag(decontaminate.find_leaks(docs, benchmark)) == one and len(one) >= 50
    assert cases.bag(decontaminate.drop_leaks(docs, benchmark)) == kept and decontaminate.drop_leaks(docs, benchmark).columns == docs.columns


def test_leaks_in_whole_long_texts(spark):
    items = [(r.item_id, r.text) for r in tables(spark, "benchmark").collect()][:12]
    docs = sorted(((r.doc_id, r.text) for r in tables(spark).collect()), key=lambda r: -len(r[1] or ""))[:3]
    docs = [(i, f"{t} {items[i % 12][1]}") for i, t in docs]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx({(d, i): s for d, t in docs for i, s in brute_leaks(t, items).items()})


def test_a_full_slice_stays_small():
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(20 + i % 400))) for i in range(decontaminate.SLICE_ITEMS)]
    searcher = decontaminate.Searcher(items)
    held = sum(g[3].keys.nbytes + g[3].owner.nbytes + g[4].grams.nbytes + g[4].item.nbytes + g[4].weight.nbytes for g in searcher.groups)
    assert len(searcher.groups) == 400 and held < 40 << 20
    assert set(searcher.search(f"x y {items[77][1]} z")) == {77}


# ---- archives


def test_pages_of_megabytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_assembly, "FILE_BYTES", 4 << 20)
    pages = spark.createDataFrame([(i, f"http://h/{i}", chr(97 + i % 3) * (2_000_000 + i % 3)) for i in range(12)] + [(99, "u", "same")] * 400, "page_id long, url string, html string")
    got = warc_assembly.digest_rows(warc_assembly.round_trip(pages, f"{tmp_path}/w")).collect()
    assert Counter(r.record_type for r in got if r.page_id != 99) == {"response": 3, "revisit": 9}
    assert Counter((r.record_type, r.payload_bytes, r.refers_to) for r in got if r.page_id == 99) == {("response", 4, None): 1, ("revisit", 4, 99): 399}
    kinds = Counter(r.type for r in warc_assembly.read_records(spark, f"{tmp_path}/w", payload=False).collect())
    assert kinds["warcinfo"] >= 1 and kinds["request"] == kinds["metadata"] == 412


# ---- Jaccard join


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    for percent, trial in ((80, 1), (90, 2), (80, 3)):
        base = rng.integers(-(2**62), 2**62, 60)
        sets = [np.unique(np.concatenate([rng.choice(base, 60 - k % 9, replace=False), rng.integers(-(2**62), 2**62, k % 5)])) for k in range(70)]
        known = [k // 3 if trial > 1 else k for k in range(70)]
        table = pa.table({"leader": pa.array([5] * 70), "class": pa.array(range(70)), "component": pa.array(known), "tokens": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
        made = jaccard_join._forest(percent)(table).to_pylist()

        def groups(pairs):
            label = list(known)
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return len(set(label)), [min(j for j in range(70) if label[j] == x) for x in label]

        common = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        every = [(a, b) for a in range(70) for b in range(a) if 100 * common(a, b) >= percent * (len(sets[a]) + len(sets[b]) - common(a, b))]
        assert groups((r["a"], r["b"]) for r in made) == groups(every)
        assert all((max(r["a"], r["b"]), min(r["a"], r["b"])) in every for r in made) and len(made) < 70


# ---- quotes


def brute_links(rows):
    """(conv, turn) -> (quotes, linked quotes, answered turn), by comparing every quote with every earlier message."""
    plain = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    out = {}
    for conv in {r[0] for r in rows}:
        talk = sorted(r for r in rows if r[0] == conv)
        bodies = []
        for _, turn, _, text in talk:
            levels = [(len(re.match(r"(?:[ \t]{0,3}>)*", x)[0].replace(" ", "").replace("\t", "")), re.sub(r"^(?:[ \t]{0,3}>)+", "", x)) for x in text.split("\n")]
            passages, last = [], None
            for level, content in levels:
                if level and level == last:
                    passages[-1][1].append(content)
                elif level:
                    passages.append((level, [content]))
                last = level
            linked = []
            for level, lines in passages:
                said = [plain(s) for s in re.split(r"(?<=[.!?])\s+", "\n".join(lines)) if plain(s)]
                votes = [(sum(s in {plain(k) for k in re.split(r"(?<=[.!?])\s+", b) if plain(k)} for s in set(said)), n) for n, b in enumerate(bodies)]
                best = max(votes, default=(0, 0))
                if best[0]:
                    linked.append((-level, best[0], best[1]))
            answered = talk[max(linked)[2]][1] if linked else (talk[len(bodies) - 1][1] if bodies else None)
            out[conv, turn] = (len(passages), len(linked), answered)
            bodies.append("\n".join(c for level, c in levels if not level))
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.randrange(2, 14)):
            own = [f"Sentence {rng.choice('abcdef')} number {rng.randrange(9)} of {conv}." for _ in range(rng.randrange(1, 4))]
            quoted = []
            for level in range(1, rng.randrange(1, 4)):
                if said and rng.random() < 0.8:
                    quoted += [">" * level + " " + s for s in rng.sample(rng.choice(said), 1)] + ([">" * level + " Never said before here."] if rng.random() < 0.2 else [])
            rows.append((conv, turn, "u", "\n".join([*quoted, *own])))
            said.append(own)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in quote_links.thread(frame).collect()}
    assert got == brute_links(rows)
    assert sum(linked for _, linked, _ in got.values()) > 50


# ---- language


def test_one_pass_of_the_leader_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    k = 3
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(k))) for _ in range(60)]
    z, n = np.zeros((langid.BUCKETS, k)), np.zeros((langid.BUCKETS, k))
    langid.train_pass(z, n, rows)
    pz, pn = Counter(), Counter()
    for index, x, y in rows:
        weight = {}
        for i in index:
            for c in range(k):
                s = pz[i, c]
                weight[i, c] = 0.0 if abs(s) <= langid.L1 else -(s - math.copysign(langid.L1, s)) / ((langid.BETA + math.sqrt(pn[i, c])) / langid.ALPHA + langid.L2)
        logit = [sum(v * weight[i, c] for i, v in zip(index, x)) for c in range(k)]
        total = sum(math.exp(v) for v in logit)
        for c in range(k):
            p = math.exp(logit[c]) / total - (c == y)
            for i, v in zip(index, x):
                g = v * p
                sigma = (math.sqrt(pn[i, c] + g * g) - math.sqrt(pn[i, c])) / langid.ALPHA
                pz[i, c] += g - sigma * weight[i, c]
                pn[i, c] += g * g
    assert all(z[i, c] == pytest.approx(v) for (i, c), v in pz.items()) and all(n[i, c] == pytest.approx(v) for (i, c), v in pn.items())


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(6)
    logits = rng.normal(0, 4, (300, 4))
    labels = np.array([rng.choice(4, p=langid.softmax(row / 2.5)) for row in logits])
    loss = lambda t: -np.mean(np.log(langid.softmax(logits / t)[np.arange(300), labels]))
    best = min(np.geomspace(0.05, 15, 400), key=loss)
    assert langid.fit_temperature(logits, labels) == pytest.approx(best, rel=0.03) and langid.fit_temperature(logits[:0], labels[:0]) == 1.0


# ---- quality


def test_posterior_equals_a_loop_over_rows(spark):
    docs = tables(spark).unionByName(cases.docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    stats = docs.select("doc_id", quality_rules.text_stats(docs.text).alias("stats"))
    names = list(quality_rules.RULES)
    votes = [tuple(r)[1:] for r in stats.select("doc_id", *(f(stats.stats).alias(k) for k, f in quality_rules.RULES.items())).collect()]
    prior, right = quality_rules.START_PRIOR, dict.fromkeys(names, quality_rules.START_ACCURACY)
    clip = lambda x, low, high: min(max(x, low), high)

    def posterior(v):
        good, junk = prior, 1 - prior
        for name, x in zip(names, v):
            good *= right[name] if x > 0 else 1 - right[name] if x < 0 else 1
            junk *= right[name] if x < 0 else 1 - right[name] if x > 0 else 1
        return good / (good + junk)

    for _ in range(quality_rules.ROUNDS):
        p = [posterior(v) for v in votes]
        fresh = {}
        for k, name in enumerate(names):
            said = [(v[k], g) for v, g in zip(votes, p) if v[k]]
            fresh[name] = clip((quality_rules.START_ACCURACY + sum(g if x > 0 else 1 - g for x, g in said)) / (1 + len(said)), *quality_rules.ACCURACY_RANGE)
        prior, right = clip(sum(p) / len(p), *quality_rules.PRIOR_RANGE), fresh
    got = sorted((round(r.posterior, 9), r.kept) for r in quality_rules.judge(docs).collect())
    failed = [brute_quality(r.text)[-1] for r in docs.collect()]
    want = sorted((round(posterior(v), 9), not f and posterior(v) >= 0.5) for v, f in zip(votes, failed))
    assert [g for _, g in got] == [w for _, w in want] and [g for g, _ in got] == pytest.approx([w for w, _ in want], abs=1e-6)


# ---- tokens


def test_cuts_of_texts_without_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("行く日。" * 4000, "line\nanother1\n\n" * 3000, "a\tb" * 5000, "x1" * 9000):
        parts = token_counts.pieces(text, 50)
        assert "".join(parts) == text
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in parts) == len(t.encode(text, add_special_tokens=False))
