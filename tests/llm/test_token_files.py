"""Token files: the library's ids, what the files look like inside, and reads of parts."""

import glob
import shutil
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).parent))
import cases

from tickloom.llm import queries, token_counts, token_files
from tickloom.llm.common import fresh_path


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows, ids_of):
    """rows in order of doc_id: doc_id, start, n_tokens, ids_crc32."""
    out, start = [], 0
    for i, text in rows:
        ids = ids_of(text)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def by_place(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, library, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").orderBy("doc_id").collect()
    assert by_place(queries.op13_token_files(spark, f"/root/testdata/{size}")) == expected([(r.doc_id, r.text) for r in docs], library)


def test_units_equal_the_library(vocabulary, library):
    odd = ["", " ", "  ", " a", "a  b", "a \n b", "a\xa0 b", "it 's  <|endoftext|> x", "x<|endoftext|> y <|endoftext|>", "日本 語、 テ", "a　 b 　c", "tab\t end ", "…  a … b", "\x1c a \x1c\x1d b", "a ​ b", "1 2  3 ½ x² y", "É è  ñ́ z", "null \x00 byte\x00 in", "x. y, z; (a) [b]", "a\nb", "a\n\nb", "\na", "a\n", "é\nb\n c", "a.\n\n\nb.\nc", "x.y.z, don't! 2.0.\nAnd", "…\n…", "a\u0085 b\u2028 c\u3000 d"]
    texts = [*odd, *(t or "" for t in cases.TEXTS), " ".join(odd), "  ".join(odd)]
    encoder = token_files.Encoder(vocabulary)
    texts += [a + b for a in odd for b in odd]
    for _ in range(2):  # units unknown, then known
        ids, sizes = encoder.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [library(t) for t in texts]
    encoder.chars = token_files.CACHE_CHARS + 1
    assert encoder.encode(pa.array(["a b c"]), None)[0].tolist() == library("a b c")[:-1] and len(encoder.slots) == 3
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]


def test_tasks_of_a_worker_share_a_tokenizer(vocabulary, tmp_path, monkeypatch):
    """The library keeps megabytes of each object that has encoded; a worker runs hundreds of tasks, each with functions pickled anew."""
    import tokenizers

    made, path = [], str(tmp_path / "vocabulary.json")
    shutil.copy(vocabulary, path)

    class Counted:
        @staticmethod
        def from_file(name, load=tokenizers.Tokenizer.from_file):
            made.append(name)
            return load(name)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    for _ in range(3):  # as three tasks would
        encoder = cloudpickle.loads(cloudpickle.dumps(token_files.Encoder))(path)
        assert encoder.encode(pa.array(["a b", "c d"]))[1].tolist() == [3, 3]
        assert cloudpickle.loads(cloudpickle.dumps(token_counts.library_tokenizer))(path) is encoder.tokenizer
    assert made == [path]


def test_tasks_of_a_worker_share_units_and_keep_frequent_ones(vocabulary, library, tmp_path, monkeypatch):
    """Most new words are seen once; a cache that a task begins anew, or that is emptied whole, has the library encode the others again."""
    import tokenizers

    asked, path = [], str(tmp_path / "vocabulary.json")
    shutil.copy(vocabulary, path)

    class Logged:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

    class Opened:
        @staticmethod
        def from_file(name, load=tokenizers.Tokenizer.from_file):
            return Logged(load(name))

    def task(text):
        encoder = cloudpickle.loads(cloudpickle.dumps(token_files.worker_encoder))(path)
        assert encoder.encode(pa.array([text]))[0].tolist() == library(text)
        return encoder

    monkeypatch.setattr(tokenizers, "Tokenizer", Opened)
    for rare in ("one", "two", "three"):
        encoder = task(f"often seen words&&& words%% it's {rare}")
    assert [" ".join(asked).count(w) for w in ("often", " seen", " words", "one", "two")] == [1, 1, 1, 1, 1]
    encoder.chars = token_files.CACHE_CHARS + 1
    asked.clear()
    task("often seen words&&& words%% it's three or four")
    assert sorted("".join(asked).split()) == ["four", "or", "three"] and encoder.chars < 100
    for method in (encoder.encode, encoder._drop):  # unpickled functions have globals of their own
        monkeypatch.setitem(method.__func__.__globals__, "CACHE_CHARS", 8)
    encoder.groups += 5  # too many units, however often they were seen
    assert encoder.encode(pa.array(["often seen"]))[0].tolist() == library("often seen") and len(encoder.slots) == 2


def test_other_vocabularies_go_unit_by_unit():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["some words of a text", "And more, of them", "two words", "no.stops,here"]
    ids, sizes = token_files.Encoder(path).encode(pa.array(texts), None)
    assert ids.tolist() == sum((t.encode(x, add_special_tokens=False).ids for x in texts), []) and sizes.sum() == len(ids)


def test_awkward_rows(spark, vocabulary, library):
    docs = cases.docs(spark)
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, vocabulary, path, files=3)
    got = by_place(token_files.digest_rows(token_files.read(spark, path)))
    assert got[0][0] is None and [r[0] for r in got[1:]] == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, n, c) for i, _, n, c in expected([(r.doc_id, r.text) for r in docs.collect()], library))
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(cases.empty(spark), vocabulary, path)
    assert token_files.read(spark, path).count() == 0 and token_files.read_span(spark, path, 0, 9).count() == 0
    named = docs.selectExpr("doc_id AS file", "text AS offset", "lang AS tokens")
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(named, vocabulary, path, "file", "offset")
    assert token_files.read(spark, path).count() == docs.count()


def test_a_hot_id_is_spread(spark, vocabulary):
    docs = spark.range(3000).selectExpr("IF(id < 2000, 7, id) AS doc_id", "IF(id < 1000, 'same text', concat('text ', id)) AS text")
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, vocabulary, path, files=6)
    assert max(r["rows"] for r in token_files.manifest(spark, path).collect()) < 1000
    rows = by_place(token_files.read(spark, path).select("doc_id", "start", "n_tokens"))
    assert all(a[1] + a[2] == b[1] and a[0] <= b[0] for a, b in zip(rows, rows[1:]))


def test_files_inside(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, vocabulary, path, files=2)
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/tokens/part-*.parquet"))
    assert len(files) == 2
    for name in files:
        group = pq.ParquetFile(name).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings or "DELTA_BINARY_PACKED" in columns["tokens.list.element"].encodings
        assert columns["tokens.list.element"].has_dictionary_page
        for c in ("doc_id", "offset", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[c].encodings and not columns[c].has_dictionary_page
            assert columns[c].has_offset_index and columns[c].has_column_index
    ids = [pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist() for f in files]
    assert sum(ids, []) == sorted(sum(ids, []))
    plan = token_files.read(spark, path).where("doc_id BETWEEN 10 AND 20").select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "GreaterThanOrEqual(doc_id,10)" in plan


def test_span_of_places(spark, vocabulary, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, vocabulary, path, files=4)
    stream = sum((library(r.text) for r in docs.orderBy("doc_id").collect()), [])
    for first, stop in ((0, 5), (1000, 9000), (len(stream) - 3, len(stream) + 10), (len(stream), len(stream) + 1)):
        rows = token_files.read_span(spark, path, first, stop).orderBy("start").collect()
        assert sum((r.tokens for r in rows), []) == stream[first:stop]
        assert not rows or rows[0].start == first
