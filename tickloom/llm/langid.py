"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over all training documents. The weights are trained by
follow-the-regularised-leader with an elastic net, on a hash sample of about SAMPLE_ROWS of them: the sample is dealt into
shards, each shard makes a pass from the common state, and the states are averaged. A part of the sample that is not trained on sets the
temperature that divides the logits. Prediction reads whole texts in one pass without a shuffle.

Defined results: a text that is null or has no letter gets `und` and score 0; so do all texts if there is nothing to learn from; a null
doc_id counts as an empty one and so is not held out; repeated rows are predicted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the sample of labelled rows that the weights are fitted on (in expectation; drawn by hash).
SAMPLE_ROWS = 12_000
SHARDS = 4
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.001
UNKNOWN = "und"


class Ngrams:
    """Hashed n-gram counts of whole texts."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(0x10000)])

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Buckets and their counts; None without a letter. All but letters count as one space."""
        if not text:
            return None
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(c, 0xFFFF)]
        if (high := c > 0xFFFF).any():
            astral = {int(x): chr(int(x)).isalpha() for x in np.unique(c[high])}
            letter = letter.copy()
            letter[high] = [astral[int(x)] for x in c[high]]
        if not letter.any():
            return None
        c = np.where(letter, c, np.uint32(32))
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
        c = c[1:][(c[1:] != 32) | (c[:-1] != 32)]
        grams, h = [], np.zeros(len(c), np.uint32)
        with np.errstate(over="ignore"):
            for n in range(max(ORDERS)):
                if len(c) <= n:
                    break
                h = h[: len(c) - n] * np.uint32(0x9E3779B1) + (c[n:] + np.uint32(n + 1)) * np.uint32(0x85EBCA6B)
                if n + 1 in ORDERS:
                    g = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                    grams.append(g >> np.uint32(32 - BUCKETS.bit_length() + 1))
        found = np.bincount(np.concatenate(grams), minlength=BUCKETS)
        nonzero = np.flatnonzero(found)
        return nonzero, found[nonzero]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, most of it zero
    temperature: float = 1.0

    def vector(self, counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index, n = counted
        x = (1 + np.log(n)) * self.idf[index]
        return index, x / math.sqrt(float(x @ x))

    def logits(self, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[index]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def leader_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that minimise the regularised sum of past losses, for states z and n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_pass(z: np.ndarray, n: np.ndarray, rows) -> None:
    """One pass over (index, x, label); changes z and n."""
    for index, x, label in rows:
        zi, ni = z[index], n[index]
        w = leader_weights(zi, ni)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        after = ni + g * g
        z[index] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / ALPHA * w
        n[index] = after


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / math.exp(t)
        top = z.max(1)
        return float(np.mean(np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(labels)), labels]))

    low, high, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _document_frequencies(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df = Ngrams(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if counted := grams.counts(text.as_py()):
                    df[counted[0]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["bucket", "df"])

    return texts.mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def _arrays(table):
    for index, x, label in zip(table.column("index"), table.column("x"), table.column("label")):
        yield index.values.to_numpy(), x.values.to_numpy(), label.as_py()


def _packed(z: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return rows.astype(np.int32).tobytes(), z[rows].tobytes(), n[rows].tobytes()


def _unpacked(packed, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, z, n = packed
    return np.frombuffer(rows, np.int32), np.frombuffer(z).reshape(-1, languages), np.frombuffer(n).reshape(-1, languages)


def _shard_pass(start, k: int, languages: int):
    """One shard's pass from the common state, in an order that depends on its rows and k alone. Of the state travel the
    buckets that are not zero, and back come the changes of those that the pass has touched."""

    def run(table: pa.Table) -> pa.Table:
        z, n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))
        at, z0, n0 = _unpacked(start.value, languages)
        z[at], n[at] = z0, n0
        before = z.copy(), n.copy()
        rows = sorted(_arrays(table), key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes(), r[2]))
        train_pass(z, n, (rows[i] for i in np.random.default_rng(k).permutation(len(rows))))
        z, n = z - before[0], n - before[1]
        columns = zip(("rows", "z", "n"), _packed(z, n, np.flatnonzero((n != 0).any(1) | (z != 0).any(1))))
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32())} | {name: pa.array([x], pa.binary()) for name, x in columns})

    return run


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from train(doc_id, text, lang). What comes to the driver has the size of the model, or is one logit row per
    calibration row, a tenth of the sample."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    langs, total = sorted(sizes), sum(sizes.values())
    idf = np.full(BUCKETS, 1 + math.log(1 + total))
    if not total:
        return Model([], idf, np.zeros((BUCKETS, 0)))
    for bucket, df in _document_frequencies(train.select("text")).collect():
        idf[bucket] = 1 + math.log((1 + total) / (1 + df))
    blank = Model(langs, idf, np.zeros((BUCKETS, len(langs))))

    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30))
    sample = train.where(draw < int(min(1.0, sample_rows / total) * (1 << 30))).select("text", "lang", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id", "text"), F.lit(10 * SHARDS))).cast("int").alias("fold"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, number = Ngrams(), {v: i for i, v in enumerate(langs)}
        for batch in batches:
            out = [[], [], [], []]
            for text, lang, fold in zip(*(c.to_pylist() for c in batch.columns)):
                if counted := grams.counts(text):
                    index, x = blank.vector(counted)
                    for to, value in zip(out, (fold, number[lang], index.astype(np.int32), x)):
                        to.append(value)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["fold", "label", "index", "x"])

    rows = stored(sample.mapInArrow(vectors, "fold int, label int, index array<int>, x array<double>"), "sample")
    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))

    for k in range(PASSES):
        start = rows.sparkSession.sparkContext.broadcast(_packed(z, n, np.flatnonzero((n != 0).any(1))))
        dealt = rows.where(f"fold >= {SHARDS}").withColumn("shard", F.col("fold") % SHARDS).groupBy("shard")
        shards = dealt.applyInArrow(_shard_pass(start, k, len(langs)), "shard int, rows binary, z binary, n binary").collect()
        for s in sorted(shards, key=lambda s: s.shard):
            at, dz, dn = _unpacked((s.rows, s.z, s.n), len(langs))
            z[at] += dz / len(shards)
            n[at] += dn / len(shards)
        start.unpersist()
    model = Model(langs, idf, leader_weights(z, n))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(y, model.logits(i, x)) for i, x, y in _arrays(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.float64()))], names=["label", "logits"])

    scored = rows.where(f"fold < {SHARDS}").mapInArrow(held, "label int, logits array<double>").collect()
    model.temperature = fit_temperature(np.array([r.logits for r in scored]).reshape(len(scored), len(langs)), np.array([r.label for r in scored], int))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to docs, of which only the column text is read; that column is left out."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "text"]
    shared = spark.sparkContext.broadcast((model.langs, model.idf, model.weights, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Ngrams(), Model(*shared.value)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                counted = grams.counts(text.as_py()) if model.langs else None
                if counted:
                    p = softmax(model.logits(*model.vector(counted)) / model.temperature)
                    best = int(p.argmax())
                    langs.append(model.langs[best])
                    scores.append(float(p[best]))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learns from the rows that are not held out."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    model = fit(docs.where("NOT held_out").select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model)
