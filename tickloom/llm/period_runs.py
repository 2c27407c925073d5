"""Periodic runs of words: found by minimizers at several scales, and collapsed to their first period.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, REPEATS * q) words that no
neighbouring word extends. Texts of a group are laid one after the other, parted by marks that occur once, so that every step
is a pass over arrays:

* Periods up to SHORT are too short for windows: words are compared with those q places on.
* Periods q with k / 2 < q <= k belong to the scale k = 8, 16, 32, ... A string of k words recurs inside a run at multiples of
  q only, and a run of 4 * q words holds two windows of k / 2 such strings that lie q apart. So the least string of
  the one is the least of the other, and the two are neighbours among equal minimizers. Pairs at a distance of the scale are
  extended to both sides by comparing words; a pair inside a stretch already found is passed over.

Stretches with the same ends differ by multiples of the smallest period, so the least is kept. A scale looks only at texts
that are long enough for one of its runs.

Defined results: a null or blank text has no words, no runs and an empty collapsed text; the collapsed text joins the kept words
by one space; repeated rows and null ids are answered row by row; other columns of the input, whatever their names, are not read.
No row is shuffled. A task holds one group of GROUP_BYTES of text, or one longer text, at about 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, let, words_of

REPEATS = 4
LEAST = 6
SHORT = 4
GROUP_BYTES = 4 << 20

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x + _A) * _B ^ y
    h = (h ^ (h >> _C)) * _A
    return h ^ (h >> _C)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of x; width is a power of two."""
    done = 1
    while done < width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return x


def _minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some window of that width."""
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)


def _extended(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around at in which words lag apart are equal: its first word and the end of its last."""
    right, step = at, 64
    while right + lag < len(x):
        n = min(step, len(x) - lag - right)
        off = np.flatnonzero(x[right : right + n] != x[right + lag : right + lag + n])
        if len(off):
            right += int(off[0])
            break
        right, step = right + n, 2 * step
    left, step = at, 64
    while left:
        n = min(step, left)
        off = np.flatnonzero(x[left - n : left] != x[left - n + lag : left + lag])
        if len(off):
            left += int(off[-1]) + 1 - n
            break
        left, step = left - n, 2 * step
    return left, right + lag


def _lag_scan(x: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int, int]]:
    same = np.concatenate([[False], x[:-lag] == x[lag:], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    for s, e in turns[turns[:, 1] - turns[:, 0] + lag >= least]:
        yield int(s), int(e) + lag, lag


def runs_of(codes: np.ndarray, lengths: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """Rows of (text, start, length, period), ordered by text, start and period. codes: the words of all texts as numbers;
    lengths: words of each text. repeats must be 4 or more: windows of a scale need that much room."""
    if repeats < 4:
        raise ValueError("runs of fewer than 4 repetitions are not sure to hold equal minimizers")
    ends = np.cumsum(lengths + 1)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    x = np.empty(len(owner), np.int64)
    mark = np.zeros(len(owner), bool)
    mark[ends - 1] = True
    x[~mark], x[mark] = codes, -1 - np.arange(len(lengths))
    found: dict[tuple[int, int], int] = {}

    def take(s: int, e: int, lag: int) -> None:
        if e - s >= max(least, repeats * lag):
            found[s, e] = min(lag, found.get((s, e), lag))

    for lag in range(1, min(SHORT, len(x) - 1) + 1):
        for run in _lag_scan(x, lag, max(least, repeats * lag)):
            take(*run)
    with np.errstate(over="ignore"):
        place, h, k = np.arange(len(x)), _mixed(x.astype(np.uint64), np.uint64(7) * np.ones(len(x), np.uint64)), 1
        while True:
            k *= 2
            long_enough = lengths[owner[place]] >= repeats * (k // 2 + 1)
            place, h = place[long_enough], h[long_enough]
            if len(h) < k + 1:
                break
            h = np.concatenate([_mixed(h[: -k // 2], h[k // 2 :]), h[-k // 2 :]])  # the tail is too short for k words; it matches nothing long
            if k <= SHORT:
                continue
            at = _minimizers(h, k // 2)
            at = at[np.argsort(h[at], kind="stable")]
            gap = np.diff(at)
            pair = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (gap > k // 2) & (gap <= k))
            order = np.lexsort((at[pair], gap[pair]))
            last = (0, 0)
            for i, lag in zip(place[at[pair[order]]].tolist(), gap[pair[order]].tolist()):
                if last[0] == lag and i + lag < last[1]:
                    continue
                s, e = _extended(x, i, lag)
                last = (lag, e)
                take(s, e, lag)
    if not found:
        return np.empty((0, 4), np.int64)
    rows = np.array([(s, e - s, q) for (s, e), q in found.items()], np.int64)
    text = owner[rows[:, 0]]
    rows = np.column_stack([text, rows[:, 0] - (ends - lengths - 1)[text], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and the number of words of each."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.not_equal(words, "")  # a blank text splits into one empty string
    return words.filter(full), np.bincount(owner.filter(full).to_numpy(zero_copy_only=False), minlength=len(texts))


def _of_group(texts: pa.Array, repeats: int, least: int) -> tuple[pa.Array, pa.Array]:
    words, lengths = split_words(texts)
    rows = runs_of(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), lengths, repeats, least)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    change = np.zeros(len(words) + 1, np.int64)
    first = begin[rows[:, 0]] + rows[:, 1]
    np.add.at(change, first + rows[:, 3], 1)
    np.add.at(change, first + rows[:, 2], -1)
    kept = np.cumsum(change)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(kept)])[begin].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(kept))), " ")
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(bounds), runs), collapsed


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed (the text without what repeats) of every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_groups(batch.column("text"), GROUP_BYTES):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_of_group(part.column("text"), repeats, least)], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def with_loops(doc_id: Column, text: Column) -> Column:
    """text as the query's contract wants it: every tenth document, by the hash of its id, goes round in its last words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    some = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) != ""
    return F.when((h % 10 == 0) & some, let(words_of(text), looped)).otherwise(text)


def digest_rows(found: DataFrame) -> DataFrame:
    """One row per document: its runs counted, the greatest of them, and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.shorter")
    return rows.select(
        "doc_id", "n_runs", (-F.col("top.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
