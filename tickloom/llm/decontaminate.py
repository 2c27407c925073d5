"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item, all windows of the item's length in every document are compared with it: the window's SimHash is
looked up in a multi-index of the items' fingerprints, whose blocks guarantee to find every fingerprint within RADIUS
bits, and the candidates are verified by the weighted Jaccard similarity of word shingles, in which a shingle weighs
as often as it occurs. The fingerprint is taken over words, because a changed word changes one word but WIDTH shingles:
pairs of similarity 0.8 are then mostly within RADIUS. Those beyond it are found without fingerprints: the windows that pass
the test below are compared exactly with every item that shares enough shingles with them, so no hit is lost.

Before that, windows that cannot reach the similarity are passed over without loss: windows of w and items of n
shingles need percent * (w + n) / (100 + percent) shingles in common, so a window must hold at least so many shingles that the benchmark has.

The benchmark is taken in slices of bounded size, each held by every task. A benchmark of one slice takes one pass over the
documents and shuffles nothing. With several slices one pass goes before, which keeps the documents that hold enough shingles
of any item, by a Bloom filter of fixed size; only those are searched for each slice. Words are runs of letters and digits in lower case.

Defined results: null or empty texts and items match nothing; items of fewer than WIDTH words are one shingle and match only as a whole; a document
shorter than an item is one window; repeated documents and items are each reported; empty tables give no rows; other columns
pass through drop_leaks() whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

WIDTH = 5
PERCENT = 80
RADIUS = 15
BLOCKS = 4  # of 16 bits each
SLICE_ITEMS = 1_024
SLICE_BYTES = 4 << 20
#: Bits of the filter of all items' shingles, and how many of them a shingle sets.
FILTER_BITS = 1 << 27
FILTER_KEYS = 2

_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _A
        return x ^ (x >> np.uint64(29))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of width words."""
    total = np.zeros(max(len(ids) - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = _mix(total * _B + ids[i : i + len(total)] + np.uint64(1))
    return total


def fingerprints(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the words starts[i] to starts[i] + length, for each i."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(sums[starts + length] > sums[starts], axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class HammingIndex:
    """Finds all stored fingerprints within radius: two words within it agree up to radius // BLOCKS bits in some
    block, so every fingerprint is stored under all such neighbours of each of its blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        flips = [sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(16), r)]
        flips = np.array(flips, np.int64)
        parts = prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)
        keys = ((parts[:, :, None] ^ flips) | (np.arange(BLOCKS)[None, :, None] << 16)).astype(np.int32).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], (order // (BLOCKS * len(flips))).astype(np.int32)

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in prints, stored fingerprint) within the radius, each once."""
        keys = (prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int32) | (np.arange(BLOCKS, dtype=np.int32) << 16)).ravel()
        lo = np.searchsorted(self.keys, keys)
        some = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == keys)
        lo, n = lo[some], np.searchsorted(self.keys, keys[some], side="right") - lo[some]
        first = np.cumsum(n) - n
        pick = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(lo, n)
        pairs = np.unique(np.repeat(some // BLOCKS, n) * len(self.prints) + self.owner[pick])
        q, s = np.divmod(pairs, len(self.prints))
        near = np.bitwise_count(prints[q] ^ self.prints[s]) <= self.radius
        return q[near], s[near]


class Postings:
    """Which items of a group have a shingle, and how often."""

    def __init__(self, bags: list[Counter]):
        grams = np.concatenate([np.array(list(b), np.uint64) for b in bags])
        order = np.argsort(grams, kind="stable")
        self.grams, self.n_items = grams[order], len(bags)
        self.item = np.repeat(np.arange(len(bags)), [len(b) for b in bags])[order]
        self.weight = np.concatenate([np.array(list(b.values()), np.int64) for b in bags])[order]

    def common(self, grams: np.ndarray, starts: np.ndarray, count: int, need: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item, starts, shingles in common: of the windows of count shingles at starts, those with need in common or more."""
        turns = np.zeros(len(grams) + 1, np.int64)
        turns[starts] += 1
        np.add.at(turns, starts + count, -1)
        at = np.flatnonzero(np.cumsum(turns)[:-1])
        low = np.searchsorted(self.grams, grams[at])
        n = np.searchsorted(self.grams, grams[at], side="right") - low
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        place, item = np.repeat(at, n), self.item[k]
        order = np.argsort(item, kind="stable")
        edges = np.searchsorted(item[order], np.arange(self.n_items + 1))
        for i in np.flatnonzero(np.diff(edges) >= need):
            own = order[edges[i] : edges[i + 1]]
            spots = place[own]
            within = lambda p, w: np.searchsorted(p, w + count) - np.searchsorted(p, w)
            hits = within(spots, starts)
            some, hits = starts[hits >= need], hits[hits >= need]
            if not len(some):
                continue
            # A shingle counts as often as the item has it at most.
            kinds, nth, times = np.unique(k[own], return_inverse=True, return_counts=True)
            for j in np.flatnonzero(times > self.weight[kinds]):
                hits = hits - np.maximum(within(spots[nth == j], some) - self.weight[kinds[j]], 0)
            if (hits >= need).any():
                yield int(i), some[hits >= need], hits[hits >= need]


class Searcher:
    """The items of a slice, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[object, str]], percent: int = PERCENT):
        from xxhash import xxh3_64_intdigest

        self.percent, self.digest = percent, xxh3_64_intdigest
        texts: dict[tuple, list] = {}
        for item, text in items:
            if words := words_of(text):
                texts.setdefault(tuple(words), []).append(item)
        self.owners, self.items = list(texts.values()), list(texts)
        self.word_ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.items for w in t}))}
        self.groups = []  # (words, width, numbers of the items, index, postings)
        self.known, self.bags = {}, []
        ids = [np.array([self.word_ids[w] for w in t], np.uint64) for t in self.items]
        self.bags = [Counter(shingles(i, min(WIDTH, len(i))).tolist()) for i in ids]
        for width in sorted({min(WIDTH, len(t)) for t in self.items}):
            self.known[width] = np.unique(np.concatenate([np.array(list(b), np.uint64) for b, t in zip(self.bags, self.items) if min(WIDTH, len(t)) == width]))
        for length in sorted({len(t) for t in self.items}):
            numbers = [i for i, t in enumerate(self.items) if len(t) == length]
            prints = np.concatenate([fingerprints(self.hashes(self.items[i]), np.zeros(1, np.int64), length) for i in numbers])
            self.groups.append((length, min(WIDTH, length), numbers, HammingIndex(prints), Postings([self.bags[i] for i in numbers])))

    def hashes(self, words) -> np.ndarray:
        return np.array([self.digest(w) for w in words], np.uint64)

    def needed(self, window: int, item: int) -> int:
        return -(-self.percent * (window + item) // (100 + self.percent))

    def search(self, text: str | None) -> dict[object, tuple[float, int, int]]:
        """Item -> (similarity, first word, words) of its best window that reaches the similarity."""
        words = words_of(text)
        ids = np.array([self.word_ids.get(w, 0) for w in words], np.uint64)
        if not ids.any():
            return {}
        found, hashes, sums, grams = {}, None, {}, {}
        for width, known in self.known.items():
            grams[width] = g = shingles(ids, width)
            hit = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
            sums[width] = np.concatenate([[0], np.cumsum(hit)])
        for length, width, numbers, index, postings in self.groups:
            span = min(length, len(words))
            count = span - width + 1
            if count < 1 or sums[width][-1] < (need := self.needed(count, length - width + 1)):
                continue
            starts = np.flatnonzero(sums[width][count:] - sums[width][:-count] >= need)
            if not len(starts):
                continue
            hashes = self.hashes(words) if hashes is None else hashes
            for at in range(0, len(starts), 4096):
                some = starts[at : at + 4096]
                low = some[0]
                prints = fingerprints(hashes[low : some[-1] + span], some - low, span)
                for q, s in zip(*index.query(prints)):
                    bag, start = self.bags[numbers[s]], int(some[q])
                    mine = Counter(grams[width][start : start + count].tolist())
                    common = sum(min(n, bag[g]) for g, n in mine.items() if g in bag)
                    union = count + length - width + 1 - common
                    if 100 * common >= self.percent * union:
                        for item in self.owners[numbers[s]]:
                            if item not in found or common / union > found[item][0]:
                                found[item] = (common / union, start, span)
                for s, places, hits in postings.common(grams[width], some, count, need):
                    best = int(np.argmax(hits))
                    common = int(hits[best])
                    union = count + length - width + 1 - common
                    for item in self.owners[numbers[s]]:
                        if item not in found or common / union > found[item][0]:
                            found[item] = (common / union, int(places[best]), span)
        return found


class ShingleFilter:
    """A Bloom filter of the shingles of all items, and how many of them a document that holds an item has at least."""

    def __init__(self, percent: int = PERCENT):
        from xxhash import xxh3_64_intdigest

        self.digest, self.percent, self.bits, self.least = xxh3_64_intdigest, percent, np.zeros(FILTER_BITS // 8, np.uint8), {}

    def _grams(self, words: list[str], width: int) -> np.ndarray:
        return shingles(np.array([self.digest(w) for w in words], np.uint64), width)

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(FILTER_KEYS):
            yield (_mix(grams + np.uint64(k)) % np.uint64(FILTER_BITS)).astype(np.int64)

    def add(self, text: str) -> None:
        if words := words_of(text):
            width = min(WIDTH, len(words))
            grams = self._grams(words, width)
            self.least[width] = min(self.least.get(width, len(grams)), -(-self.percent * len(grams) // 100))
            for at in self._places(grams):
                np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def passes(self, text: str | None) -> bool:
        words = words_of(text)
        for width, least in self.least.items():
            grams = self._grams(words, width)
            if len(grams) >= least and np.logical_and.reduce([self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(grams)]).sum() >= least:
                return True
        return False


def slices(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many slices of about SLICE_ITEMS and SLICE_BYTES at most, drawn by hash, and their items; one is held at a time."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // SLICE_ITEMS), -(-size // SLICE_BYTES))
    return parts, ([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()] for k in range(parts))


def _filtered(docs: DataFrame, text_col: str, filter_: ShingleFilter, wanted: bool) -> DataFrame:
    """The rows of docs that the filter lets pass, or the others."""
    shared = docs.sparkSession.sparkContext.broadcast((filter_.percent, filter_.bits, filter_.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ShingleFilter()
        own.percent, own.bits, own.least = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.passes(t.as_py()) == wanted for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _filter_of(benchmark: DataFrame, item_col: str, item_text_col: str, percent: int) -> ShingleFilter:
    out = ShingleFilter(percent)
    for items in slices(benchmark, item_col, item_text_col)[1]:
        for _, text in items:
            out.add(text)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document for each item found in it."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word int, n_words int"
    out, (parts, taken) = None, slices(benchmark, item_col, item_text_col)
    if parts > 1:
        docs = stored(_filtered(docs, "text", _filter_of(benchmark, item_col, item_text_col, percent), True), "candidates")
    for items in taken:

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            searcher, names = Searcher(items, percent), ["doc_id", "item_id", "similarity", "first_word", "n_words"]
            for batch in batches:
                rows = [(i, item, *best) for i, text in enumerate(batch.column("text")) for item, best in sorted(searcher.search(text.as_py()).items(), key=repr)]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[k] for r in rows]) for k in range(1, 5)] if rows else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([ids, rest[0], rest[1].cast(pa.float64()), rest[2].cast(pa.int32()), rest[3].cast(pa.int32())], names=names)

        part = docs.mapInArrow(run, schema)
        part = stored(part, "leaks") if parts > 1 else part  # one slice at a time, so that plans do not pile up
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. With one slice nothing is shuffled; with
    several, the candidates are, by a hash of their texts."""

    def search(items: list, hits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items, percent)
            for batch in batches:
                found = [bool(searcher.search(text.as_py())) == hits for text in batch.column(text_col)]
                yield batch.filter(pa.array(found, pa.bool_()))

        return run

    parts, taken = slices(benchmark, item_col, item_text_col)
    if parts <= 1:
        for items in taken:
            docs = docs.mapInArrow(search(items, False), docs.schema)
        return docs
    filter_ = _filter_of(benchmark, item_col, item_text_col, percent)
    candidates = stored(_filtered(docs, text_col, filter_, True), "candidates")
    texts, key = candidates.select(text_col), free_name(docs, "key")
    leaks = None
    for items in taken:
        part = stored(texts.mapInArrow(search(items, True), texts.schema).select(F.sha2(text_col, 256).alias(key)).distinct(), "leaks")
        leaks = part if leaks is None else leaks.union(part)
    kept = candidates.withColumn(key, F.sha2(text_col, 256)).join(leaks.distinct(), key, "left_anti").select(*docs.columns)
    return _filtered(docs, text_col, filter_, False).unionByName(kept)
