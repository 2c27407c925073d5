"""Collocations: phrases whose words come together more often than their parts would by themselves.

Words are counted per language, and those frequent enough get ids by falling frequency over all languages, so an id stands
for a word of a language. A phrase of two words is a pair of ids of neighbours. Pairs are counted per task in tiles of
TILE x TILE ids: a tile that is hit often is a dense array to which numpy.bincount adds, the others keep sorted coordinates
with counts. Spark adds the tasks' counts up. Pairs frequent enough are ranked in turn and get ids, and a phrase of three words
is a pair of overlapping pairs, counted in the same way; and so on.

At most BROADCAST_IDS words and KEYS_A_NAME times as many pairs, which are plain numbers, are broadcast to the tasks with their
ids. A part that is not frequent enough makes a phrase that is not, so as long as all ids of a level are broadcast, other neighbours need
no count. Where a level has more, a filter of FILTER_BITS bits tells which of the others may be frequent, and phrases with such a
part are counted under their own text. That costs a wider shuffle and loses nothing.

Scores are exact: products are decimals of 38 digits, enough for counts below 10^16.

Defined results: a null text is empty; a null language is `und`, one with documents that say so; rows are counted one by one,
whatever their ids; an empty table, or one where nothing is frequent enough, gives no rows. Other columns are not read.
A language that holds most rows is no hot key: counts are added up by phrase, and the best of a language are taken per hash of
the phrase first. A task holds a group of GROUP_BYTES of text, or one longer text, and DENSE_TILES tiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_groups, stored

MIN_COUNT = 10
LONGEST = 3
#: A phrase goes when a longer candidate around it has this percentage of its occurrences.
COVER_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"
BROADCAST_IDS = 1 << 19
KEYS_A_NAME = 4
FILTER_BITS = 26
TILE = 1024
DENSE_TILES = 12
#: A tile becomes dense when a group of texts hits it this often.
DENSE_HITS = TILE * TILE // 64
#: So many coordinates of sparse tiles are gathered before they are sorted into the counts.
SPARSE_ROWS = 1 << 19
GROUP_BYTES = 3 << 20
BUCKETS = 32

_STOP = "[.,;:!?\\x0A-\\x0D]+"


class TileCounts:
    """Counts of pairs of ids."""

    def __init__(self, tile: int = TILE, dense_tiles: int = DENSE_TILES, dense_hits: int = DENSE_HITS):
        self.tile, self.dense_tiles, self.dense_hits = tile, dense_tiles, dense_hits
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.loose: list[np.ndarray] = []
        self.n_loose = self.held = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        t = self.tile
        band = (left // t) << 32 | right // t
        tiles, inverse, hits = np.unique(band, return_inverse=True, return_counts=True)
        to_dense = np.zeros(len(tiles), bool)
        for i in np.argsort(-hits):
            at = (int(tiles[i] >> 32), int(tiles[i] & 0xFFFFFFFF))
            if at not in self.dense and (hits[i] < self.dense_hits or len(self.dense) >= self.dense_tiles):
                continue
            to_dense[i] = True
            cells = np.flatnonzero(inverse == i)
            found = np.bincount((left[cells] % t) * t + right[cells] % t, minlength=t * t)
            if at not in self.dense:
                self.dense[at] = np.zeros(t * t, np.int32)
            self.dense[at] += found.astype(np.int32)
            self.held += int(hits[i])
        rest = ~to_dense[inverse]
        self.loose.append(left[rest] << 32 | right[rest])
        self.n_loose += len(self.loose[-1])
        if self.n_loose >= SPARSE_ROWS:
            self._sort()

    def _sort(self) -> None:
        loose = np.concatenate([self.keys[:0], *self.loose])
        self.loose, self.n_loose = [], 0
        loose.sort()
        first = np.flatnonzero(np.diff(loose, prepend=-1))
        keys, counts = np.concatenate([self.keys, loose[first]]), np.concatenate([self.counts, np.diff(first, append=len(loose))])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def full(self) -> bool:
        """Whether it is time to take: the coordinates fill their room, or a dense cell of 32 bits may soon."""
        return len(self.keys) >= 4 * SPARSE_ROWS or self.held >= 1 << 30

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys (left << 32 | right) and counts of all pairs so far, which are then forgotten."""
        self._sort()
        yield self.keys, self.counts
        for (i, j), cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield (i * self.tile + at // self.tile) << 32 | (j * self.tile + at % self.tile), cells[at].astype(np.int64)
        self.keys, self.counts, self.dense, self.held = self.keys[:0], self.counts[:0], {}, 0


def level(ids: pa.Table, bits: pa.Table | None) -> dict:
    """Ids of the phrases of one length, as plain values that a broadcast can carry: of words by language and word (names); of
    longer phrases by their two parts' ids (keys, sorted, and ids), or by language and phrase where a part has none. bits: the
    filter of the frequent phrases without an id, None if there are none."""
    named, keyed = ids.filter(pc.is_valid(ids["phrase"])), ids.filter(pc.is_null(ids["phrase"]))
    names: dict[str, dict[str, int]] = {}
    for lang, phrase, i in zip(named["lang"].to_pylist(), named["phrase"].to_pylist(), named["id"].to_pylist()):
        names.setdefault(lang, {})[phrase] = i
    keys = keyed["left"].to_numpy().astype(np.int64) << 32 | keyed["right"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    held = None
    if bits is not None:
        held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        held[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return {"names": names, "keys": keys[order], "ids": keyed["id"].to_numpy()[order], "bits": held}


def filter_of(rest: DataFrame) -> DataFrame:
    """word, bits: the words of 64 bits of a filter that holds rest(lang, phrase, left, right); 2^(FILTER_BITS - 6) at most."""
    of_ids = F.shiftright(F.col("left") * 2654435761 + F.col("right") * 2246822519, 7)
    of_text = F.shiftright(F.crc32(F.concat_ws("\0", "lang", "phrase").cast("binary")), 6)
    place = F.coalesce(of_ids, of_text).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return rest.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _in_filter(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = places & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Words:
    """The words of a group of texts of one language, as codes; pieces and texts are parted by code -1."""

    def __init__(self, lang: str, texts: pa.Array):
        parted = pc.binary_join_element_wise(pc.replace_substring_regex(pc.ascii_lower(texts), _STOP, " . "), " . ", "")
        words = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(parted))).dictionary_encode()
        self.lang, self.names = lang, words.dictionary.to_pylist()
        stop = np.array([w == "." for w in self.names])
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = np.where(stop[codes], -1, codes)
        ends = np.flatnonzero(self.codes < 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes))  # words from here to the end of the piece

    def counts(self) -> tuple[list[str], np.ndarray]:
        n = np.bincount(self.codes[self.codes >= 0], minlength=len(self.names))
        at = np.flatnonzero(n)
        return [self.names[i] for i in at], n[at]

    def phrases(self, places: np.ndarray, length: int) -> tuple[list[str], np.ndarray]:
        """The phrases of that length at these places, and for each place the number of its phrase."""
        rows, number = np.unique(np.column_stack([self.codes[places + i] for i in range(length)]), axis=0, return_inverse=True)
        return [" ".join(self.names[c] for c in row) for row in rows], number.reshape(-1)

    def ids(self, levels: list[dict], length: int) -> np.ndarray:
        """Per place the id of the phrase of that length that starts there, or -1."""
        names, keys, ids = (levels[length - 1][x] for x in ("names", "keys", "ids"))
        known = names.get(self.lang, {})
        if length == 1:
            by_code = np.array([known.get(w, -1) for w in self.names], np.int64)
            return np.where(self.codes < 0, -1, by_code[self.codes])
        parts = self.ids(levels, length - 1)
        out = np.full(len(parts), -1, np.int64)
        both = np.flatnonzero((parts[:-1] >= 0) & (parts[1:] >= 0) & (self.left[:-1] >= length))
        if len(both) and len(keys):
            sought = parts[both] << 32 | parts[both + 1]
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            out[both] = np.where(keys[at] == sought, ids[at], -1)
        if known:
            rest = np.flatnonzero(self.left >= length)
            rest = rest[(parts[rest] < 0) | (parts[rest + 1] < 0)]
            found, number = self.phrases(rest, length)
            out[rest] = np.array([known.get(p, -1) for p in found], np.int64)[number]
        return out


    def maybe(self, levels: list[dict], length: int, ids: np.ndarray) -> np.ndarray:
        """Per place whether the phrase of that length that starts there may be frequent; ids: what ids() gives for it."""
        bits, out = levels[length - 1]["bits"], ids >= 0
        if bits is None:
            return out
        rest = np.flatnonzero(~out & (self.left >= length))
        if length > 1:
            parts = self.ids(levels, length - 1)
            keyed = (parts[rest] >= 0) & (parts[rest + 1] >= 0)
            at = rest[keyed]
            out[at] = _in_filter(bits, (parts[at] * 2654435761 + parts[at + 1] * 2246822519) >> 7)
            rest = rest[~keyed]
        if len(rest):
            names, number = self.phrases(rest, length)
            crc = np.array([zlib.crc32(f"{self.lang}\0{name}".encode()) >> 6 for name in names], np.int64)
            out[rest] = _in_filter(bits, crc)[number]
        return out


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for start, stop in byte_groups(batch.column("text"), GROUP_BYTES):
            part = batch.slice(start, stop - start)
            langs = part.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield Words(lang, part.column("text").filter(pc.equal(langs.indices, i)))
            pa.default_memory_pool().release_unused()


def count_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, f for every word; docs: lang and text, without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _by_language(batches):
            names, n = words.counts()
            yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "f"])

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def count_pairs(docs: DataFrame, levels: list, whole: bool, tile: int = TILE) -> DataFrame:
    """Counts of the phrases that are one word longer than those of the last of levels: by the ids of their two parts (key:
    left << 32 | right), or by lang and phrase where a part has no id although it may be frequent, which whole rules out.
    levels: broadcast values of level(). A task gives each key once, so rows are three numbers and combine after the shuffle."""
    length = len(levels) + 1
    schema = pa.schema([("key", pa.int64()), ("f", pa.int64())] + [("lang", pa.string()), ("phrase", pa.string())] * (not whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [x.value for x in levels], TileCounts(tile)

        def batch_of(keys: pa.Array, n: np.ndarray, lang: str | None, phrases: pa.Array | None) -> pa.RecordBatch:
            texts = [] if whole else [pa.array([lang] * len(n), pa.string()), phrases if lang is not None else pa.nulls(len(n), pa.string())]
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), *texts], schema=schema)

        def counted() -> Iterator[pa.RecordBatch]:
            for keys, n in counts.take():
                for i in range(0, len(n), 1 << 18):
                    some = slice(i, i + (1 << 18))
                    yield batch_of(pa.array(keys[some], pa.int64()), n[some], None, None)

        for words in _by_language(batches):
            ids = words.ids(held, length - 1)
            inside = np.flatnonzero(words.left >= length)
            keyed = (ids[inside] >= 0) & (ids[inside + 1] >= 0)
            at = inside[keyed]
            counts.add(ids[at], ids[at + 1])
            if not whole:
                ok = words.maybe(held, length - 1, ids)
                names, number = words.phrases(inside[~keyed & ok[inside] & ok[inside + 1]], length)
                yield batch_of(pa.nulls(len(names), pa.int64()), np.bincount(number, minlength=len(names)), words.lang, pa.array(names, pa.string()))
            if counts.full():
                yield from counted()
        yield from counted()

    made = docs.mapInArrow(run, "key long, f long" + ("" if whole else ", lang string, phrase string"))
    made = made.groupBy(*(c for c in made.columns if c != "f")).agg(F.sum("f").alias("f"))
    return made if whole else made.select("key", "f", "lang", "phrase")


def ranked(phrases: DataFrame, name: str) -> DataFrame:
    """phrases with ids from 0 by falling frequency: a global sort, then places within partitions plus the rows of those before."""
    placed = phrases.orderBy(F.col("f").desc(), "lang", "phrase").withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = stored(placed, name)
    parts = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", "_first", before.alias("_before"))
    return stored(placed.join(parts, "_part").select(*phrases.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias("id")), f"{name}-ids")


def _named(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """lang, phrase, left, right, f of what count_pairs counted; ids: lang and phrase by id of the level below."""
    if "phrase" not in pairs.columns:
        pairs = pairs.withColumns({"lang": F.lit(None).cast("string"), "phrase": F.lit(None).cast("string")})
    left, right = F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = pairs.select("lang", "phrase", "f", left.alias("left"), right.alias("right"))
    a = ids.select(F.col("id").alias("left"), F.col("lang").alias("_lang"), F.col("phrase").alias("_head"))
    b = ids.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("_tail"))
    keyed = pairs.where("left IS NOT NULL").join(a, "left").join(b, "right")
    keyed = keyed.select(F.col("_lang").alias("lang"), F.concat_ws(" ", "_head", "_tail").alias("phrase"), "left", "right", "f")
    return keyed.unionByName(pairs.where("left IS NULL").select(*keyed.columns))


def _scored(phrases: DataFrame, by_length: dict[int, DataFrame], length: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut, the first of equals."""
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"))
    made = []
    for k in range(1, length):
        part = lambda words, n, f: words.select("lang", F.col("phrase").alias(f"_{n}{k}"), F.col("f").alias(f))  # noqa: B023, E731
        cuts = cuts.withColumns({f"_l{k}": F.substring_index("phrase", " ", k), f"_r{k}": F.substring_index("phrase", " ", k - length)})
        cuts = cuts.join(part(by_length[k], "l", f"l{k}"), ["lang", f"_l{k}"]).join(part(by_length[length - k], "r", f"r{k}"), ["lang", f"_r{k}"])
        score = F.call_function("div", exact("a") * exact("a") * F.lit(SCALE).cast("decimal(7,0)"), exact(f"l{k}") * exact(f"r{k}"))
        made.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return cuts.select("lang", "phrase", "a", F.array_min(F.array(*made)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inner(phrases: DataFrame, length: int) -> DataFrame:
    """lang, phrase of every shorter phrase of two words or more within these, and the most occurrences of one around it."""
    words = F.split("phrase", " ")
    inside = [F.array_join(F.slice(words, i, m), " ") for m in range(2, length) for i in range(1, length - m + 2)]
    return phrases.select("lang", F.explode(F.array(*inside)).alias("phrase"), F.col("f").alias("_around"))


def mine(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST,
    cover_percent: int = COVER_PERCENT, top: int = TOP, broadcast_ids: int = BROADCAST_IDS, tile: int = TILE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to longest words.

    a, l and r are the occurrences of the phrase and of the two sides of its weakest cut, n the words of the language, and
    score the floor of SCALE * a * a / (l * r).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = stored(count_words(rows), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    nothing = F.lit(None).cast("long")
    frequent = words.where(F.col("f") >= min_count).select("lang", "phrase", nothing.alias("left"), nothing.alias("right"), "f")
    by_length, levels, scored, inner = {}, [], [], []
    for length in range(1, longest + 1):
        if length > 1:
            counted = stored(count_pairs(rows, levels, whole, tile).where(F.col("f") >= min_count), f"phrases-{length}")
            frequent = _named(counted, below)
        if length < longest:
            ids = ranked(frequent, f"ranked-{length}")
            below = ids
            by_length[length] = ids.select("lang", "phrase", "f")
            room = F.when(F.col("left").isNull(), broadcast_ids).otherwise(KEYS_A_NAME * broadcast_ids)
            named = F.col("left").isNull()
            sent = ids.where(F.col("id") < room).select(F.when(named, F.col("lang")).alias("lang"), F.when(named, F.col("phrase")).alias("phrase"), "left", "right", "id").toArrow()
            rest = ids.where(F.col("id") >= room)
            whole = rest.isEmpty()
            levels.append(spark.sparkContext.broadcast(level(sent, None if whole else filter_of(rest).toArrow())))
        else:
            by_length[length] = stored(frequent.select("lang", "phrase", "f"), f"named-{length}")
        if length > 1:
            scored.append(_scored(by_length[length], by_length, length))
        if length > 2:
            inner.append(_inner(by_length[length], length))
    found = scored[0]
    for more in scored[1:]:
        found = found.unionByName(more)
    if inner:
        around = inner[0]
        for more in inner[1:]:
            around = around.unionByName(more)
        around = around.groupBy("lang", "phrase").agg(F.max("_around").alias("_around"))
        found = found.join(around, ["lang", "phrase"], "left").where(F.col("_around").isNull() | (100 * F.col("_around") < cover_percent * F.col("a"))).drop("_around")
    return best(found, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first top rows of each language; those of each hash of the phrase are picked first, so no task sorts a language."""
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
