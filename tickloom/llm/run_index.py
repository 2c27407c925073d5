"""Long repeats across documents by a run-length index.

Every byte that is covered by a LENGTH-byte string which also starts in a document of a smaller id is marked.

1. Anchors. Of the ANCHOR-byte strings inside each LENGTH-byte string that with the smallest hash is its anchor, so equal
   LENGTH-byte strings have equal anchors. Anchors that two different texts share are found by a shuffle on their hash;
   texts without any are done.
2. Regions. Around each shared anchor the text of the LENGTH-byte strings that it is the anchor of is cut out. A task keeps
   equal regions once, with all their places packed.
3. Index. Regions are dealt by anchor, so equal LENGTH-byte strings meet in a group. Of a region, all documents but the least have
   every string marked. For the least documents each group builds the Burrows-Wheeler transform of its distinct regions (an anchor with a single
   region needs none), keeps its runs with the suffix positions at both ends of each run, and streams every region
   through it from right to left: matching statistics by LF steps on runs, moving to the nearer end of a neighbouring run at a mismatch. Where the
   match is at least LENGTH long, the rows that share those bytes know the smallest document among them.
4. Marks go back to the documents, which drop the marked bytes.

Equal texts are one class: all but its smallest id are covered whole. Groups are sized by bytes, not by a cap.

Defined results: a null text is empty; texts under LENGTH bytes have nothing removed; a null id is larger than any other; rows of equal id
never remove from each other; an empty table gives no rows. doc_id is a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 50
ANCHOR = 20
STARTS = LENGTH - ANCHOR + 1
CHUNK = 1 << 20
FLUSH = 400_000
#: Bytes of text whose anchors one group holds, and bytes of regions that one index covers.
GROUP_BYTES = 16 << 20
INDEX_BYTES = 3 << 19
#: Bytes of regions that a task holds to find equal ones.
HELD_BYTES = 32 << 20
NULL_ID = (1 << 63) - 1

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def _combined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of a run of shift symbols followed by what b covers."""
    return _mix(a[: len(b) - shift] * _P + b[shift:]) if len(b) > shift else a[:0]


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of length symbols."""
    with np.errstate(over="ignore"):
        power, size, done, covered = symbols.astype(np.uint64) + _P, 1, None, 0
        while True:
            if length & size:
                done, covered = (power, size) if done is None else (_combined(done, power, covered), covered + size)
            if covered == length:
                return done
            power, size = _combined(power, power, size), 2 * size


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every window of that width."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of data, and the least hash of each LENGTH-byte string (0 where a string would
    span two texts). owner: the text that each byte belongs to."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = gram_hashes(data, ANCHOR)
    least = _sliding(h, STARTS, np.minimum)
    if owner is not None:
        least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0
    pad = np.zeros(STARTS - 1, np.uint64)
    chosen = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), STARTS, np.maximum) == h) & (h > 0))
    return chosen, h[chosen], least


def anchor_keys(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, 40 more bits) of anchor hashes. Groups grow with the data, so anchors that agree in both by chance stay rare;
    they would only send more regions to the index."""
    return (h % np.uint64(parts)).astype(np.int64), h >> np.uint64(24)


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text number of each byte, numbers, offsets in the text): whole texts put together, long ones in overlapping parts."""
    parts, held = [], 0

    def out():
        sizes = np.array([len(p) for _, _, p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), owner, np.array([i for i, _, _ in parts]), np.array([o for _, o, _ in parts]) - (np.cumsum(sizes) - sizes)

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            parts.append((i, at, text[at : at + CHUNK + LENGTH - 1]))
            held += len(parts[-1][2])
            if held >= CHUNK:
                yield out()
                parts, held = [], 0
    if parts:
        yield out()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchor_rows(parts: int):
    """Anchors of each task's texts, packed by group: their hashes, and runs of (id, class, number of hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["part", "hashes", "ids", "prints", "counts"]

        def out():
            h, d, f = (np.concatenate(c) for c in zip(*held))
            part, h = anchor_keys(h, parts)
            order = np.lexsort((h, d, f, part))
            h, d, f, part = h[order], d[order], f[order], part[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (f[1:] != f[:-1])])
            h, d, f, part = h[new], d[new], f[new], part[new]
            run = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (part[1:] != part[:-1])]))
            n = np.diff(np.concatenate([run, [len(h)]])).astype(np.uint32)
            of = part[run]
            cut, at = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(of, np.arange(parts + 1))
            some = [p for p in range(parts) if cut[p + 1] > cut[p]]
            pack = lambda x, edges: pa.array([x[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary())
            five = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5])
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pack(five, cut), pack(d[run], at), pack(f[run], at), pack(n, at)], names=names)

        size = 0
        for batch in batches:
            ids, prints = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy()
            for data, owner, numbers, _ in chunks(_texts(batch)):
                at, h, _ = anchors(data, owner)
                who = numbers[owner[at]]
                held.append((h, ids[who], prints[who]))
                size += len(h)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _shared_anchors(parts: int):
    return lambda table: _shared_in_group(table, parts)


def _shared_in_group(table: pa.Table, parts: int) -> pa.Table:
    """id, print, hashes: the anchors of one group that two classes share, for the first document of each class."""
    unpack = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    five, n = unpack("hashes", np.uint8).reshape(-1, 5), unpack("counts", np.uint32)
    h = np.concatenate([five, np.zeros((len(five), 3), np.uint8)], axis=1).view(np.uint64).ravel()
    h = h * np.uint64(parts) + np.uint64(table.column("part")[0].as_py())
    d, f = np.repeat(unpack("ids", np.int64), n), np.repeat(unpack("prints", np.int64), n)
    order = np.lexsort((d, f, h))
    h, d, f = h[order], d[order], f[order]
    other = np.concatenate([[True], h[1:] != h[:-1]])
    first = other | np.concatenate([[True], f[1:] != f[:-1]])
    h, d, f, other = h[first], d[first], f[first], other[first]
    single = other & np.concatenate([other[1:], [True]])
    h, d, f = h[~single], d[~single], f[~single]
    order = np.lexsort((h, f, d))
    h, d, f = h[order], d[order], f[order]
    run = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])])) if len(h) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([run, [len(h)]]), pa.int32()), pa.array(h.view(np.int64)))
    return pa.table({"doc_id": pa.array(d[run]), "print": pa.array(f[run]), "hashes": lists})


def _regions(parts: int):
    """hash, region, places: the distinct regions of a task's documents; places are packed (id, print, start)."""
    names = ["hash", "region", "places"]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        regions = pa.chunked_array([r for r, *_ in held]).combine_chunks().dictionary_encode()
        h, d, f, start = (np.concatenate(c) for c in list(zip(*held))[1:])
        code = regions.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(regions.dictionary) + 1))
        h, d, f, start = h[order], d[order], f[order], start[order]
        places = np.stack([d, f, start], axis=1).tobytes()
        offsets = pa.py_buffer((edges * 24).astype(np.int32).tobytes())
        places = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(places)])
        return pa.RecordBatch.from_arrays([pa.array(h[edges[:-1]]), regions.dictionary, places], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            texts = _texts(batch)
            ids, prints = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy()
            sets = [np.unique(w.values.to_numpy().view(np.uint64)) for w in batch.column("hashes")]
            for data, owner, numbers, offsets in chunks(texts):
                at, h, least = anchors(data, owner)
                group, rest = anchor_keys(h, parts)
                key = rest * np.uint64(parts) + group.astype(np.uint64)
                keep = np.zeros(len(at), bool)
                edges = np.searchsorted(owner[at], np.arange(len(numbers) + 1))
                for k, i in enumerate(numbers):
                    mine = key[edges[k] : edges[k + 1]]
                    keep[edges[k] : edges[k + 1]] = sets[i][np.minimum(np.searchsorted(sets[i], mine), len(sets[i]) - 1)] == mine
                at, h, key = at[keep], h[keep], key[keep]
                if not len(at):
                    continue
                # The strings that begin at most STARTS - 1 bytes before the anchor and have it as their least hash.
                begin = at[:, None] + np.arange(1 - STARTS, 1)
                own = (begin >= 0) & (begin < len(least)) & (least[np.clip(begin, 0, len(least) - 1)] == h[:, None])
                first, last = begin[:, 0] + own.argmax(1), begin[:, -1] - own[:, ::-1].argmax(1)
                part = owner[at]
                who, shift = numbers[part], offsets[part]
                buffer = data.tobytes()
                regions = pa.array([buffer[s:e] for s, e in zip(first.tolist(), (last + LENGTH).tolist())], pa.binary())
                held.append((regions, key.view(np.int64), ids[who], prints[who], first + shift))
                size += regions.nbytes
                if size >= HELD_BYTES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


class Intervals:
    """The number of the interval that a row is in, from the first row of each."""

    def __init__(self, heads: np.ndarray):
        self.heads = heads

    def __getitem__(self, row):
        return np.searchsorted(self.heads, row, side="right") - 1


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of strings, each with a label. Lengths are told apart up to DEPTH."""

    DEPTH = 56

    def __init__(self, strings: list[bytes], labels: np.ndarray, length: int = LENGTH):
        self.length = length
        sizes = np.array([len(s) + 1 for s in strings])
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int64) + 1
        text[np.cumsum(sizes) - 1] = 0  # an end mark smaller than any byte
        self.text, n = text.astype(np.int16), len(text)
        # Rotations of the whole text by their first symbols: as many as fit a word, then three times as many, and so on.
        codes = np.unique(text, return_inverse=True)[1]
        bits = int(codes.max(initial=0)).bit_length() or 1
        rank, width = np.zeros(n, np.int64), 62 // bits
        for i in range(width):
            rank = rank << bits | np.roll(codes, -i)
        rank = np.unique(rank, return_inverse=True)[1]
        while rank.max(initial=0) < n - 1 and width < n:
            times = 3 if n < 1 << 21 else 2
            joined = rank
            for k in range(1, times):
                joined = joined * n + np.roll(rank, -k * width)
            rank, width = np.unique(joined, return_inverse=True)[1], width * times
        suffixes = np.argsort(rank, kind="stable")
        last = text[suffixes - 1]  # the transform; the text is taken as a circle
        self.first = np.searchsorted(text[suffixes], np.arange(258))
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        ends = np.concatenate([starts[1:], [n]])
        symbol, size = last[starts], ends - starts
        order = np.argsort(symbol, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        lead = np.zeros(len(starts), np.int64)
        lead[order] = before  # symbols are in order, so this is first[symbol] plus the equal symbols before
        self.starts, self.symbol, self.lead, self.n = starts, symbol, lead, n
        self.at_start, self.at_end, self.ends = suffixes[starts], suffixes[ends - 1], ends
        self.by_symbol = symbol[order] * (len(starts) + 1) + order
        self.order = order
        # Rows whose suffixes begin with the same `length` symbols, none of them an end mark, are an interval.
        label_of = np.repeat(labels, sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(n)
        whole = left[suffixes] >= length
        h = gram_hashes(np.concatenate([text, np.zeros(length - 1, np.int64)]), length)[suffixes]
        heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | ~whole[1:] | ~whole[:-1]]))
        self.least = np.minimum.reduceat(label_of[suffixes], heads)
        self.interval, self.least = Intervals(heads[whole[heads]]), self.least[whole[heads]]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols (DEPTH at most) in common from positions a and b on."""
        k = np.arange(self.DEPTH)
        same = self.text[np.minimum(a[:, None] + k, self.n - 1)] == self.text[np.minimum(b[:, None] + k, self.n - 1)]
        same &= (a[:, None] + k < self.n) & (b[:, None] + k < self.n)
        return np.where(same.all(1), self.DEPTH, same.argmin(1))

    def matches(self, patterns: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place from the right end: (symbols from there to the end, patterns that reach so far, length of the
        longest match from there on, DEPTH at most, its row)."""
        sizes = np.array([len(p) for p in patterns])
        wide = int(sizes.max(initial=0))
        matrix = np.zeros((len(patterns), wide), np.int64)
        flat = np.frombuffer(b"".join(patterns), np.uint8)
        who = np.repeat(np.arange(len(patterns)), sizes)
        matrix[who, np.arange(len(flat)) - np.repeat(np.cumsum(sizes), sizes) + wide] = flat.astype(np.int64) + 1
        row, place, length = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.at_start[0]), np.zeros(len(patterns), np.int64)
        for back in range(1, wide + 1):
            live = np.flatnonzero(sizes >= back)
            c, i, p, ln = matrix[live, wide - back], row[live], place[live], length[live]
            run = np.searchsorted(self.starts, i, side="right") - 1
            off = np.flatnonzero(self.symbol[run] != c)
            if len(off):
                key = c[off] * (len(self.starts) + 1) + run[off]
                j = np.searchsorted(self.by_symbol, key)
                up, down = self.order[np.maximum(j - 1, 0)], self.order[np.minimum(j, len(self.order) - 1)]
                has_up, has_down = (j > 0) & (self.symbol[up] == c[off]), (j < len(self.order)) & (self.symbol[down] == c[off])
                long_up = np.where(has_up, np.minimum(ln[off], self._common(p[off], self.at_end[up])), -1)
                long_down = np.where(has_down, np.minimum(ln[off], self._common(p[off], self.at_start[down])), -1)
                take_up = long_up >= long_down
                run[off] = np.where(take_up, up, down)
                i[off] = np.where(take_up, self.ends[up] - 1, self.starts[down])
                p[off] = np.where(take_up, self.at_end[up], self.at_start[down])
                ln[off] = np.maximum(long_up, long_down)  # -1 if the symbol is nowhere: the match is empty after the step
            found = self.symbol[run] == c
            row[live] = np.where(found, self.lead[run] + i - self.starts[run], i)
            place[live] = np.where(found, (p - 1) % self.n, p)
            length[live] = np.minimum(np.where(found, ln + 1, 0), self.DEPTH)
            yield back, live, length[live], row[live]


def _marks(table: pa.Table) -> pa.Table:
    """doc_id, print, start, mask: of each region of one group, which of its LENGTH-byte strings are in a smaller document."""
    regions = table.column("region").combine_chunks().dictionary_encode()
    which, strings = regions.indices.to_numpy(), regions.dictionary.to_pylist()
    packed = table.column("places").to_pylist()
    which = np.repeat(which, [len(p) // 24 for p in packed])
    docs, prints, starts = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 3).T
    hashes = np.zeros(len(strings), np.int64)
    hashes[regions.indices.to_numpy()] = table.column("hash").to_numpy()  # a region has one anchor
    ids = np.full(len(strings), NULL_ID)
    np.minimum.at(ids, which, docs)
    masks = np.zeros(len(strings), np.int64)
    _, kind, times = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.flatnonzero(times[kind] > 1)  # a region that is alone with its anchor has its strings to itself
    order = order[np.argsort(hashes[order], kind="stable")]  # regions of an anchor stay together
    at, key = 0, hashes[order]
    total = np.cumsum([len(strings[i]) + 1 for i in order])
    while at < len(order):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + INDEX_BYTES)), at + 1)
        end = int(np.searchsorted(key, key[end - 1], side="right"))
        some = order[at:end]
        own = [strings[i] for i in some]
        index = RunLengthIndex(own, ids[some])
        size = np.array([len(s) for s in own])
        for back, live, length, row in index.matches(own):
            if back >= LENGTH:
                hit = np.flatnonzero(length >= LENGTH)
                hit = hit[index.least[index.interval[row[hit]]] < ids[some][live[hit]]]
                masks[some[live[hit]]] |= np.int64(1) << (size[live[hit]] - back)
        at = end
    full = np.array([(1 << max(len(s) - LENGTH + 1, 0)) - 1 for s in strings], np.int64)
    mask = np.where(docs > ids[which], full[which], masks[which])
    keep = mask != 0
    return pa.table({name: pa.array(x[keep]) for name, x in (("doc_id", docs), ("print", prints), ("start", starts), ("mask", mask))})


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.arange(STARTS)
    for batch in batches:
        out = []
        for text, marks in zip(_texts(batch), batch.column("marks")):
            fields = marks.values.flatten()
            start, mask = fields[0].to_numpy(), fields[1].to_numpy()
            begins = (start[:, None] + bits)[(mask[:, None] >> bits) & 1 == 1]
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, np.unique(begins), 1)
            np.add.at(change, np.unique(begins) + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
            out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        columns = zip(*out) if out else ((), (), ())
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), *arrays], names=["doc_id", "print", "gone", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text")).withColumn("print", F.xxhash64("text"))
    meta = stored(docs.select("doc_id", "print", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    size = meta.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))

    parts = max(-(-size // GROUP_BYTES), wide)
    packed = docs.mapInArrow(_anchor_rows(parts), "part int, hashes binary, ids binary, prints binary, counts binary")
    shared = stored(packed.groupBy("part").applyInArrow(_shared_anchors(parts), "doc_id long, print long, hashes array<long>"), "anchors")
    n_shared = shared.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]

    hits = shared.groupBy("doc_id", "print").agg(F.flatten(F.collect_list("hashes")).alias("hashes"))
    regions = docs.join(hits.hint("shuffle_hash"), ["doc_id", "print"]).mapInArrow(_regions(parts), "hash long, region binary, places binary")
    groups = max(-(-n_shared * (STARTS + LENGTH) // INDEX_BYTES), wide)
    dealt = regions.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(groups))).groupBy("part")
    marks = stored(dealt.applyInArrow(_marks, "doc_id long, print long, start long, mask long"), "marks")

    of = marks.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    gone = stored(docs.join(of.hint("shuffle_hash"), ["doc_id", "print"]).mapInArrow(_removals, "doc_id long, print long, gone long, spans long, kept string").dropDuplicates(["doc_id", "print"]), "removed")

    first = meta.groupBy("sha").agg(F.min("doc_id").alias("first"))
    rows = meta.join(stored(first, "first"), "sha").join(gone, ["doc_id", "print"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, some, none: F.when(copy, whole).otherwise(F.coalesce(some, none))
    return rows.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        pick(F.col("n_bytes"), F.col("gone"), F.lit(0)).alias("n_removed"), pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept"), F.col("sha")).alias("kept_sha256"),
    )
