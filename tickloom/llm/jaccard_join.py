"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its distinct word shingles. Two sets link when 100 * |A & B| >= percent * |A | B|. Sets are put
into bands of sizes so that the larger partner of a link is in the smaller one's band or the next. For the band of the larger
partner the two differ in at most H tokens, so if the universe of tokens is dealt into segments and each segment is
allowed p differences (-1, 0 or 1), sum(p + 1) > H makes sure that the difference stays within p in some segment.
Every set files itself, for its own band and the next, under its segments (p = 0) or under its segments and all their
one-deletion neighbours (p = 1); empty segments are skipped (p = -1) as far as spare segments allow. plan_band() chooses
the allocation of least cost: rows filed, plus expected false candidates.

Sets that are equal form one class and are joined once. Each bucket is led by that of its sets which meets most others,
and buckets with one leader are taken together, so sets that meet in many buckets are compared once. First each set is
verified against the likeliest of its leaders, by sizes and parity sketches. Where that leaves the sets of a leader in several
components, few sets are paired; of more, a task finds those whose sketches let them link to a set of another component, and a
second one compares these and returns a spanning forest of their links. Beyond BLOCK sets they are dealt into blocks, and every two
blocks are compared like that. Beyond BLOCKS times as many, which a line that many documents have can bring together, they are first filed
again, once, under the rarest of their tokens: tokens are ordered by how many of these sets have them, and as two sets that link share at
least `percent` of the tokens of either, the first few of both meet. A set that has too many tokens to itself links to none of
them and is filed nowhere. What is large even then is dealt into blocks. No bucket, candidate or partner is capped.

Tokens are 64-bit hashes of shingles and classes 64-bit hashes of sets.

Defined results: texts without words (null too) have no shingles and are their own component; a text shorter than a
shingle is one token; repeated rows with equal texts are linked; a null id takes part and is never a component's id
unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored
from .components import connected

#: Sets of one leader that are paired by expressions, and that one task compares: so many sets and tokens at most.
SMALL_BUCKET = 12
BLOCK = 4_096
BLOCK_TOKENS = 1 << 22
#: Sets of one leader, in blocks, beyond which they are filed again before they are compared.
BLOCKS = 4
STRIP = 256
#: Words of the parity sketch of a set, doubled until it has half a cell per token.
SKETCH = 16
#: Classes that a task of filed() keeps in mind.
SEEN = 500_000
#: Cost of one false candidate, in filed rows.
CANDIDATE_COST = 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * _A
        return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, width: int):
        from xxhash import xxh3_64_intdigest

        self.width, self.digest, self.known = width, xxh3_64_intdigest, {}

    def words(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
        known, digest = self.known, self.digest
        if len(known) > 400_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def tokens(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        width = min(self.width, len(h))
        if not width:
            return h
        with np.errstate(over="ignore"):
            total = np.full(len(h) - width + 1, width, np.uint64)
            for i in range(width):
                total = mix(total * _B + h[i : len(h) - width + 1 + i])
        return np.unique(total)


def band_edges(percent: int, largest: int) -> list[int]:
    """First sizes of the bands, up to one beyond largest."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(100 * edges[-1] // percent + 1)
    return edges


_PLANS: dict[tuple, tuple[int, int, int]] = {}


def plan_band(low: int, high: int, percent: int, n_docs: int) -> tuple[int, int, int]:
    """(differences H, exact segments, deletion segments) for the band of sizes low to high."""
    key = (low, high, percent, n_docs)
    if key not in _PLANS:
        _PLANS[key] = _plan(*key)
    return _PLANS[key]


def _plan(low: int, high: int, percent: int, n_docs: int) -> tuple[int, int, int]:
    h = 2 * high * (100 - percent) // (100 + percent)
    if not h:
        return 0, 0, 0  # only equal sets link
    best = (math.inf, 0, 0)
    size = max(low * percent // 100, 1)
    spares = list(range(25))
    while spares[-1] < h // 4:
        spares.append(spares[-1] * 5 // 4)
    for spare in spares:
        m = h + 1 + spare
        empty = (1 - 1 / m) ** size
        tail = 0.5 * math.erfc((spare + 0.5 - m * empty) / math.sqrt(2 * m * empty * (1 - empty) + 1e-9))  # more empty ones than spare
        cost = m + CANDIDATE_COST * n_docs * tail**2 * min(1, (spare + 1) ** 2 / m)
        best = min(best, (cost, m, 0))
    m = (h + 2) // 2
    light = (1 - 1 / m) ** size + size / m * (1 - 1 / m) ** (size - 1) if m > 1 else 0.0
    best = min(best, (m + high + CANDIDATE_COST * n_docs * m * light**2, 0, m))
    return h, best[1], best[2]


def signatures(tokens: np.ndarray, low: int, high: int, percent: int, n_docs: int) -> np.ndarray:
    """What a set files itself under for the band of sizes low to high."""
    h, exact, deletion = plan_band(low, high, percent, n_docs)
    m = exact + deletion
    if not m:
        return tokens[:0]
    segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the token, so segments are runs
    ends = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        spread = mix(tokens + _A)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
        sums = sums[ends[1:]] - sums[ends[:-1]]
        salt = mix(np.arange(m, dtype=np.uint64) * _B + np.uint64(high * 128 + percent))
        if exact:
            spare = exact - (h + 1)
            filled = ends[1:] > ends[:-1]
            keep = filled if np.count_nonzero(~filled) <= spare else slice(None)
            return mix(sums + salt)[keep]
        less = np.repeat(sums + salt, ends[1:] - ends[:-1]) - spread
        return np.unique(np.concatenate([mix(sums + salt), mix(less)]))


def _fingerprint(tokens: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.sum(mix(tokens ^ _B), dtype=np.uint64) + np.uint64(len(tokens)) * _A)


def _map_texts(docs: DataFrame, width: int, builder, schema: str) -> DataFrame:
    """builder() makes, once per task, what turns the ids and token sets of a batch into batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, build = Shingler(width), builder()
        for batch in batches:
            yield from build(batch.column("doc_id"), (shingler.tokens(t.as_py()) for t in batch.column("text")))

    return docs.mapInArrow(run, schema)


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class (null for empty sets) of docs(doc_id, text)."""

    def build(ids, sets):
        n, prints = [], []
        for s in sets:
            n.append(len(s))
            prints.append(int(_fingerprint(s).view(np.int64)) if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(prints, pa.int64())], names=["doc_id", "n_shingles", "class"])

    return _map_texts(docs, width, lambda: build, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long")


def filed(docs: DataFrame, width: int, percent: int, n_docs: int) -> DataFrame:
    """signature, class: what every set files itself under, for its own band and the next. A task files equal sets once."""

    def builder():
        seen: set[int] = set()

        def build(ids, sets):
            sigs, owners, held = [], [], 0
            edges = band_edges(percent, 1)

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["signature", "class"])

            for s in sets:
                if not len(s):
                    continue
                own_class = _fingerprint(s).view(np.int64)
                if int(own_class) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(int(own_class))
                if len(s) >= edges[-2 if len(edges) > 1 else -1]:
                    edges = band_edges(percent, 2 * 100 * len(s) // percent)
                k = int(np.searchsorted(edges, len(s), side="right")) - 1
                own = [signatures(s, edges[i], edges[i + 1] - 1, percent, n_docs) for i in (k, k + 1)]
                sigs += own
                owners.append(np.full(sum(map(len, own)), own_class))
                held += len(owners[-1])
                if held > 200_000:
                    yield out()
                    sigs, owners, held = [], [], 0
            if held:
                yield out()

        return build

    return _map_texts(docs, width, builder, "signature long, class long")


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Per cell of the universe, whether it holds an odd number of tokens: sets that differ in d tokens differ in at most
    d cells."""
    size = 64 * SKETCH
    while 2 * size < len(tokens):
        size *= 2
    cells = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def token_sets(docs: DataFrame, width: int) -> DataFrame:
    """class, n_tokens, tokens, sketch of docs(doc_id, text)."""

    def build(ids, sets):
        some = [s for s in sets if len(s)]
        prints = pa.array([int(_fingerprint(s).view(np.int64)) for s in some], pa.int64())
        longs, sizes = pa.list_(pa.int64()), pa.array([len(s) for s in some], pa.int32())
        yield pa.RecordBatch.from_arrays([prints, sizes, pa.array([s.view(np.int64) for s in some], longs), pa.array([parity_sketch(s) for s in some], longs)], names=["class", "n_tokens", "tokens", "sketch"])

    return _map_texts(docs, width, lambda: build, "class long, n_tokens int, tokens array<long>, sketch array<long>")


def _may_link(percent: int, apart, n_a, n_b):
    """Whether sets of these sizes that differ in at least `apart` tokens can link; for columns and for arrays."""
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def _involved(percent: int):
    """The sets under one leader that sizes and sketches let link to a set of another component."""

    def run(table: pa.Table) -> pa.Table:
        part, n = table.column("component").to_numpy(), table.column("n_tokens").to_numpy().astype(np.int64)
        sketches = [s.values.to_numpy().view(np.uint64) for s in table.column("sketch")]
        width = min(map(len, sketches))
        sketch = np.array([np.bitwise_xor.reduce(s.reshape(-1, width), axis=0) for s in sketches])
        some = np.zeros(len(part), bool)
        for at in range(0, len(part), STRIP):
            own = slice(at, at + STRIP)
            apart = np.zeros((len(part[own]), len(part)), np.int64)
            for k in range(width):
                apart += np.bitwise_count(sketch[own, k, None] ^ sketch[None, :, k])
            some[own] = (_may_link(percent, apart, n[own, None], n[None, :]) & (part[own, None] != part[None, :])).any(1)
        return table.select(["key", "leader", "class", "component", "n_tokens"]).filter(pa.array(some))

    return run


def _forest(percent: int):
    """Of the sets under one leader: links that, with the components known, connect whatever links connect. Sets are
    taken as their differences from the leader: two of them are as far apart as their differences."""

    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("class").to_numpy(), return_index=True)
        part, tokens = table.column("component").to_numpy()[first], [table.column("tokens")[int(i)].values.to_numpy() for i in first]
        part, size = np.unique(part, return_inverse=True)[1], np.array([len(t) for t in tokens])
        leader = tokens[min(int(np.searchsorted(ids, table.column("leader")[0].as_py())), len(ids) - 1)]  # or any other set of the group
        leader = np.sort(leader)
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(ids)), size)
        at = np.minimum(np.searchsorted(leader, flat), len(leader) - 1)
        has = leader[at] == flat
        lacks = np.ones((len(ids), len(leader)), bool)
        lacks[owner[has], at[has]] = False
        who, what = np.nonzero(lacks)
        extra, code = np.unique(flat[~has], return_inverse=True)
        who, what = np.concatenate([who, owner[~has]]), np.concatenate([what, code + len(leader)])
        order = np.lexsort((who, what))
        holders, starts = who[order], np.searchsorted(what[order], np.arange(len(leader) + len(extra) + 1))
        order = np.argsort(who, kind="stable")
        what, own = what[order], np.searchsorted(who[order], np.arange(len(ids) + 1))
        away = np.diff(own)
        out = []
        main = np.bincount(part).argmax()  # its pairs with others are found from the others
        for i in np.flatnonzero(part != main):
            mine = what[own[i] : own[i + 1]]
            shared = np.zeros(len(ids), np.int64)
            if len(mine):
                shared += np.bincount(np.concatenate([holders[starts[k] : starts[k + 1]] for k in mine]), minlength=len(ids))
            linked = np.flatnonzero((part != part[i]) & _may_link(percent, away[i] + away - 2 * shared, size[i], size))
            for j in linked:
                if part[j] != part[i]:
                    out.append((ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def screen(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, apart of the pairs that sizes and sketches let link."""
    light = sets.select("class", F.col("n_tokens").alias("n"), "sketch")
    side = lambda name: light.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    # Sketches of different lengths are powers of two times each other; the longer is folded, half onto half.
    half = lambda s: F.zip_with(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, F.size(s)), lambda x, y: x.bitwiseXOR(y))
    s_a, s_b = (F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x)) for x, y in (("s_a", "s_b"), ("s_b", "s_a")))
    apart = F.aggregate(F.zip_with(s_a, s_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    even = F.size(s_a) == F.size(s_b)  # more than twice as long: such sets are too far apart in size anyway
    apart = F.when(even, apart).otherwise(0)
    near = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("apart", apart)
    return near.where(_may_link(percent, F.col("apart"), F.col("n_a"), F.col("n_b"))).select("a", "b", "apart").distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that link, by their tokens."""
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.select("a", "b").join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _led(files: DataFrame) -> DataFrame:
    """key, leader, class: the sets that share a bucket with one leader, which is also the key."""
    sizes = files.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    met = files.join(sizes, "signature").groupBy("class").agg(F.sum("n").alias("met"))
    leaders = files.join(met, "class").groupBy("signature").agg(F.max(F.struct("met", "class"))["class"].alias("leader"))
    return files.join(leaders, "signature").select(F.col("leader").alias("key"), "leader", "class").distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, rows["class"] == labels["node"], "left").select(*rows.columns, F.coalesce("component", "class").alias("component"))


def _dealt(rows: DataFrame, size: str, n: str, most: int) -> DataFrame:
    """The rows of each key of more than most by size, and of more than two rows, under a key for each two blocks of about
    most / 2 each; n is the number of rows of the key."""
    blocks = F.when((F.col(size) > most) & (F.col(n) > 2), F.least(F.ceil(2 * F.col(size) / most), n)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64(F.lit(most), "class"), "blocks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own"))
    keys = F.transform(others, lambda i: F.xxhash64("key", F.least("own", i), F.greatest("own", i)))
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("keys", F.when(F.col("blocks") == 1, F.array("key")).otherwise(keys))
    return dealt.withColumn("key", F.explode("keys")).drop("blocks", "own", "keys")


def _refiled(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """signature, class of the sets in large(class, component): each under the rarest of its tokens, as many as are enough for two
    sets that link to meet. Tokens that one set has are the rarest and file nothing. Signatures within one component are dropped."""
    tokens = sets.join(large, "class", "left_semi").select("class", "n_tokens", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = tokens.join(shared, "token").groupBy("class", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    enough = F.greatest(F.size("shared") - F.ceil(percent * F.col("n_tokens") / 100).cast("int") + 1, F.lit(0))
    rows = ordered.select("class", F.explode(F.slice("shared", 1, enough)["token"]).alias("signature")).join(large, "class")
    apart = rows.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("signature")
    return rows.join(apart, "signature").select("signature", "class")


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: classes that are linked; enough of the links to connect whatever is connected by links."""
    rows = filed(docs, width, percent, max(docs.count(), 1))
    every = Window.partitionBy("signature")
    several = rows.withColumn("low", F.min("class").over(every)).withColumn("high", F.max("class").over(every)).where("low <> high")
    files = stored(several.select("signature", "class").distinct(), "shared")
    wanted = files.select("class").distinct()
    readers = classes.groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(wanted, "class", "left_semi").select("doc_id")
    sets = stored(token_sets(docs.join(readers.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(readers["doc_id"]), "left_semi"), width), "sets")

    found = None
    for again in (False, True):
        led = stored(_led(files), "led")
        # Each set with the likeliest of its leaders first: at most one verification per set.
        near = screen(led.where("leader <> class").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct(), sets, percent)
        likeliest = near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        direct = verify(likeliest, sets, percent)
        found = stored(found.union(direct) if again else direct, "found")
        # Pairs of different components are left where the sets of a leader are in several.
        parts = _labelled(led, connected(found))
        several = parts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")
        left = stored(parts.join(several, "key").select("key", "leader", "class", "component", "n"), "several")
        lists = left.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list(F.struct("class", "component")).alias("members"))
        pair = lambda m: F.flatten(F.transform(m, lambda x: F.transform(F.filter(m, lambda y: (x["class"] < y["class"]) & (x["component"] != y["component"])), lambda y: F.struct(x["class"].alias("a"), y["class"].alias("b")))))
        paired = verify(screen(lists.select(F.inline(pair(F.col("members")))).distinct(), sets, percent), sets, percent)
        # What is too large is filed again once, and compared in blocks after that.
        too_many, too_heavy = (F.lit(False), F.lit(False)) if again else (F.col("n") > BLOCKS * BLOCK, (F.col("tokens") > BLOCK_TOKENS) & (F.col("k") > 2))
        more = _dealt(left.where((F.col("n") > SMALL_BUCKET) & ~too_many), "n", "n", BLOCK).join(sets.select("class", "n_tokens", "sketch"), "class")
        involved = stored(more.groupBy("key").applyInArrow(_involved(percent), "key long, leader long, class long, component long, n_tokens int"), "involved")
        involved = involved.join(involved.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("k")), "key")
        compared = _dealt(involved.where(~too_heavy), "tokens", "k", BLOCK_TOKENS).select("key", "leader", "class", "component").join(sets.select("class", "tokens"), "class")
        found = stored(found.union(paired).union(compared.groupBy("key").applyInArrow(_forest(percent), "a long, b long")), "found")
        if again:
            return found
        large = stored(left.where(too_many).select("class", "component").union(involved.where(too_heavy).select("class", "component")).distinct(), "large")
        if large.isEmpty():
            return found
        files = stored(_refiled(large, sets, percent), "shared")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, class, component_id, best (no_id, doc_id, key of the first of the
    component; the last three null for texts without shingles) for every row of docs(doc_id, text)."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    classes = stored(classes_of(keyed, width).select("doc_id.doc_id", "doc_id.key", "n_shingles", "class"), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = stored(classes.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"), F.min(rank).alias("best")), "first")
    edges = links(docs, classes.where("class IS NOT NULL"), width, percent)
    labels = connected(stored(edges, "links"))
    # The smallest class of a component stands for it; its smallest doc_id is the component's id.
    named = first.join(labels, first["class"] == labels["node"], "left").select("class", "first", "best", F.coalesce("component", "class").alias("group"))
    lowest = named.groupBy("group").agg(F.min("first").alias("component_id"), F.min("best").alias("best"))
    named = stored(named.select("class", "group").join(lowest, "group").select("class", "component_id", "best"), "named")
    return classes.join(named, "class", "left")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, class for every row of docs."""
    out = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width, percent)
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Of the rows of docs that are linked, over any path, those of the smallest id, with one text; where no row has an id,
    one row. Rows are told apart by id and text, so another text of the same id stays. Repeated rows of the smallest id with
    the same text all stay; texts without shingles stay."""
    found = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width, percent).where("class IS NOT NULL")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    key, gone_id, gone_key, repeated_key = (free_name(docs, name) for name in ("key", "gone", "gone_key", "repeated"))
    gone = stored(found.where(~is_best).select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "gone")
    rows = docs.withColumn(key, F.xxhash64(text_col))
    kept = rows.join(gone.hint("shuffle_hash"), rows[id_col].eqNullSafe(gone[gone_id]) & (rows[key] == gone[gone_key]), "left_anti")
    repeated = stored(found.where(is_best & F.col("best.no_id")).groupBy(F.col("key").alias(repeated_key)).count().where("count > 1").select(repeated_key), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    # Rows without an id that are equal: any one of them, chosen before the shuffle.
    kept, no_id = stored(kept, "kept"), F.col(id_col).isNull()
    one = kept.where(no_id).join(repeated, F.col(key) == F.col(repeated_key), "left_semi").dropDuplicates([key])
    others = kept.where(no_id).join(repeated, F.col(key) == F.col(repeated_key), "left_anti")
    return kept.where(~no_id).unionByName(others).unionByName(one).select(*docs.columns)
