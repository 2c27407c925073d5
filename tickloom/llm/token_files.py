"""Token ids in Parquet files that can be read in parts.

Rows are put in order of their ids over a range partitioning, each partition is encoded and written as one file, and a
manifest holds one row per file. In a file, token ids are a list column with dictionary encoding (a vocabulary fits one dictionary
page), the ascending columns beside it are delta encoded, row groups and pages are of set sizes, and the writer adds column and offset
indexes. So metadata are read without touching a token, and a range of ids or of token places is read from the row groups
and pages that hold it.

Encoding goes through units: a text is cut where the vocabulary's pre-tokenizer starts a new piece in every case, and a unit
is encoded once by the library and kept while the cache has room. Such places are a space or line end after what is not
white space, what follows a single line end, and a mark after a letter: tokens hold a space at their front only or are
white space altogether, and no mark but ' and _ after a letter. Where a special string holds such a character, texts
are not cut there. The cache belongs to the Python worker, so that its tasks learn from each other; once full it drops the units that
few groups of texts had, which most new words are.

Defined results: a null text counts as empty and gets the end id alone; rows come by id, null ids first, equal ids by their
text; equal rows are written one by one and may take each other's place; an empty table gives files without rows. Other
columns are not written. A hot id is spread over files by hashes of its texts and by its place in the input. Lost executors
cost their tasks: files appear when a task commits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_groups, free_name, is_small, library_tokenizer, of_worker

END_ID = 0
GROUP_BYTES = 4 << 20
#: Once the cache of units holds so many characters, it keeps the units that so many groups of texts had since the last time, or
#: as much more often as makes half of it free.
CACHE_CHARS = 4 << 20
CACHE_GROUPS = 3
#: Marks that begin a unit after a letter. Some pre-tokenizers keep ' and _ with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
#: Manifests up to so many rows, each a few numbers, are broadcast; beyond, the join shuffles.
BROADCAST_FILES = 200_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512

#: Units in one text, and texts in one call: the library is slower on longer texts.
_JOINED = 256
_CALL = 64


def unit_starts(data: np.ndarray, starts: np.ndarray, marks: str = MARKS) -> np.ndarray:
    """Places in data, the bytes of texts that begin at starts, where units begin: at a text's start; at a space or line end
    after a character that is surely not white space; after a line end between two such characters; and at one of marks
    after an ASCII letter."""
    low = int(starts[0]) if len(starts) else 0
    padded = np.concatenate([np.zeros(4, np.uint8), data])
    byte = lambda at, back: padded[at + 4 - back]

    def solid(at: np.ndarray, back: int) -> np.ndarray:
        """Whether the character that ends back bytes before at is not white space: ASCII marks, letters and digits, two bytes
        from U+00C0 on, three from U+4000 on, four. Other characters count as white space, which only makes units longer."""
        a, b, c, d = (byte(at, back + i) for i in range(4))
        inner = (a >= 0x80) & (a < 0xC0)
        return ((a > 0x20) & (a < 0x7F)) | inner & ((b >= 0xC3) & (b < 0xE0) | (b >= 0x80) & (b < 0xC0) & ((c >= 0xE4) & (c < 0xF0) | (c >= 0x80) & (c < 0xC0) & (d >= 0xF0)))

    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    found = [at[solid(at, 1)]]
    at = np.flatnonzero(data[:-1] == 0x0A) + 1
    found.append(at[(byte(at, 0) > 0x20) & (byte(at, 0) < 0x7F) & solid(at, 2) & ~np.isin(at - 1, starts)])
    if marks:
        of_marks = np.zeros(256, bool)
        of_marks[list(marks.encode())] = True
        at = np.flatnonzero(of_marks[data])
        before = byte(at, 1) | 0x20
        found.append(at[(before >= 0x61) & (before <= 0x7A)])
    begins = np.zeros(len(data), bool)
    for cuts in found:
        begins[cuts] = True
    begins[:low] = False
    begins[starts] = True
    return np.flatnonzero(begins)


class Encoder:
    """Token ids of texts, by way of units that are encoded once.

    Units that are new go to the library many in one text; the lengths of the tokens in bytes tell which belong to
    which unit. Where those do not meet the units' ends, as with vocabularies that are not of bytes, they go one by one.
    """

    def __init__(self, vocabulary: str, kept: dict | None = None):
        """kept: what an encoder of this vocabulary has kept, to go on with, or an empty dictionary to be filled."""
        if kept is not None:
            self.__dict__ = kept
        if kept:
            return
        self.tokenizer = library_tokenizer(vocabulary)
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        n_bytes = np.zeros(max(known.values()) + 1, np.int64)
        n_bytes[list(known.values())] = [len(token) for token in known]  # a character of a token stands for a byte
        self.n_bytes = n_bytes
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = "".join(c for c in MARKS if not any(c in token for token in added))
        self.cuts = not any(c in token for token in added for c in " \n")
        self.slots, self.ids = pa.array([], pa.string()), np.empty(0, np.int32)  # units; their ids in some order
        self.starts, self.counts, self.groups, self.chars = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def _ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after the other, and where each unit's end."""
        n = self.counts[slots]
        after = np.cumsum(n)
        total = int(n.sum())
        kind = np.int32 if len(self.ids) + total < 1 << 31 else np.int64
        return self.ids[np.repeat((self.starts[slots] - after + n).astype(kind), n) + np.arange(total, dtype=kind)], after

    def _drop(self) -> None:
        """Drops units that few groups had."""
        sizes, least = pc.utf8_length(self.slots).to_numpy(), CACHE_GROUPS
        while (chars := int(sizes[self.groups >= least].sum())) > CACHE_CHARS // 2:
            least *= 2
        stay = np.flatnonzero(self.groups >= least)
        self.ids, after = self._ids_of(stay)
        self.slots, self.counts, self.groups, self.chars = self.slots.take(pa.array(stay)), self.counts[stay], np.zeros(len(stay), np.int64), chars
        self.starts = after - self.counts

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for ids in made for i in ids], np.int32), np.array([len(ids) for ids in made], np.int64)

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = ["".join(units[i : i + _JOINED]) for i in range(0, len(units), _JOINED)]
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(made), np.int32, sum(map(len, made)))
        token_ends = np.cumsum(self.n_bytes[ids])
        unit_ends = np.cumsum(pc.binary_length(pa.array(units)).to_numpy())
        last = np.searchsorted(token_ends, unit_ends)
        if last[-1] >= len(ids) or (token_ends[last] != unit_ends).any():
            return self._one_by_one(units)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, slots: pa.StringArray) -> None:
        """Learns the units that slots has beyond those known."""
        units = slots[len(self.slots) :].to_numpy(zero_copy_only=False).tolist()
        follows = np.fromiter((u[0] == " " and ("!" <= u[-1] <= "~" or u[-1].isalnum()) for u in units), bool, len(units))  # may follow each other in one text
        order = np.argsort(~follows, kind="stable")
        units, inner = [units[i] for i in order.tolist()], int(follows.sum())
        ids, counts = [self.ids], [np.empty(0, np.int64)]
        for some, encode in ((units[:inner], self._joined), (units[inner:], self._one_by_one)):
            for i in range(0, len(some), _JOINED * _CALL):
                made = encode(some[i : i + _JOINED * _CALL])
                ids.append(made[0])
                counts.append(made[1])
        counts = np.concatenate(counts)
        place = np.argsort(order)
        self.starts = np.append(self.starts, (len(self.ids) + np.cumsum(counts) - counts)[place])
        self.ids, self.counts, self.groups = np.concatenate(ids), np.append(self.counts, counts[place]), np.append(self.groups, np.zeros(len(units), np.int64))
        self.slots, self.chars = slots, self.chars + sum(map(len, units))

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by end_id, and how many each has."""
        if self.chars > CACHE_CHARS:
            self._drop()
        texts = pa.concat_arrays([texts.cast(pa.string())])  # own buffers, from place 0 on
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        begin = bounds[:-1][np.diff(bounds) > 0]
        begin = unit_starts(data, begin, self.marks) if self.cuts else begin
        units = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, bounds[-1]).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        both = pa.concat_arrays([self.slots, units.dictionary]).dictionary_encode()  # slots keep their places, new units come after them
        slot = both.indices.to_numpy(zero_copy_only=False)[len(self.slots) :]
        self._learn(both.dictionary)
        self.groups[slot] += 1
        out, after = self._ids_of(slot[units.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], after])[np.searchsorted(begin, bounds[1:])]
        sizes = np.diff(ends, prepend=0)
        if end_id is not None:
            out, sizes = np.insert(out, ends, end_id).astype(np.int32), sizes + 1
        return out, sizes


def worker_encoder(vocabulary: str) -> Encoder:
    """An encoder that goes on with the units of the tasks before it in the same Python worker."""
    return Encoder(vocabulary, of_worker("token units", vocabulary, dict))


def write_tokens(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, files: int | None = None) -> None:
    """Writes the ids of every text below path, in ascending order of the rows' ids. vocabulary: path of a tokenizers .json
    file that every executor has; files: how many files to write, by default as many as the session's shuffle partitions."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    by = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = (rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    placed = placed.withColumn("file", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, written = None, 0
        for batch in batches:
            encoder = encoder or worker_encoder(vocabulary)
            for start, stop in byte_groups(batch.column("text"), GROUP_BYTES):
                part = batch.slice(start, stop - start)
                ids, sizes = encoder.encode(part.column("text"), end_id)
                offset = written + np.cumsum(sizes) - sizes
                written += int(sizes.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("file"), pa.array(offset), pa.array(sizes), lists], names=["doc_id", "file", "offset", "n_tokens", "tokens"])

    made = placed.mapInArrow(run, f"doc_id {kind}, file int, offset long, n_tokens long, tokens array<int>")
    options = {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true",
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd",
    }
    made.write.options(**options).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    totals = spark.read.schema(made.schema).parquet(f"{path}/tokens").groupBy("file").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    totals.select("file", before.alias("base"), "n_tokens", "rows").coalesce(1).write.parquet(f"{path}/files")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, base (ids in all files before), n_tokens, rows: one row per file that has rows."""
    return spark.read.schema("file int, base long, n_tokens long, rows long").parquet(f"{path}/files")


def _with_base(spark: SparkSession, path: str, files: DataFrame, id_type: str) -> DataFrame:
    rows = spark.read.schema(f"doc_id {id_type}, file int, offset long, n_tokens long, tokens array<int>").parquet(f"{path}/tokens")
    bases = files.select("file", "base")
    if is_small(bases, BROADCAST_FILES):
        bases = F.broadcast(bases)
    return rows.join(bases, "file").withColumn("start", F.col("base") + F.col("offset"))


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all rows before), n_tokens, tokens. Select what is needed: unselected columns are not read, and
    conditions on doc_id reach row groups and pages."""
    return _with_base(spark, path, manifest(spark, path), id_type).select("doc_id", "start", "n_tokens", "tokens")


def read_span(spark: SparkSession, path: str, first: int, stop: int, id_type: str = "long") -> DataFrame:
    """doc_id, start, tokens of the rows that hold any of the token places first .. stop - 1, with tokens cut to that span.
    Two numbers of the manifest, the first and last file, come to the driver and prune the scan."""
    inside = manifest(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > first))
    low, high = inside.agg(F.min("file"), F.max("file")).first()
    rows = _with_base(spark, path, inside, id_type).where(F.lit(False) if low is None else F.col("file").between(low, high))
    rows = rows.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    keep = (F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")) - skip).cast("int")
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("tokens", skip + 1, keep).alias("tokens"))


def digest_rows(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned numbers of 32 bits) of rows of read()."""
    crc = free_name(rows, "ids_crc32")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            bytes_of = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8))
            bounds = (lists.offsets.to_numpy() * 4).tolist()
            found = pa.array([zlib.crc32(bytes_of[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64())
            names = [n for n in batch.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, crc])

    return rows.mapInArrow(run, f"{kinds}, {crc} long")
