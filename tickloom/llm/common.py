"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class (ASCII white space).
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one below its warehouse; on a cluster
    that is an error, because its machines may share no folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later reads need none of its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for null or blank texts."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(bare, F.lit("")) == "", none).otherwise(F.split(bare, SPACE + "+"))


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def byte_groups(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of neighbouring texts that have most bytes together at most, or of one longer text."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def of_worker(kind: str, path: str, make: Callable[[], object]) -> object:
    """What make() gives, made once per Python worker, kind and state of the file at path. As functions come to each task anew,
    with globals of their own, such objects are kept in a module of their own."""
    kept = vars(sys.modules.setdefault("tickloom_kept", types.ModuleType("tickloom_kept")))
    about = os.stat(path)
    key = f"{kind} {path} {about.st_mtime_ns} {about.st_size}"
    if key not in kept:
        kept[key] = make()
    return kept[key]


def library_tokenizer(vocabulary: str):
    """The tokenizers library's object for a .json file, without truncation or padding: one per Python worker. The library keeps
    some megabytes of each object that has encoded, for good, so one per task would fill a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make():
        made = Tokenizer.from_file(vocabulary)
        made.no_truncation()
        made.no_padding()
        return made

    return of_worker("tokenizer", vocabulary, make)
