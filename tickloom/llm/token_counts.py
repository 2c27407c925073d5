"""Token counts in Arrow batches.

Every text is cut where no token can span the cut, pieces are put into groups of about equal bytes, each group is
encoded in one call of the tokenizer library, and only lengths leave the task.

A cut is made before white space that follows a letter, digit or ASCII mark, or before a full-width mark that follows a
letter or digit. The vocabulary's pre-tokenizer starts a new piece at such a place in every case, what ends before it has no
white space to look ahead to, and no special string holds white space or full-width marks. So the sum over pieces is the
count of the whole text. A long text without such a place stays whole.

Defined results: a null text counts as empty, with 0 bytes and tokens; repeated rows are counted one by one. No row is
shuffled, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import library_tokenizer

LIMIT = 512
PIECE_CHARS = 16_384
GROUP_BYTES = 1 << 19

_CUT = re.compile(r"(?<=[\w!-~])(?=[ \t\n\r])|(?<=[^\W_])(?=[。、，！？；：])")


def pieces(text: str, longest: int = PIECE_CHARS) -> list[str]:
    """text in pieces of about longest characters, cut at safe places only."""
    out, at = [], 0
    while len(text) - at > longest:
        found = _CUT.search(text, at + longest)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def lengths(tokenizer, texts: list[str], group_bytes: int = GROUP_BYTES) -> list[int]:
    """Tokens of each text."""
    counts, group, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, e in zip(owners, tokenizer.encode_batch_fast(group, add_special_tokens=False)):
            counts[i] += len(e)
        group.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            if not piece:
                continue
            group.append(piece)
            owners.append(i)
            held += len(piece.encode())
            if held >= group_bytes:
                flush()
                held = 0
    if group:
        flush()
    return counts


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. vocabulary: path of a tokenizers .json file that every executor has."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library_tokenizer(vocabulary)
        for batch in batches:
            counts = lengths(tokenizer, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
