"""Secret scans with an incremental ledger of blobs.

Each version of a text is addressed by its content (SHA-256). A ledger holds, per blob and rule version, the spans found.
A scan works on the pairs that the ledger lacks, reads one copy of each such blob, appends to the ledger, and joins its
rows back to every path that has the blob. All of it is DataFrame expressions.

Defined results: a null text is an empty blob; spans are half open and count code points; repeated rows each get the
findings of their blob; an empty table adds nothing to the ledger. A failed run leaves the ledger as it was or with whole rows, so it can be run again;
blobs that two writers have added are read once. Columns of any name pass through redact().
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, free_name, let, stored

#: kind -> pattern, group whose length counts, least length. Fixed values; the first three are the base kinds.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
}
BASE = ("assign", "access", "hex")
VERSION = "rules-1"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_LEDGER = f"blob string, spans {_SPANS}, version string"
#: Code points of a block of a text from which redacted texts are put together.
BLOCK = 8_192


def _running(values: Column, join) -> Column:
    """Running joins of an array, for a join that is associative: at each step the reach doubles, so that k values
    take k log k steps."""
    none = F.lit(0)
    step = lambda a, d: F.when(F.size(a) > d, F.transform(a, lambda v, i: join(v, F.coalesce(F.get(a, i - d), none)))).otherwise(a)
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(31))), values.cast("array<int>"), step)


def _spans_of(text: Column, kind: str) -> Column:
    pattern, group, least = RULES[kind]
    rank = list(RULES).index(kind)

    def located(matches: Column) -> Column:
        # What stands before the end of a match: the parts and matches so far.
        reach = lambda parts: _running(F.transform(matches, lambda m, i: F.length(F.get(parts, i)) + F.length(m)), lambda x, y: x + y)

        def placed(ends: Column) -> Column:
            values = F.regexp_extract_all(text, F.lit(pattern), group) if group else matches

            def kept(values: Column) -> Column:
                spans = F.transform(ends, lambda e, i: F.struct((e - F.length(F.get(matches, i))).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind")))
                return F.filter(spans, lambda _, i: F.length(F.get(values, i)) >= least)

            return let(values, kept)

        return F.when(F.size(matches) == 0, F.array().cast(_SPANS)).otherwise(let(let(F.split(text, pattern, -1), reach), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), located)


def find_spans(text: Column) -> Column:
    """All spans of all rules, by start and then by the order of the rules."""
    return F.sort_array(F.concat(*(_spans_of(text, kind) for kind in RULES)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _known(spark: SparkSession, ledger: str, version: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LEDGER).parquet(ledger).where(F.col("version") == version)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no ledger yet


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", version: str = VERSION) -> DataFrame:
    """Brings the ledger at that path up to date with docs; returns its rows of this version, each blob once: blob, spans."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("blob", blob_of(F.col("text")))
    readers = texts.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))  # of equal blobs, the row that is read
    known = _known(spark, ledger, version)
    if known is not None:
        readers = readers.join(known.select("blob"), "blob", "left_anti")
    same = texts["doc_id"].eqNullSafe(readers["doc_id"]) & (texts["blob"] == readers["blob"])
    unseen = texts.join(readers.hint("shuffle_hash"), same, "left_semi")
    found = unseen.select("blob", find_spans(F.col("text")).alias("spans")).dropDuplicates(["blob"])
    found.withColumn("version", F.lit(version)).write.mode("append").parquet(ledger)
    return stored(_known(spark, ledger, version).select("blob", "spans").dropDuplicates(["blob"]), "findings")


def report(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and spans of every row of docs. Equal texts that fill a third of the rows make the last join
    uneven, which adaptive execution splits: both of its sides are plain exchanges."""
    found = scan(docs, ledger or fresh_path(docs.sparkSession, "ledger"), id_col, text_col)
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(F.coalesce(F.col(text_col), F.lit(""))).alias("blob"))
    spans = F.coalesce(F.col("spans"), F.array().cast(_SPANS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return paths.join(found, "blob", "left").select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def report_in_two_scans(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """report() of all of docs with a ledger that has seen the rows up to the middle id before: the second scan reads only
    the blobs that the first has not."""
    ledger = ledger or fresh_path(docs.sparkSession, "ledger")
    middle = docs.select(F.percentile_approx(F.col(id_col), 0.5)).first()[0]
    scan(docs.where(F.col(id_col) <= F.lit(middle)), ledger, id_col, text_col)
    return report(docs, ledger, id_col, text_col)


def _cleaned(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in the place of each run of overlapping spans, put together from its blocks in one go."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first, last = (F.floor(x / BLOCK).cast("int") for x in (start, end - 1))
        inside = lambda j: F.substring(F.get(blocks, j), F.greatest(start - j * BLOCK, F.lit(0)) + 1, F.least(end, (j + 1) * BLOCK) - F.greatest(start, j * BLOCK))
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), inside), "")).otherwise("")

    def built(blocks: Column) -> Column:
        def joined(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            part = lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(blocks, before(i), s["start"]), F.lit(mark))).otherwise("")
            return F.concat(F.array_join(F.transform(spans, part), ""), piece(blocks, before(F.size(ends)), F.length(text)))

        return let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), joined)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0), built)


def redact(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mark (overlapping spans by one), all other columns untouched."""
    found = scan(docs, ledger or fresh_path(docs.sparkSession, "ledger"), id_col, text_col).where(F.size("spans") > 0)
    key, row_id, row_blob, row_spans = (free_name(docs, x) for x in ("key", "row_id", "row_blob", "row_spans"))
    blob = blob_of(F.coalesce(F.col(text_col), F.lit("")))
    paths = docs.select(F.col(id_col).alias(row_id), blob.alias(row_blob)).distinct()
    marked = stored(paths.join(found, paths[row_blob] == found["blob"]).select(row_id, row_blob, F.col("spans").alias(row_spans)), "marked")
    keyed = docs.withColumn(key, blob)
    out = keyed.join(marked.hint("shuffle_hash"), keyed[id_col].eqNullSafe(marked[row_id]) & (keyed[key] == marked[row_blob]), "left")
    text = F.when(F.col(row_spans).isNull(), keyed[text_col]).otherwise(_cleaned(keyed[text_col], F.col(row_spans), mark))
    return out.select(*(text.alias(c) if c == text_col else keyed[c] for c in docs.columns))
