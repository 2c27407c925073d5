"""Quotation linking: messages that quote each other, as conversations in reply order without the quotes.

Lines that begin with `>` are quoted; the number of marks is the level, and neighbouring lines of a level form a passage.
Passages and the messages' own words are normalised (lower case, letters and digits only, single spaces) and hashed, as a
whole and by sentence, so that wrapped quotes still match; the lines of each sentence are further keys, so that single lines of
lists, code or verse match too. Each key is joined to the latest earlier message of its conversation that has it; the lines
of a quoted sentence count only if nobody said it whole. A key counts by its length, so that a quoted paragraph outweighs a
"yes", and a passage belongs to the message that its keys lead to with the most (the latest of equals).
A message answers the original of its outermost linked passage, or else the message before it. All of it is DataFrame
expressions.

Defined results: messages are put in order of turn (null first), role, text, so repeated rows stay apart; null texts are empty bodies; a row without
a conv_id is a conversation of its own; quotes of nothing known count as quotes but link to nothing; an empty table gives no
rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored

MARKS = r"^((?:[ \t]{0,3}>)+)"
#: Where sentences end: at marks before white space, or at marks of scripts that put no space after them.
ENDS = r"(?<=[.!?])\s+|(?<=[。！？｡．।॥])\s*"
ATTRIBUTION = r"(?i)^\s*(?:on|le|am|el)\b.{0,200}\b(?:wrote|écrit|schrieb|escribió)\s*:\s*$"


def lines_of(text: Column) -> Column:
    """Lines with their quote level and content."""
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    line = lambda x: F.struct(level(x).alias("level"), F.regexp_replace(F.regexp_replace(x, MARKS, ""), "\r$", "").alias("content"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def body_of(lines: Column) -> Column:
    """What the author wrote: lines without marks, without the line that announces a quote."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.btrim(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), F.lit(" \n\t\r"))


def keys_of(text: Column) -> Column:
    """nth, whole, key of a text (nth -1), of its sentences, and of the lines of those that have several."""
    plain = lambda s: F.btrim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))
    key = lambda n, whole, s: F.struct(n.alias("nth"), F.lit(whole).alias("whole"), plain(s).alias("key"))
    lines = lambda s, n: F.transform(F.split(s, r"\n"), lambda x: key(n, False, x))
    keys = lambda s, n: F.when(F.instr(s, "\n") > 0, F.concat(F.array(key(n, True, s)), lines(s, n))).otherwise(F.array(key(n, True, s)))
    sentences = F.flatten(F.transform(F.split(text, ENDS), keys))
    return F.filter(F.concat(F.array(key(F.lit(-1), True, text)), sentences), lambda k: k["key"] != "")


def messages_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, lines (of messages with quotes), conv, pos."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    parsed = let(lines_of(F.col("text")), lambda ls: F.struct(body_of(ls).alias("body"), F.when(F.exists(ls, lambda x: x["level"] > 0), ls).alias("lines")))
    rows = conversations.select("conv_id", "turn", "role", "text", conv.alias("conv")).withColumn("pos", pos)
    return rows.withColumn("parsed", parsed).select("conv_id", "turn", "role", "parsed.body", "parsed.lines", "conv", "pos")


def passages_of(messages: DataFrame) -> DataFrame:
    """conv, pos, passage (number within the message), level, text of every quoted passage."""
    lines = messages.where("lines IS NOT NULL").select("conv", "pos", F.posexplode("lines").alias("n", "line")).select("conv", "pos", "n", "line.level", "line.content")
    order = Window.partitionBy("conv", "pos").orderBy("n")
    turned = F.coalesce(F.lag("level").over(order) != F.col("level"), F.lit(True)).cast("int")
    runs = lines.withColumn("turned", turned).withColumn("passage", F.sum("turned").over(order)).where("level > 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n")
    return runs.groupBy("conv", "pos", "passage", "level").agg(joined.alias("text"))


def link(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """conv, pos, passage, level, original (pos of the quoted message, or null), matched (length of the matching keys)."""
    quoted = passages.select("conv", "pos", "passage", "level", F.inline(keys_of(F.col("text"))))
    quoted = quoted.select("conv", F.xxhash64("key").alias("hash"), "pos", "passage", "level", "nth", "whole", F.length("key").alias("size"))
    said = messages.join(passages.select("conv").distinct(), "conv", "left_semi").select("conv", "pos", F.explode(F.array_distinct(F.transform(keys_of(F.col("body")), lambda k: k["key"]))).alias("key"))
    said = said.select("conv", F.xxhash64("key").alias("hash"), "pos", *(F.lit(None).cast(t).alias(c) for c, t in (("passage", "long"), ("level", "int"), ("nth", "int"), ("whole", "boolean"), ("size", "int"))))
    # Per key in order of messages, quotes before the message's own words: the latest earlier message that has it.
    order = Window.partitionBy("conv", "hash").orderBy("pos", F.col("passage").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = quoted.unionByName(said).withColumn("original", F.last(F.when(F.col("passage").isNull(), F.col("pos")), ignorenulls=True).over(order))
    found = both.where("passage IS NOT NULL AND original IS NOT NULL")
    said_whole = F.max("whole").over(Window.partitionBy("conv", "pos", "passage", "nth"))
    found = found.withColumn("said_whole", said_whole).where("whole OR NOT said_whole").select("conv", "pos", "passage", "original", "hash", "size").distinct()
    votes = found.groupBy("conv", "pos", "passage", "original").agg(F.sum("size").alias("matched"))
    best = votes.groupBy("conv", "pos", "passage").agg(F.max(F.struct("matched", "original")).alias("best"))
    return passages.select("conv", "pos", "passage", "level").join(best, ["conv", "pos", "passage"], "left").select("conv", "pos", "passage", "level", F.col("best.original").alias("original"), F.col("best.matched").alias("matched"))


def depths(runs: DataFrame) -> DataFrame:
    """conv, run, base from runs(conv, run, up, add): base is add plus the bases of all runs above. Each round doubles the
    distance that is looked up."""
    runs = stored(runs.select("conv", "run", F.when(F.col("up") > 0, F.col("up")).alias("up"), "add"), "runs")
    while not runs.where("up IS NOT NULL").isEmpty():
        above = runs.select("conv", F.col("run").alias("up"), F.col("up").alias("up2"), F.col("add").alias("add2"))
        runs = stored(runs.join(above, ["conv", "up"], "left").select("conv", "run", F.col("up2").alias("up"), (F.col("add") + F.coalesce("add2", F.lit(0))).alias("add")), "runs")
    return runs.select("conv", "run", F.col("add").alias("base"))


def thread(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_order (from 1 within the conversation; everything after what it
    answers), depth, reply_to (turn of the answered message), n_quotes, n_linked, body."""
    messages = stored(messages_of(conversations), "messages")
    passages = stored(passages_of(messages), "passages")
    linked = stored(link(messages, passages), "links")
    per_message = linked.groupBy("conv", "pos").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"),
        F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("outer"), "matched", "original"))).alias("best"),
    )
    quoted = per_message.select("conv", "pos", "n_quotes", "n_linked", F.col("best.original").alias("original"))
    # A run goes on until a message answers another one than that before it.
    order = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.coalesce(F.col("original") != F.col("pos") - 1, F.lit(False)).cast("long")
    rows = messages.drop("lines").join(quoted, ["conv", "pos"], "left").withColumn("run", F.sum(head).over(order))
    rows = stored(rows.withColumn("first", F.max(F.when(head == 1, F.col("pos"))).over(order)).withColumn("offset", F.col("pos") - F.coalesce("first", F.lit(1))), "placed")
    at = rows.select("conv", F.col("pos").alias("original"), F.col("run").alias("up"), F.col("offset").alias("up_offset"))
    heads = rows.where((F.col("offset") == 0) & (F.col("run") > 0)).select("conv", "run", "original").join(at, ["conv", "original"])
    based = rows.join(depths(heads.select("conv", "run", "up", (F.col("up_offset") + 1).alias("add"))), ["conv", "run"], "left")
    based = based.withColumn("depth", F.coalesce("base", F.lit(0)) + F.col("offset"))
    # The turn answered: that of the linked message, or of the one before in the conversation.
    targets = rows.select("conv", F.col("pos").alias("original"), F.col("turn").alias("linked_turn")).join(heads.select("conv", "original").distinct(), ["conv", "original"], "left_semi")
    based = based.join(targets, ["conv", "original"], "left")
    before = F.lag("turn").over(Window.partitionBy("conv").orderBy("pos"))
    is_head = (F.col("offset") == 0) & (F.col("run") > 0)
    out = based.withColumn("reply_to", F.when(is_head, F.col("linked_turn")).otherwise(before))
    return out.select(
        "conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv").orderBy("depth", "pos")).cast("long").alias("reply_order"), "depth", "reply_to",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "body",
    )
