"""Conversations in reply order without quotes, in DataFrame functions only.

A line that begins with ``>`` signs is quoted; their number is its level (``>>`` and ``> >`` are both two). Consecutive quoted
lines of one level are a passage. Passages, their paragraphs, and the messages' own words as a whole and by paragraphs are
normalised (letters and digits in lower case, single blanks) and hashed; a passage or paragraph is joined to
the message of the same conversation that has it as its own words, the latest before the quoting turn. A short one
is joined only if one message alone has these words. The shallowest linked passage names the
message that is answered, a whole passage before its paragraphs; without one it is the turn before.
Messages come out by thread: each after the one it answers, answers in the order of their turns.

Null and empty texts are messages without words. A passage whose words nobody wrote links to nothing.
Rows without a conversation or turn are left out; repeated rows of one turn are one message, the
smallest text and role first. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import land

_BLOCK = 1_024  # ranks worked through by one task at a time; one row for each block is brought together
_QUOTE = r"^[ \t]*((?:>[ \t]?)+)(.*)$"


@dataclass(frozen=True)
class QuoteParams:
    words: int = 3  # shorter passages link only to words that one message of the conversation alone has


def _lines(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, at, level, line``; level 0 is the message's own."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "line"))
    signs = F.regexp_extract("line", _QUOTE, 1)
    level = F.length(F.regexp_replace(signs, "[^>]", ""))
    words = F.when(level > 0, F.regexp_extract("line", _QUOTE, 2)).otherwise(F.col("line"))
    return lines.select("conv_id", "turn", "at", level.alias("level"), words.alias("line"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _passages(lines: DataFrame) -> DataFrame:
    """``conv_id, turn, level, piece, first, key, words``: passages and all own words of a message (piece 0), and
    their paragraphs (piece 1), which blank lines end.
    """
    run = Window.partitionBy("conv_id", "turn").orderBy("at")
    new = F.col("level") != F.lag("level", 1, -1).over(run)
    starts = new | (normalised(F.col("line")) == "")
    marked = lines.withColumn("new", new.cast("int")).withColumn("starts", starts.cast("int"))
    runs = (
        marked.withColumn("run", F.when(F.col("level") > 0, F.sum("new").over(run)).otherwise(0))
        .withColumn("paragraph", F.sum("starts").over(run))
        .groupBy("conv_id", "turn", "level", "run", "paragraph")
        .agg(F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
        .select(
            "conv_id", "turn", "level", "run", "first",
            normalised(F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("text"),
        )
        .where("text <> ''")
        .groupBy("conv_id", "turn", "level", "run")
        .agg(F.sort_array(F.collect_list(F.struct("first", "text"))).alias("pieces"))
    )
    whole = F.struct(
        F.lit(0).alias("piece"), F.col("pieces")[0]["first"].alias("first"),
        F.array_join(F.transform("pieces", lambda x: x["text"]), " ").alias("text"),
    )
    pieces = F.transform("pieces", lambda x: F.struct(F.lit(1).alias("piece"), x["first"].alias("first"), x["text"].alias("text")))
    every = F.when(F.size("pieces") > 1, F.concat(F.array(whole), pieces)).otherwise(F.array(whole))
    return runs.select("conv_id", "turn", "level", F.inline(every)).select(
        "conv_id", "turn", "level", "piece", "first", F.sha2("text", 256).alias("key"),
        F.size(F.split("text", " ")).alias("words"),
    )


def _messages(conversations: DataFrame) -> DataFrame:
    return (
        conversations.where("conv_id is not null and turn is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
        .agg(F.min(F.struct("text", "role")).alias("m"))
        .select("conv_id", "turn", F.col("m.role").alias("role"), F.col("m.text").alias("text"))
    )


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 on in the order of ``keys``; written.

    A sort deals the rows out by ranges, so no key is met by one task; only one count per range is brought together.
    """
    placed = land(rows.orderBy(*keys).withColumn("placed", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("placed", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("part"))
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = F.col("placed").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("part")).select(
        *rows.columns, (F.col("offset") + within).alias("rank")
    )


def last_marked(rows: DataFrame, mark: Column) -> DataFrame:
    """``rank, last``: for each row of ``rows(rank, ...)`` the greatest rank up to it that is marked.

    Worked out in blocks of ranks; the greatest of each block is carried to those after it.
    """
    blocks = rows.select("rank", F.floor(F.col("rank") / _BLOCK).alias("block"), F.when(mark, F.col("rank")).alias("marked"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.groupBy("block")
        .agg(F.max("marked").alias("top"))
        .select("block", F.max("top").over(earlier).alias("carried"))
    )
    inside = Window.partitionBy("block").orderBy("rank")
    return (
        blocks.withColumn("here", F.max("marked").over(inside))
        .join(carried, "block")
        .select("rank", F.coalesce("here", "carried").alias("last"))
    )


def _sources(messages: DataFrame, params: QuoteParams) -> DataFrame:
    """``conv_id, turn, linked, n_quotes``: the turn whose words are quoted, and passages quoted."""
    found = land(_passages(_lines(messages)), "passages")
    own = found.where("level = 0").groupBy("conv_id", "key", "turn").agg(F.max("words").alias("words"))
    short = F.col("words") < params.words
    alone = (
        own.where(short).groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min("turn").alias("turn"), F.max("words").alias("words"))
        .where("n = 1").drop("n")
    )
    own = own.where(~short).unionByName(alone).drop("words").withColumn("own", F.lit(True))
    quoted = found.where("level > 0").withColumn("own", F.lit(False))
    none = F.lit(None).cast("int")
    both = numbered(
        own.withColumn("level", none)
        .withColumn("piece", none)
        .withColumn("first", none)
        .unionByName(quoted.select("conv_id", "key", "turn", "own", "level", "piece", "first")),
        "conv_id", "key", "turn", "own", "level", "piece", "first",
    )  # within a turn quotes come before own words, so a message never answers itself
    wrote = both.where("own").select(
        F.col("rank").alias("last"), F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("turn").alias("source")
    )
    links = (
        both.where("not own")
        .join(last_marked(both, F.col("own")), "rank")
        .join(wrote, "last")
        .where((F.col("c") == F.col("conv_id")) & (F.col("k") == F.col("key")))
    )
    named = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "piece", "first", "source")).alias("best"))
    number = found.where("level > 0 and piece = 0").groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    return number.join(named, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("best.source").alias("linked"), "n_quotes"
    )


def _own_words(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: ~line.rlike(_QUOTE))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def linked_messages(conversations: DataFrame, params: QuoteParams = QuoteParams()) -> DataFrame:
    """One row per message: ``rank, conv_id, turn, role, reply_to, by_quote, n_quotes, text`` without quotes.

    ``rank`` is its place in the order of conversations and turns.
    """
    messages = numbered(_messages(conversations), "conv_id", "turn")
    before = messages.select((F.col("rank") + 1).alias("rank"), F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    sources = _sources(messages, params)
    previous = F.when(F.col("c") == F.col("conv_id"), F.col("t"))
    return (
        messages.join(before, "rank", "left")
        .join(sources, ["conv_id", "turn"], "left")
        .select(
            "rank",
            "conv_id",
            "turn",
            "role",
            F.coalesce("linked", previous).alias("reply_to"),
            F.col("linked").isNotNull().alias("by_quote"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            _own_words(F.col("text")).alias("text"),
            (previous.isNull() | (F.coalesce("linked", previous) != previous)).alias("starts"),
        )
    )


def reply_order(conversations: DataFrame, params: QuoteParams = QuoteParams()) -> DataFrame:
    """One row per message: ``conv_id, position, turn, role, reply_to, by_quote, n_quotes, branches, text``.

    Messages that answer the turn before form runs. A run that answers an earlier message is a branch,
    and comes after the run it left, later places first: that is the order of a walk through
    the thread. Branches of branches are found by doubling, in log rounds.
    """
    rows = land(linked_messages(conversations, params), "linked")
    head = land(last_marked(rows, F.col("starts")).withColumnRenamed("last", "head"), "heads")
    starts = rows.where("starts").select(F.col("rank").alias("head"), "conv_id", "turn", "reply_to")
    answered = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("rank").alias("parent"))
    from_run = head.select(F.col("rank").alias("parent"), F.col("head").alias("top"))
    step = F.array(F.struct((-F.col("reply_to")).alias("left_at"), F.col("turn").alias("turn")))
    paths = land(
        starts.join(answered, (F.col("conv_id") == F.col("c")) & (F.col("reply_to") == F.col("t")), "left")
        .join(from_run, "parent", "left")
        .select("head", "top", F.when(F.col("top").isNull(), F.slice(step, 1, 0)).otherwise(step).alias("path")),
        "paths",
    )
    while not paths.where("top is not null").isEmpty():
        above = paths.select(F.col("head").alias("at"), F.col("top").alias("next"), F.col("path").alias("upper"))
        paths = land(
            paths.join(above, paths["top"] == above["at"], "left").select(
                "head",
                F.col("next").alias("top"),
                F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat("upper", "path")).alias("path"),
            ),
            "paths",
        )
    ordered = numbered(
        rows.drop("starts").withColumnRenamed("rank", "given").join(head.withColumnRenamed("rank", "given"), "given").join(paths, "head"),
        "conv_id", "path", "turn",
    )
    first = land(ordered.groupBy("conv_id").agg(F.min("rank").alias("start")), "first")
    return ordered.join(first, "conv_id").select(
        "conv_id",
        (F.col("rank") - F.col("start") + 1).alias("position"),
        "turn",
        "role",
        "reply_to",
        "by_quote",
        "n_quotes",
        F.size("path").cast("long").alias("branches"),
        "text",
    )
