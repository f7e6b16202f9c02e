"""Line dedup by a log-template tree, in DataFrame functions only.

A line is a list of tokens. The tree has a fixed depth: the number of tokens, then the ``depth``
leading tokens; a token with a digit is a variable field and stands as ``<*>``. A leaf holds
templates: all tokens with their variable fields, and for long lines also every second
token, from the first or from the second on, which generalises whatever varies in between. A template needs
constant words: tokens that hold a letter and no digit. A line with fewer than ``words`` of them, such as a row of numbers,
is matched by its exact text only.
A template that ``documents`` or more documents share is recurring. Its lines stay in the
first document (the smallest id) that has one and are dropped everywhere else, so that no text is lost from the
corpus altogether; with ``keep_first=False`` they are dropped there too.

Lines of fewer than ``tokens`` tokens are never dropped, nor are lines for recurring within one document.
Null texts have no lines and stay null; empty texts have one empty line. Rows without an id are taken as one
document after all others; rows of one id are one document. Extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import land

VARIABLE = "<*>"
_LAST = 2**63 - 1


@dataclass(frozen=True)
class TemplateParams:
    documents: int = 2
    tokens: int = 5
    depth: int = 3
    constant: int = 8  # constant words that a template of every second token must have
    words: int = 3  # constant words that a template of all tokens must have
    keep_first: bool = True


def _tokens(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(r"([^\x20\x09-\x0D]+)"))
    general = F.transform(found, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))
    return F.when(line.rlike("[0-9]"), general).otherwise(found)


def _constant(tokens: Column) -> Column:
    """The number of constant words."""
    return F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}")))


def _keyed_lines(docs: DataFrame, params: TemplateParams) -> DataFrame:
    """``doc, version, at, leaf, template``: one row for each template a line belongs to."""
    lines = docs.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    tokens = lines.select("doc", "version", "at", "line", _tokens(F.col("line")).alias("t")).where(
        F.size("t") >= params.tokens
    )
    leaf = F.xxhash64(F.size("t"), F.slice("t", 1, params.depth))
    enough = F.size("t") >= 2 * params.constant
    first = F.filter("t", lambda _, i: i % 2 == 0)
    second = F.filter("t", lambda _, i: i % 2 == 1)
    templates = F.array(
        F.when(_constant(F.col("t")) >= params.words, F.xxhash64(F.lit("all"), F.col("t"))).otherwise(
            F.xxhash64(F.lit("exact"), F.col("line"))
        ),
        F.when(enough & (_constant(first) >= params.constant), F.xxhash64(F.lit("first"), first)),
        F.when(enough & (_constant(second) >= params.constant), F.xxhash64(F.lit("second"), second)),
    )
    return (
        tokens.select("doc", "version", "at", leaf.alias("leaf"), F.explode(templates).alias("template"))
        .where("template is not null")
    )


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )


def _dropped(docs: DataFrame, params: TemplateParams) -> DataFrame:
    """``doc, version, dropped``: positions of lines to drop, for documents that have any."""
    keyed = land(_keyed_lines(_identified(docs), params), "lines")
    recurring = land(
        keyed.select("leaf", "template", "doc")
        .distinct()
        .groupBy("leaf", "template")
        .agg(F.min("doc").alias("first_doc"), F.count("*").alias("documents"))
        .where(F.col("documents") >= params.documents)
        .select("leaf", "template", "first_doc"),
        "templates",
    )
    later = F.lit(not params.keep_first) | (F.col("doc") != F.col("first_doc"))
    return (
        keyed.join(recurring, ["leaf", "template"])
        .where(later)
        .groupBy("doc", "version")
        .agg(F.collect_set("at").alias("dropped"))
    )


def _joined(docs: DataFrame, params: TemplateParams) -> DataFrame:
    """``row, lines, dropped``: the row as it is, its lines, and positions to drop or null."""
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64("text").alias("version"),
    )
    return rows.join(_dropped(docs, params), ["doc", "version"], "left").select(
        "row", F.split("row.text", "\n").alias("lines"), "dropped"
    )


def _left() -> Column:
    """The text without its dropped lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    # a look-up by position, not a search: linear in the number of lines
    text = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    return F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(text)


def line_report(docs: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, text_sha256`` (of what is left)."""
    return _joined(docs.select("doc_id", "text"), params).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_left(), F.lit("")), 256).alias("text_sha256"),
    )


def drop_repeated_lines(docs: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """``docs`` without repeated lines. Documents of which nothing but blanks is left go; an
    ``n_chars`` column follows the text."""
    text = _left()
    columns = []
    for field in docs.schema:
        own = F.col("row").getField(field.name)
        if field.name == "text":
            own = F.col("left")
        elif field.name == "n_chars" and field.dataType.simpleString() in ("bigint", "int"):
            length = F.char_length("left").cast(field.dataType)
            own = F.when(F.col("dropped").isNotNull(), length).otherwise(own)
        columns.append(own.alias(field.name))
    emptied = F.col("dropped").isNotNull() & ~F.col("left").rlike(r"[^\x20\x09-\x0D]")
    return _joined(docs, params).withColumn("left", text).where(~emptied).select(*columns)
