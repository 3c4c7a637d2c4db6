"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an ordered array of parts (:data:`PART`).  A visitor (one
expression per type in :data:`VISITORS`) flattens them into one string: text
parts are escaped, every other part leaves a numbered placeholder and an
attachment record with its reference and the tokens it expands to.  Turns of a
conversation are joined in blocks of consecutive turn numbers, so a
conversation that holds a third of all rows is spread over many groups; a
block carries its formatted text, its loss mask as spans of code points and
its attachments with their places.

Escapes: a backslash becomes ``\\s``; the ``<`` of a control string ``\\l``;
in a role ``>`` becomes ``\\g``.  Each backslash of the output therefore opens
an escape, and no control string is left inside a text, so two plain
replacements give the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "<turn ", "</turn>\n"
LOSS_ROLE = "assistant"
#: Types with placeholders; whatever else a part says, it is read as text.
ATTACHMENT_TYPES = ("image", "audio", "document")
CONTROL = f"<(/?turn|{'|'.join(ATTACHMENT_TYPES)})"
PART = ("array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>")
#: Turn numbers of one block: bounds what a group gathers.
BLOCK_TURNS = 256
#: Expansion of attachments, by the usual rules of vision and speech encoders.
PATCH, FRAME_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\s")), CONTROL, r"\\l$1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _size(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def _patches(value: Column) -> Column:
    return F.ceil(_size(value) / PATCH)


def image_tokens(part: Column) -> Column:
    return (_patches(part["width"]) * _patches(part["height"])).cast("long")


def audio_tokens(part: Column) -> Column:
    seconds = F.coalesce(F.nanvl(part["seconds"], F.lit(0.0)), F.lit(0.0))
    return F.ceil(F.greatest(seconds, F.lit(0.0)) * FRAME_TOKENS_PER_SECOND).cast("long")


def document_tokens(part: Column) -> Column:
    return (_size(part["pages"]) * TOKENS_PER_PAGE).cast("long")


#: type -> tokens that its placeholder expands to
VISITORS = dict(zip(ATTACHMENT_TYPES, (image_tokens, audio_tokens, document_tokens)))


def visit(part: Column, position: Column) -> Column:
    """One part flattened: ``out`` (escaped text or placeholder), ``kind``
    (null for text), ``ref`` and ``tokens`` of an attachment."""
    kind = F.when(part["type"].isin(*ATTACHMENT_TYPES), part["type"])
    placeholder = F.concat(F.lit("<"), kind, F.lit(" "), position.cast("string"), F.lit(">"))
    tokens = F.lit(None).cast("long")
    for name, count in VISITORS.items():
        tokens = F.when(kind == name, count(part)).otherwise(tokens)
    return F.struct(F.when(kind.isNull(), escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder).alias("out"),
                    kind.alias("kind"), F.when(kind.isNotNull(), part["ref"]).alias("ref"), tokens.alias("tokens"),
                    position.alias("part"))


def text_parts(text: Column) -> Column:
    """A plain text as a content of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[F.lit(None).cast(t).alias(n) for n, t in none.items()])).cast(PART)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """Conversations as marked-up text with a loss mask and attachments.

    ``rows`` has a row per turn; its content is ``parts_col`` (cast to
    :data:`PART`) or, where that is null or not given, the text alone.  Per
    conversation and block of :data:`BLOCK_TURNS` turn numbers (in order, their
    texts joined are the conversation's): ``block``, ``formatted``,
    ``loss_spans`` (start, end in code points of ``formatted``: the text parts
    of assistant turns), ``attachments`` (turn, part, type, ref, tokens, start),
    ``n_turns`` and ``attachment_tokens``.

    Null texts and roles read as empty; a null turn number comes first, in a
    block of its own; null conversation ids make one conversation of their own.
    Rows with the same turn number all stay, ordered by role, then text;
    exactly repeated rows are turns of their own.  An empty table gives no
    rows; extra columns are ignored whatever their names; a text is formatted
    whole, whatever its length."""
    parts = text_parts(F.col(text_col))
    if parts_col is not None:
        parts = F.coalesce(F.col(parts_col).cast(PART), parts)
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    flat = turns.select("conv", "turn", "role", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
                        F.transform("parts", visit).alias("flat"))
    tag = F.concat(F.lit(TURN_OPEN), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">"))
    body = F.array_join(F.transform("flat", lambda p: p["out"]), "")
    marked = flat.select("conv", "turn", "role", "block", "flat", tag.alias("tag"),
                         F.concat(tag, body, F.lit(TURN_CLOSE)).alias("out"))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "out")
    before = F.coalesce(F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # where each part starts: at most a few parts a turn, so their prefix sums are cheap
    placed = marked.select(
        "conv", "block", "turn", "role", "out", "flat", F.row_number().over(order).alias("nth"),
        (before + F.length("tag")).cast("long").alias("first"),
        F.transform("flat", lambda p: F.length(p["out"])).alias("sizes"))
    placed = placed.withColumn("flat", F.transform("flat", lambda p, i: F.struct(
        (F.col("first") + F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("start"),
        F.element_at("sizes", i + 1).alias("size"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        p["tokens"].alias("tokens"), p["part"].alias("part"))))
    spans = F.transform(F.filter("flat", lambda p: p["kind"].isNull() & (F.col("role") == LOSS_ROLE)),
                        lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end")))
    found = F.transform(F.filter("flat", lambda p: p["kind"].isNotNull()),
                        lambda p: F.struct(F.col("turn").alias("turn"), p["part"].alias("part"), p["kind"].alias("type"),
                                           p["ref"].alias("ref"), p["tokens"].alias("tokens"), p["start"].alias("start")))
    blocks = placed.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("nth", "out", spans.alias("spans"), found.alias("found")))).alias("t"))
    return blocks.select(
        F.col("conv").alias(conv_col), "block", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["spans"])).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["found"])).alias("attachments"),
        F.size("t").cast("long").alias("n_turns"),
        F.aggregate(F.flatten(F.transform("t", lambda x: x["found"])), F.lit(0).cast("long"),
                    lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_back(blocks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted text itself says: per block ``turns``, an array of
    (role, body) with placeholders left in the bodies, and ``loss``, the
    unescaped text under the loss mask."""
    pieces = F.split(F.col("formatted"), TURN_CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # the text ends with a close mark
    role = lambda x: F.regexp_extract(x, f"^{TURN_OPEN}([^>]*)>", 1)
    turns = F.transform(pieces, lambda x: F.struct(
        unescape(F.replace(role(x), F.lit("\\g"), F.lit(">"))).alias("role"),
        unescape(F.substring(x, F.length(role(x)) + len(TURN_OPEN) + 2, F.length(x))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return blocks.select(F.col(conv_col), "block", turns.alias("turns"), loss.alias("loss"),
                         F.length("formatted").cast("long").alias("formatted_chars"))


def digests(blocks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the formatted blocks.  A digest
    needs its whole input in one place, so a conversation's recovered blocks
    (not its turns) meet at the end."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read_back(blocks, conv_col).select(conv_col, F.struct(
        "block", lines.alias("lines"), "loss", F.size("turns").cast("long").alias("n"),
        F.col("formatted_chars").alias("chars")).alias("b"))
    whole = each.groupBy(conv_col).agg(F.array_sort(F.collect_list("b")).alias("b"))
    total = lambda name: F.aggregate(F.transform("b", lambda x: x[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    joined = lambda name: F.array_join(F.transform("b", lambda x: x[name]), "")
    return whole.select(conv_col, total("n").alias("n_turns"), F.sha2(joined("lines"), 256).alias("turns_sha256"),
                        F.length(joined("loss")).cast("long").alias("loss_chars"),
                        F.sha2(joined("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))


#: The conversation that the contract adds: control strings in both turns.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def with_extra(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
                                  F.lit(EXTRA_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
