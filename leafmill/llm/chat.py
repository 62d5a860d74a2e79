"""Chat formatting with typed content parts.

A visitor flattens the parts of a message (text, image, audio, document) into one ordered
body. A non-text part becomes a placeholder; its reference, its ordinal and the number of
tokens that it stands for are recorded beside the text. Control strings inside texts are
escaped reversibly, so no text can open or close a turn.

Defined cases: a null text or role is empty; a null turn sorts first; rows that tie on turn
are ordered by role, then body; repeated rows stay repeated; a null conversation id is a
conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: What a placeholder starts with; no control string does, whatever a part's kind is.
PART_MARK = "<|part:"

#: Every control string and placeholder starts with "<"; "[" opens the markers of other
#: templates. Neither character survives escaping, so a raw "<" is always a control string.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: One token stands for so many pixels on a side, parts of a second, or a fraction of a page.
PATCH_PIXELS, TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 768


def escape(text: Column) -> Column:
    """A text without control characters; unescape() gives the text back. Null is empty."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescape(text: Column) -> Column:
    """Inverse of escape()."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def text_part(text: Column) -> Column:
    """The parts of a message that is only text."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *nothing)).cast(f"array<{PART}>")


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; 0 for text."""
    patches = F.ceil(part.width / F.lit(PATCH_PIXELS)) * F.ceil(part.height / F.lit(PATCH_PIXELS))
    made = (
        F.when(part.kind == "image", patches)
        .when(part.kind == "audio", F.ceil(part.seconds * TOKENS_A_SECOND))
        .when(part.kind == "document", part.pages.cast("long") * TOKENS_A_PAGE)
    )
    return F.coalesce(made, F.lit(0)).cast("long")


def visit(part: Column) -> Column:
    """What one part becomes in the body. Unknown kinds keep a placeholder of their own."""
    kind = F.coalesce(part.kind, F.lit("text"))
    return F.when(kind == "text", escape(part.text)).otherwise(F.concat(F.lit(PART_MARK), escape(kind), F.lit("|>")))


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Messages (conv_id, turn, role, parts) to one row per conversation.

    Returns conv_id, formatted, loss_spans (array of start and end code points of the bodies
    of loss_role, end exclusive), attachments (array of start, ordinal, kind, ref, tokens in
    text order; start is the placeholder's first code point) and expanded_tokens (their sum).
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = messages.select("conv_id", "turn", "role", parts.alias("parts"))
    rows = rows.select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("parts", visit), "").alias("body"),
        F.filter(
            F.transform("parts", lambda p, i: F.struct(
                F.length(F.array_join(F.transform(F.slice(parts, 1, i), visit), "")).cast("long").alias("offset"),
                i.alias("ordinal"), p.kind.alias("kind"), p.ref.alias("ref"), part_tokens(p).alias("tokens"),
            )),
            lambda a: F.coalesce(a.kind, F.lit("text")) != "text",
        ).alias("attached"),
        F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("is_loss"),
    )
    rows = rows.withColumn("piece", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY), "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body_end = F.col("end") - len(END)
    rows = rows.select(
        "conv_id",
        F.struct("end", "piece").alias("piece"),
        F.when(F.col("is_loss"), F.struct((body_end - F.length("body")).alias("start"), body_end.alias("end"))).alias("loss"),
        F.transform("attached", lambda a: F.struct((body_end - F.length("body") + a.offset).alias("start"), a.ordinal.alias("ordinal"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens"))).alias("attached"),
        F.aggregate("attached", F.lit(0).cast("long"), lambda s, a: s + a.tokens).alias("tokens"),
    )
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"),
        F.sort_array(F.collect_list("loss")).alias("loss_spans"),
        F.sort_array(F.flatten(F.collect_list("attached"))).alias("attachments"),
        F.sum("tokens").alias("expanded_tokens"),
    )
    return grouped.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans", "attachments", "expanded_tokens")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 2147483646)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, BODY, 1)).alias("role"),
            unescape(F.replace(F.substring_index(t, BODY, -1), F.lit(END), F.lit(""))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, what is read back from the formatted text."""
    made = format_conversations(conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
