"""Chat formatting: typed content parts to one marked-up text, and back.

A turn holds parts of kind text, image, audio or document. `format_conversations`
visits the parts in order: text is escaped, any other part leaves a placeholder and an
entry among the attachments with its reference and the tokens it expands to.

    <turn assistant>\\n text </turn>\\n

Roles are URL-encoded. In texts a backslash is doubled and one is set behind the `<`
of anything that looks like a mark, so that no text can end a turn and `unescaped`
restores it exactly. The loss mask is a list of spans (code points) that cover the
texts of assistant turns and nothing of their marks.

Everything is a built-in function: one exchange by conversation, one window to number
turns and sum up lengths, one aggregate. A conversation is one row of the result, so it
must fit into one; rows without conv_id are conversations of their own. Turns are taken
by turn, role, content; null text and null role are empty; repeated rows are repeated
turns; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens that a part expands to: a patch of an image, a second of sound, a page.
PATCH = 28
TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 512

KINDS = ("image", "audio", "document")
_MARKS = "(?=turn |/turn>|" + "|".join(f"{k} " for k in KINDS) + ")"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<" + _MARKS, r"<\\")


def unescaped(text: Column) -> Column:
    plain = F.regexp_replace(text, r"<\\" + _MARKS, "<")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"),
        none.cast("string").alias("ref"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("double").alias("seconds"),
        none.cast("int").alias("pages"),
    ))


def expanded_tokens(part: Column) -> Column:
    """Tokens in place of a part; 0 for text and where a size is missing."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * TOKENS_PER_SECOND))
        .when(part["kind"] == "document", part["pages"] * TOKENS_PER_PAGE),
        F.lit(0),
    ).cast("long")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*KINDS), F.lit(False))


def visit(part: Column, turn: Column, position: Column) -> Column:
    """The text a part leaves; anything but an attachment is text."""
    mark = F.concat(F.lit("<"), part["kind"], F.lit(" "), turn.cast("string"), F.lit("."),
                    (position + 1).cast("string"), F.lit(">"))
    return F.when(_is_attachment(part), mark).otherwise(
        escaped(F.coalesce(part["text"], F.lit("")))
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """`turns`: conv_id, turn, role, parts (array of PART). One row for each conversation:
    formatted, loss_spans, attachments, attachment_tokens."""
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        "conv_id", own.alias("own"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "parts")
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("head", F.concat(F.lit("<turn "), F.url_encode("role"), F.lit(">\n"))).withColumn(
        "body", F.array_join(F.transform("parts", lambda p, i: visit(p, F.col("n"), i)), "")
    ).withColumn(
        "chars", (F.length("head") + F.length("body") + F.lit(len("</turn>\n"))).cast("long")
    ).withColumn(
        "start", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    )
    span = F.when(F.col("role") == "assistant", F.struct(
        (F.col("start") + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
    ))
    held = F.filter(
        F.transform("parts", lambda p, i: F.struct(
            F.col("n").alias("turn"), (i + 1).alias("part"), p["kind"].alias("kind"),
            p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"),
        )), lambda a: F.coalesce(a["kind"].isin(*KINDS), F.lit(False)),
    )
    got = rows.select(
        "conv_id", "own", F.struct("n", F.concat("head", "body", F.lit("</turn>\n")).alias("text"),
                                   span.alias("span"), held.alias("held")).alias("t"),
    ).groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: t["held"]))
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(
        F.url_decode(F.substr(t, F.lit(7), F.locate(">", t) - 7)).alias("role"),
        unescaped(F.substr(t, F.locate(">", t) + 2)).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )), "")
