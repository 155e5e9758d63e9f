"""Chat formatting with typed content parts, with DataFrame functions only.

A turn is ``<|role|>`` body ``<|end|>``. Inside roles and texts ``&``, ``<`` and ``[`` are
written as character references, so that no control string of this template or of another
one can come from data, and reading back undoes it exactly. Image, audio and document parts become
placeholders ``<|image:N|>`` in part order; N is the number of tokens that the attachment
expands to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
END = "<|end|>"
#: Tokens of one unit of an attachment: an image tile, a second of audio, a document page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    for raw, ref in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("&vert;"))


def unescape(text: Column) -> Column:
    for raw, ref in reversed(ESCAPES):
        text = F.replace(text, F.lit(ref), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part; null text is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def part_tokens(p: Column) -> Column:
    """Tokens that a part expands to: words of a text, units times the type's rate of an attachment."""
    out = F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    for kind, n in UNIT_TOKENS.items():
        out = F.when(p["type"] == kind, F.coalesce(p["units"], F.lit(1)) * n).otherwise(out)
    return out


def render_part(p: Column) -> Column:
    """A part as it stands in the body. Unknown or null types count as text."""
    is_attachment = F.coalesce(p["type"].isin(*UNIT_TOKENS), F.lit(False))
    return F.when(is_attachment, F.concat(F.lit("<|"), p["type"], F.lit(":"), part_tokens(p).cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def format_turns(turns: DataFrame) -> DataFrame:
    """Format conversations given as rows (conv_id, turn, role, parts of type ``PARTS``).

    Returns a row per conversation: conv_id, formatted, loss_spans (array of start and length
    in code points, of the assistants' bodies), attachments (array of turn, part, type, ref,
    tokens in order), n_tokens. Turns are ordered by turn, role and body; repeated rows stay
    repeated. Null conv_id is a conversation of its own, null role an empty role, null parts
    an empty body. Other columns are ignored. No rows give no rows.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    places = F.filter(F.transform(parts, lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))), lambda a: F.coalesce(a["type"].isin(*UNIT_TOKENS), F.lit(False)))
    rows = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit("<|"), escape_role(role), F.lit("|>")).alias("head"),
        F.array_join(F.transform(parts, render_part), "").alias("body"),
        places.alias("places"),
        F.aggregate(F.transform(parts, part_tokens), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("tokens"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    length = F.char_length("head") + F.char_length("body") + len(END)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length + F.char_length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("bigint").alias("start"), F.char_length("body").cast("bigint").alias("length")))
    item = F.struct("at", F.concat("head", "body", F.lit(END)).alias("text"), span.alias("span"), "places")
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"), F.sum("tokens").alias("n_tokens"))
    return got.select(
        "conv_id",
        F.array_join(F.col("t.text"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("t.places")).alias("attachments"),
        "n_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of struct (role, body); texts are unescaped, placeholders stay."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")
    return F.transform(pieces, lambda t: F.struct(unescape(F.replace(F.regexp_extract(t, r"^<\|([^<|]*)\|>", 1), F.lit("&vert;"), F.lit("|"))).alias("role"), unescape(F.regexp_replace(t, r"^<\|[^<|]*\|>", "")).alias("body")))


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
