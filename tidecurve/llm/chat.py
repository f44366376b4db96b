"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a row (conversation, turn, role, parts); parts are ``array<struct<kind,text,ref,units>>`` with kind
text, image, audio or document. A visitor (one fold over the parts) flattens them in order: text is escaped,
an attachment becomes a numbered placeholder, and its reference and expanded token count are recorded.

The output of a conversation:

* ``formatted``: ``<|turn|>role\\n`` body ``<|end|>\\n`` for each turn;
* ``loss_spans``: code-point ranges [start, stop) of the assistants' bodies;
* ``attachments``: array<struct<turn_no,number,kind,ref,tokens>> in order of their placeholders.

Control strings (ours and those of common templates) inside a text get a backslash after their first
character, one more if some are there already; reading back takes one away, so every text comes back as it was.
Adjacent text parts are kept apart by a mark of their own, so no control string arises across parts.

Defined cases: a null text, role or parts array is empty; a null or unknown kind counts as document; a turn
without parts is an empty turn; turns are ordered by turn (nulls first), ties by role, then body; repeated
rows are repeated turns; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that chat templates read as control, less their first character, by that character.
CONTROL = {"<": r"\||/?s>|/?<SYS>>|</SYS>>|/?start_of_turn>|/?end_of_turn>", r"\[": r"/?INST\]"}
#: Tokens for each unit of an attachment: image tiles, audio seconds, document pages.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 512.0}
TURN, END, PART = "<|turn|>", "<|end|>", "<|part|>"


def escape(text: Column) -> Column:
    for first, rest in CONTROL.items():
        text = F.regexp_replace(text, rf"({first})(\\*)(?={rest})", r"$1\\$2")
    return text


def unescape(text: Column) -> Column:
    for first, rest in CONTROL.items():
        text = F.regexp_replace(text, rf"({first})\\(\\*)(?={rest})", r"$1$2")
    return text


def text_part(text: Column) -> Column:
    """A parts array of one text."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("double").alias("units")))


def flattened(parts: Column, tokens_per_unit: dict[str, float] = TOKENS_PER_UNIT) -> Column:
    """The visitor: struct(body, attachments) of a parts array; placeholders are numbered within the turn."""
    kinds = list(tokens_per_unit)
    start = F.struct(
        F.lit("").alias("body"), F.lit(False).alias("after_text"),
        F.expr("cast(array() as array<struct<number:int,kind:string,ref:string,tokens:bigint>>)").alias("attachments"),
    )

    def visit(acc: Column, part: Column) -> Column:
        kind = F.when(part["kind"].isin("text", *kinds), part["kind"]).otherwise("document")
        is_text, number = kind == "text", F.size(acc["attachments"])
        cost = F.lit(0.0)
        for k, x in tokens_per_unit.items():
            cost = F.when(kind == k, x).otherwise(cost)
        shown = F.when(is_text, F.concat(F.when(acc["after_text"], PART).otherwise(""), escape(F.coalesce(part["text"], F.lit("")))))
        shown = shown.otherwise(F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>")))
        tokens = F.ceil(F.coalesce(part["units"], F.lit(1.0)) * cost).cast("long")
        seen = F.struct(number.alias("number"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))
        grown = F.when(is_text, acc["attachments"]).otherwise(F.array_append(acc["attachments"], seen))
        return F.struct(F.concat(acc["body"], shown).alias("body"), is_text.alias("after_text"), grown.alias("attachments"))

    return F.aggregate(F.coalesce(parts, F.expr("array()").cast("array<struct<kind:string,text:string,ref:string,units:double>>")), start, visit)


def format_chat(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row for each conversation: formatted, loss_spans, attachments, n_turns, attachment_tokens."""
    flat = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flattened(F.col(parts)).alias("flat"))
    row = F.struct("turn", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"))
    chats = flat.groupBy("conv").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), F.url_encode(t["role"]), F.lit("\n"))
    shown = lambda t: F.concat(head(t), t["body"], F.lit(f"{END}\n"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def masked(acc: Column, t: Column) -> Column:
        low = acc["at"] + F.length(head(t))
        span = F.struct(low.alias("start"), (low + F.length(t["body"])).alias("stop"))
        spans = F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(shown(t))).alias("at"), spans.alias("spans"))

    numbered = F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn_no"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    out = chats.select(
        F.col("conv").alias(conversation), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", shown), "").alias("formatted"),
        F.aggregate("turns", start, masked)["spans"].alias("loss_spans"), F.flatten(numbered).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation; the texts have their placeholders still."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def one(piece: Column) -> Column:
        head = F.instr(piece, "\n")
        body = F.substring(piece, head + 1, F.length(piece) - head - len(END) - 1)
        return F.struct(F.url_decode(F.substring(piece, F.lit(1), head - 1)).alias("role"), read_text(body).alias("text"))

    return F.transform(pieces, one)


def read_text(body: Column) -> Column:
    """The text of a formatted body, unescaped; each part by itself."""
    return F.array_join(F.transform(F.split(body, r"<\|part\|>"), unescape), "")


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: read_text(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
