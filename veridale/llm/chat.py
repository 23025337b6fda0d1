"""Chat formatting of turns with typed content parts.

A visitor turns each part of a turn into text: text parts are escaped, image, audio and document
parts become placeholders in their order, with the reference and the number of tokens that the
placeholder stands for in `attachments`. This is done turn by turn, before turns are brought together.
A conversation is one value of the result, so its turns meet in one row; nothing else is gathered.

Template: `<|turn|>` role `<|text|>` text `<|end|>` for each turn. In roles and texts a backslash is
doubled and every `|` becomes `\\|`. A mark needs a bar right after `<`, so none occurs in them, nor across the seam of two
parts, and dropping the backslash before each escaped character gives them back. `loss` has the spans (code points, end exclusive) of the
assistant's texts in the formatted string.

Defined results: null texts and roles are empty; null, empty or unknown parts give no text (unknown
types: the placeholder `<|attachment|>` of 0 tokens); turns are ordered by turn (null first), then
role, then content; repeated turns are kept; null conv_ids form one conversation; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PIECE = "struct<piece:string,kind:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


class PartVisitor:
    """One method for each type of part: (placeholder or text, expanded tokens)."""

    types = ("text", "image", "audio", "document")

    def __init__(self, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 256) -> None:
        self.patch, self.tokens_per_second, self.tokens_per_page = patch, tokens_per_second, tokens_per_page

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(part["text"]), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / self.patch)
        return F.lit("<|image|>"), side("width") * side("height")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_per_second)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), F.coalesce(part["pages"], F.lit(0)) * self.tokens_per_page

    def visit(self, part: Column) -> Column:
        """PIECE of a part; kind is null for text."""
        out = F.lit("<|attachment|>"), F.lit(0)
        for name in self.types:
            piece, tokens = getattr(self, name)(part)
            out = tuple(F.when(part["type"] == name, a.cast(t)).otherwise(b.cast(t)) for a, b, t in zip((piece, tokens), out, ("string", "bigint")))
        kind = F.when(part["type"] != "text", part["type"])
        return F.when(part["type"].isNotNull(), F.struct(out[0].alias("piece"), kind.alias("kind"), part["ref"].alias("ref"), out[1].alias("tokens"))).cast(PIECE)


def text_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts: each text as one text part."""
    part = F.struct(*[(F.lit("text") if f == "type" else F.col("text") if f == "text" else F.lit(None)).alias(f) for f in ("type", "text", "ref", "width", "height", "seconds", "pages")])
    return turns.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def formatted(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """conv_id, formatted, loss array<struct<start,end>>, attachments array<struct<kind,ref,tokens>>, expanded_tokens, for turns (conv_id, turn, role, parts)."""
    pieces = F.filter(F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), (visitor or PartVisitor()).visit), lambda p: p.isNotNull())
    each = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), pieces.alias("pieces"))
    each = each.select(
        "conv_id", "turn", "role", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"), F.array_join("pieces.piece", "").alias("body"),
        F.transform(F.filter("pieces", lambda p: p["kind"].isNotNull()), lambda p: p.dropFields("piece")).alias("attached"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.char_length("head") + F.char_length("body") + len(END)
    each = each.withColumn("k", F.row_number().over(order)).withColumn("at", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.char_length("head"))
    span = F.when(F.col("role") == ASSISTANT, F.struct(F.col("at").alias("start"), (F.col("at") + F.char_length("body")).alias("end")))
    turn = F.struct("k", F.concat("head", "body", F.lit(END)).alias("text"), span.alias("span"), "attached")
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    attachments = F.flatten("t.attached")
    return whole.select(
        "conv_id", F.array_join("t.text", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def unescaped(text: str) -> str:
    return "\\".join(p.replace("\\|", "|") for p in text.split("\\\\"))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from a formatted string; placeholders stay in the text."""
    out = []
    for turn in text.split(TURN)[1:]:
        role, body = turn.removesuffix(END).split(TEXT, 1)
        out.append((unescaped(role), unescaped(body)))
    return out


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        rows = []
        for conv, text, starts, ends, attached, expanded in zip(*(batch[c] for c in ("conv_id", "formatted", "starts", "ends", "attached", "expanded_tokens"))):
            turns = turns_of(text)
            under = "".join(unescaped(text[a:b]) for a, b in zip(starts, ends))
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((conv, len(turns), digest, len(under), hashlib.sha256(under.encode()).hexdigest(), len(text), attached, expanded))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ_BACK.split(", ")])


def read_back(made: DataFrame) -> DataFrame:
    """READ_BACK of what formatted() returned: turns from its marks, the assistant's texts from its spans."""
    spans = F.col("loss.start").alias("starts"), F.col("loss.end").alias("ends")
    return made.select("conv_id", "formatted", *spans, F.size("attachments").cast("long").alias("attached"), "expanded_tokens").mapInPandas(_read, READ_BACK)
