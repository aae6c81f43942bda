"""Chat formatting with typed content parts.

A message's content is a list of parts (text, image, audio, document). A visitor, written as one SQL
expression per part type, flattens them in order: text is escaped and kept, any other part becomes a
placeholder, and its reference and the number of tokens it expands to are recorded.

Template: ``<|im_start|>role\\ncontent<|im_end|>\\n`` for each turn. In roles and texts ``& < [`` become
``&amp; &lt; &#91;`` (and a line end in a role ``&#10;``), so no text can hold a control string of this or
of another bracketed template; `unescape` turns them back.

Defined results: a null text, part list or reference is empty, a null role is the empty role; turns are
ordered by turn, then role, then text (ties and repeated rows stay, each once for each row); an unknown
part type becomes an ``unknown`` placeholder with no tokens; a null conv_id is a conversation of its own;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for."""

    image_patch: int = 14
    audio_tokens_per_second: int = 25
    tokens_per_page: int = 600


def escape(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A part list with one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"),
        none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"),
    ))


def visit(part: Column, x: Expansion) -> Column:
    """Struct of what a part becomes: its text in the output, type, reference and expanded tokens."""
    kind = F.coalesce(part["type"], F.lit("unknown"))
    known = F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise(F.lit("unknown"))
    up = lambda c, d: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(d))
    tokens = (
        F.when(known == "image", up(part["width"], x.image_patch) * up(part["height"], x.image_patch))
        .when(known == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * x.audio_tokens_per_second))
        .when(known == "document", F.coalesce(part["pages"], F.lit(0)) * x.tokens_per_page)
        .otherwise(F.lit(0)).cast("long")
    )
    shown = F.when(known == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), known, F.lit("|>")))
    return F.struct(shown.alias("shown"), known.alias("type"), F.coalesce(part["ref"], F.lit("")).alias("ref"), tokens.alias("tokens"))


def format_chats(turns: DataFrame, parts: Column, expansion: Expansion = Expansion(), loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans: for each turn under the loss, its place among the turns, the first character inside that
    turn's block, the first character in the whole (both from 0), and the length, in code points.
    attachments: place of the turn, type, reference and expanded tokens, in order.
    The offsets come from a running sum in the window that orders the turns, which spills; the conversation's
    string itself is the result, so one conversation is one row by definition.
    """
    block = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.transform(F.coalesce(parts, F.array().cast(PARTS)), lambda p: visit(p, expansion)).alias("parts"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    block = block.select("conv_id", "turn", "role", "parts", head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("parts"))
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = block.withColumns({"place": F.row_number().over(order) - 1, "before": before})
    placed = placed.select(
        "conv_id", "place", F.concat("head", "body", F.lit(END)).alias("block"),
        F.when(F.col("role") == loss_role, F.struct(F.col("place").alias("turn"), F.length("head").cast("long").alias("inside"), (F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"),
        F.transform(F.filter("parts", lambda p: p["type"] != "text"), lambda p: F.struct(F.col("place").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("held"),
    )
    got = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "block", "loss", "held"))).alias("t"))
    out = got.select(
        "conv_id", F.array_join(F.transform("t", lambda z: z["block"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda z: z["loss"]), lambda z: z.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda z: z["held"])).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, z: a + z["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with `turns`: role and text of every turn as read from the string alone, and `loss_text`:
    what the loss spans cover, unescaped. Linear in the string: it is cut at turn ends once."""
    blocks = F.split("formatted", F.lit("<\\|im_end\\|>\n"))
    cut = formatted.withColumn("blocks", F.slice(blocks, 1, F.size(blocks) - 1))
    role = lambda b: F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)
    text = lambda b: F.substr(b, F.lit(len(START) + 2) + F.length(role(b)))
    turns = F.transform("blocks", lambda b: F.struct(unescape_role(role(b)).alias("role"), unescape(text(b)).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at("blocks", s["turn"] + 1), (s["inside"] + 1).cast("int"), s["length"].cast("int"))))
    return cut.withColumns({"turns": turns, "loss_text": F.array_join(under, "")}).drop("blocks")


def chat_digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
