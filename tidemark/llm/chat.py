r"""Chat formatting with typed content parts.

A message is a role and parts: text, image, audio or document. A visitor, one expression for each type, turns parts into
ordered placeholders: text is escaped; an attachment becomes ``<|image:k|>`` (``audio``, ``document``), k its number in the
conversation, and is recorded with its reference, its message, its place among the parts and the number of tokens that it
expands to. The template is ``<|turn|>role<|says|>content<|end|>`` for each message.

Control strings all begin with ``<|``. In roles and texts ``<|`` is written ``<|!|>``, also where the ``<`` ends one text part and the
``|`` begins the next, so nothing a user writes can open a
control string, and reading back is exact: what follows ``<|!|>`` is literal. Texts of other templates (``[INST]``,
``</s>``) have no meaning in this one and stay as they are. ``read_parts`` tells placeholders from texts that only look like them.

The loss mask is a list of pieces that make up the formatted string, each under the mask or not.

All on DataFrame functions. Defined results: null role, text and parts are empty; parts of unknown and null types are text; rows of a conversation go
by turn (null first), then role, then parts; rows of a null conversation form one; repeated rows are repeated turns; an empty table gives no rows; other columns are left out;
strings that no formatter made are read as far as they go, without an error.
A conversation is one output string, so its rows meet in one task; each message is formatted before that, and they are sorted and joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of an image, of a second of audio and of a page of a document.
IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 576, 25, 400
PART = "struct<type:string,text:string,ref:string,size:double>"
TURN, SAYS, END, ESCAPE = "<|turn|>", "<|says|>", "<|end|>", "<|!|>"
ATTACHED = ("image", "audio", "document")
PLACEHOLDER = r"<\|(?:image|audio|document):[0-9]{1,18}\|>"


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit(ESCAPE))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPE), F.lit("<|"))


def text_part(text: Column) -> Column:
    """A text as the only part of its message."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("size")))


def expanded_tokens(part: Column) -> Column:
    size = F.greatest(F.coalesce(part["size"], F.lit(1.0)), F.lit(0.0))
    return F.when(part["type"] == "image", F.lit(IMAGE_TOKENS)).when(part["type"] == "audio", F.ceil(size * AUDIO_TOKENS)).when(part["type"] == "document", F.ceil(size) * PAGE_TOKENS).otherwise(0).cast("bigint")


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*ATTACHED), F.lit(False))


def _visit(parts: Column, before: Column) -> Column:
    """The content of a message; ``before``: attachments of earlier messages."""
    shown = F.filter(parts, lambda p: _attached(p) | (F.coalesce(p["text"], F.lit("")) != ""))

    def one(p: Column, j: Column) -> Column:
        last = F.get(shown, j - 1)
        split = F.coalesce(~_attached(last) & F.endswith(last["text"], F.lit("<")) & F.startswith(p["text"], F.lit("|")), F.lit(False))
        text = F.when(split, F.concat(F.lit(ESCAPE[1:]), escape(F.substr(p["text"], F.lit(2))))).otherwise(escape(p["text"]))
        number = before + F.size(F.filter(F.slice(shown, F.lit(1), j), _attached))
        return F.when(_attached(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), number.cast("string"), F.lit("|>"))).otherwise(text)

    return F.array_join(F.transform(shown, one), "")


def format_messages(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """``(conv, formatted, attachments, expanded_tokens)`` of each conversation."""
    parts = F.filter(F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = messages.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), parts.alias("parts")).alias("m"))
    order = Window.partitionBy("conv").orderBy("m")
    here = F.size(F.filter("m.parts", _attached)).cast("bigint")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "before": F.coalesce(F.sum(here).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))})
    text = F.concat(F.lit(TURN), escape(F.col("m.role")), F.lit(SAYS), _visit(F.col("m.parts"), F.col("before")), F.lit(END))
    found = F.filter(F.transform("m.parts", lambda p, j: F.struct(F.col("i").alias("message"), j.alias("place"), p.alias("part"))), lambda x: _attached(x["part"]))
    found = F.transform(found, lambda x, k: F.struct((F.col("before") + k).cast("int").alias("number"), x["message"].alias("message"), x["place"].alias("place"), x["part"]["type"].alias("type"), x["part"]["ref"].alias("ref"), expanded_tokens(x["part"]).alias("tokens")))
    talks = rows.select("conv", F.struct("i", text.alias("text"), found.alias("found")).alias("m")).groupBy("conv").agg(F.array_sort(F.collect_list("m")).alias("m"))
    talks = talks.select("conv", F.array_join(F.transform("m", lambda m: m["text"]), "").alias("formatted"), F.flatten(F.transform("m", lambda m: m["found"])).alias("attachments"))
    return talks.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def _turns(formatted: Column) -> Column:
    """(role, content) of each turn, both still escaped."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    pieces = F.transform(F.slice(parts, 2, F.size(parts)), lambda t: F.split(F.regexp_replace(t, r"<\|end\|>\z", ""), r"<\|says\|>", 2))
    return F.transform(pieces, lambda p: F.struct(p[0].alias("role"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("content")))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string, placeholders left in the text."""
    return F.transform(_turns(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["content"]).alias("text")))


def read_parts(formatted: Column) -> Column:
    """array<struct<role, parts array<struct<type, text, number>>>>: attachments have a number and no text. Texts one after another are one."""

    def part(piece: Column) -> Column:
        attached = F.rlike(piece, F.lit(rf"\A{PLACEHOLDER}\z"))
        number = F.when(attached, F.regexp_extract(piece, ":([0-9]+)", 1)).cast("bigint")
        return F.struct(F.when(attached, F.regexp_extract(piece, "[a-z]+", 0)).otherwise("text").alias("type"), F.when(~attached, unescape(piece)).alias("text"), number.alias("number"))

    def parts(content: Column) -> Column:
        pieces = F.split(content, rf"(?={PLACEHOLDER})|(?<={PLACEHOLDER})", -1)
        return F.transform(F.filter(pieces, lambda x: x != ""), part)

    return F.transform(_turns(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), parts(t["content"]).alias("parts")))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """array<struct<piece, loss>>: the formatted string in pieces, true for the contents of that role."""
    wanted = role.replace("<|", ESCAPE)
    return F.flatten(F.transform(_turns(formatted), lambda t: F.array(
        F.struct(F.concat(F.lit(TURN), t["role"], F.lit(SAYS)).alias("piece"), F.lit(False).alias("loss")),
        F.struct(t["content"].alias("piece"), (t["role"] == wanted).alias("loss")),
        F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")),
    )))


def loss_text(mask: Column) -> Column:
    """What the loss mask covers, as it was written, in order."""
    return F.array_join(F.transform(F.filter(mask, lambda x: x["loss"]), lambda x: unescape(x["piece"])), "")


def loss_spans(mask: Column) -> Column:
    """array<struct<start, stop>>: the code points of the formatted string under the loss mask."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        stop = (state["at"] + F.char_length(x["piece"])).cast("int")
        return F.struct(stop.alias("at"), F.when(x["loss"], F.array_append(state["spans"], F.struct(state["at"].alias("start"), stop.alias("stop")))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(mask, zero, add)["spans"]
