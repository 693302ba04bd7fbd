"""Chat formatting of typed content parts, in DataFrame functions only.

A message is an array of parts: ``struct<kind, text, ref, width, height, seconds, pages>``. A visitor flattens them in
order: a text part gives its escaped text, and an image, audio or document part gives a placeholder that carries its
kind and place, with an attachment record of its reference and the number of tokens it will expand to.

The template is ``<|turn|>role\\nbody<|end|>\\n``. Inside roles and bodies ``&``, ``<`` and ``[`` are written as character
references, so no text can hold a control string, neither of this template nor of others, and it can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
PATCH = 14  # pixels on a side of an image token
AUDIO_RATE = 25  # tokens of a second of audio
PAGE_TOKENS = 256  # tokens of a page of a document
KINDS = ("image", "audio", "document")
_REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, written in _REFERENCES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_REFERENCES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """An array with one text part; NULL text reads as empty."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("width"),
        F.lit(None).cast("bigint").alias("height"), F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("bigint").alias("pages"))).cast(f"array<{PART}>")


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment expands to; an unknown size counts as one token, and nothing expands to less than one."""
    cells = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    counted = (F.when(part["kind"] == "image", cells).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
               .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS))
    return F.greatest(F.coalesce(counted.cast("bigint"), F.lit(1)), F.lit(1)).cast("bigint")


def _known(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*KINDS), F.lit(False))


def flatten(parts: Column) -> Column:
    """The body of a message: texts and placeholders ``<|kind:place|>`` in the order of the parts.

    A NULL message, a NULL part and a part of an unknown kind without text give nothing; an unknown kind with text
    is read as text.
    """
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p, i: F.when(
        _known(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(
        escape(F.coalesce(p["text"], F.lit(""))))), "")


def attachments(parts: Column) -> Column:
    """Records (place, kind, ref, tokens) of the parts that are not text, in order."""
    placed = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p, i: F.struct(
        i.cast("bigint").alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        expanded_tokens(p).alias("tokens")))
    return F.filter(placed, _known)


def format_conversations(df: DataFrame, conversation: str, turn: str, role: str, parts: str) -> DataFrame:
    """One row for each conversation: (conversation, formatted, n_turns, loss_spans, attachments, attachment_tokens).

    Turns go by ``turn``, NULL first; ties go by role and body, and repeated rows are repeated turns. A NULL role is
    written as empty; NULL conversations form one of their own. ``loss_spans`` are the code points (start from 0,
    length) of the assistant bodies in ``formatted``. A conversation is one string, so it must be below Spark's limit
    of 2 GB for a value. Other columns are not read, and an empty table gives no rows.
    """
    written = F.replace(escape(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    rows = df.select(F.col(f"`{conversation}`").alias("__conversation"), F.col(f"`{turn}`").alias("__turn"),
                     written.alias("__role"), flatten(F.col(f"`{parts}`")).alias("__body"),
                     attachments(F.col(f"`{parts}`")).alias("__attachments"))
    rows = rows.withColumn("__head", F.length("__role") + F.lit(len(TURN) + 1)).withColumn("__size", F.length("__body"))
    order = Window.partitionBy("__conversation").orderBy("__turn", "__role", "__body")
    sums = F.sum(F.col("__head") + F.col("__size") + F.lit(len(END)))
    rows = rows.withColumn("__place", F.row_number().over(order)).withColumn(
        "__start", F.coalesce(sums.over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__head"))
    # The window and the gathering share one shuffle by conversation.
    gathered = rows.groupBy("__conversation").agg(F.sort_array(F.collect_list(F.struct(
        "__place", "__role", "__body", "__start", "__size", "__attachments"))).alias("__turns"))
    texts = F.transform("__turns", lambda t: F.concat(F.lit(TURN), t["__role"], F.lit("\n"), t["__body"], F.lit(END)))
    spans = F.transform(F.filter("__turns", lambda t: t["__role"] == "assistant"), lambda t: F.struct(
        t["__start"].alias("start"), t["__size"].cast("bigint").alias("length")))
    records = F.flatten(F.transform("__turns", lambda t: F.transform(t["__attachments"], lambda a: F.struct(
        (t["__place"] - 1).cast("bigint").alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"),
        a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return gathered.select(
        F.col("__conversation").alias(conversation), F.array_join(texts, "").alias("formatted"),
        F.size("__turns").cast("bigint").alias("n_turns"), spans.alias("loss_spans"), records.alias("attachments"),
        F.aggregate(records, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


_SHAPE = "(?s)^([^\n]*)\n(.*)<\\|end\\|>\n$"


def _blocks(formatted: Column) -> Column:
    return F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")


def _role(block: Column) -> Column:
    return unescape(F.replace(F.regexp_extract(block, _SHAPE, 1), F.lit("&#10;"), F.lit("\n")))


def read_back(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted conversation, unescaped; placeholders stay as written."""
    return F.transform(_blocks(formatted), lambda b: F.struct(
        _role(b).alias("role"), unescape(F.regexp_extract(b, _SHAPE, 2)).alias("text")))


def read_parts(formatted: Column) -> Column:
    """Turns ``array<struct<role, parts>>`` with typed parts ``struct<kind, place, text>``, in order.

    A placeholder is a part of its kind with its place and no text; what stands between placeholders is one text part
    without a place. A text that spells a placeholder was escaped, so it reads back as text.
    """
    head = r"^<\|([a-z]+):([0-9]+)\|>"

    def piece(p: Column) -> Column:
        text = unescape(F.regexp_replace(p, head, ""))
        mark = F.struct(F.regexp_extract(p, head, 1).alias("kind"), F.regexp_extract(p, head, 2).try_cast("bigint").alias("place"),
                        F.lit(None).cast("string").alias("text"))
        said = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("bigint").alias("place"), text.alias("text"))
        return F.filter(F.array(mark, said), lambda s: F.when(s["kind"] == "text", s["text"] != "").otherwise(s["kind"] != ""))

    return F.transform(_blocks(formatted), lambda b: F.struct(_role(b).alias("role"), F.flatten(F.transform(
        F.split(F.regexp_extract(b, _SHAPE, 2), r"(?=<\|)"), piece)).alias("parts")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask: the spans cut out of ``formatted``, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
