"""Chat formatting of typed content parts, as column expressions.

A turn's content is plain text or a list of typed parts. A visitor, one branch
for each kind, flattens the parts into text with ordered placeholders such as
``<|image:2|>`` (numbered over the turn), and records each attachment's
reference and the tokens that the model will spend on it. Turns are marked with
``<|im_start|>role`` and ``<|im_end|>``. Control strings inside texts and roles
are escaped reversibly: ``<|`` becomes ``<\\|``, and backslashes between ``<``
and ``|`` gain one more, so an escaped text never holds ``<|``.

Formatting is one projection for each turn; no conversation is gathered, and
the formatted conversation is the turns' segments in order. ``read_back``
parses such segments while they stream by, sorted within their partition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one attachment expands to: fixed, or by unit of its ``size``.
EXPANSION = {"image": 256, "audio": 25, "document": 1}
PART_TYPE = "array<struct<type:string,text:string,ref:string,size:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_text(text: str) -> str:
    return re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text)


def unescape_text(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", lambda m: "<" + m[1] + "|", text)


def one_line(role: Column) -> Column:
    """A role without line feeds, reversibly: backslashes are doubled, a line feed becomes a backslash and n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))).cast(PART_TYPE)


def visit(part: Column, index: Column) -> Column:
    """An attachment as its numbered placeholder; other kinds say so; null for texts."""
    kind = F.coalesce(part["type"], F.lit("text"))
    name = F.when(kind.isin(*EXPANSION), kind).when(kind != "text", "unknown")
    return F.concat(F.lit("<|"), name, F.lit(":"), index.cast("string"), F.lit("|>"))


def flatten(parts: Column) -> Column:
    """All parts as one text. Neighbouring texts are joined before they are escaped, as a control string may be split over them."""
    marked = F.transform(parts, lambda x, i: F.struct(visit(x, i).alias("mark"), F.coalesce(x["text"], F.lit("")).alias("text")))
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def step(state: Column, x: Column) -> Column:
        is_text = x["mark"].isNull()
        return F.struct(
            F.when(is_text, state["done"]).otherwise(F.concat(state["done"], escape(state["open"]), x["mark"])).alias("done"),
            F.when(is_text, F.concat(state["open"], x["text"])).otherwise("").alias("open"),
        )

    return F.aggregate(marked, empty, step, lambda state: F.concat(state["done"], escape(state["open"])))


def expanded(part: Column) -> Column:
    """Tokens of one attachment: an image 256, audio 25 a second, a document its own count; 0 for texts."""
    size = F.greatest(F.coalesce(part["size"], F.lit(1)), F.lit(0))
    return (
        F.when(part["type"] == "image", F.lit(EXPANSION["image"]).cast("long"))
        .when(part["type"] == "audio", size * EXPANSION["audio"])
        .when(part["type"] == "document", size * EXPANSION["document"])
        .otherwise(F.lit(0).cast("long"))
    )


def format_turns(turns: DataFrame, parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formats each turn: ``conv_id, turn, role`` and ``parts`` become ``formatted`` with its loss span.

    Returns ``conv_id, turn, role, formatted, loss_start, loss_end`` (code
    points within ``formatted``; equal if the turn isn't trained on),
    ``attachments`` (kind, ref, placeholder number) and ``attachment_tokens``.
    A null role counts as ``user``, null parts or texts as empty; a role may hold
    anything, line feeds too; repeated rows are formatted each; an empty table
    gives an empty one. Other columns are left out, so clashing names do no harm.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    content = F.coalesce(F.col(parts), F.array().cast(PART_TYPE))
    one = turns.select(
        "conv_id", "turn", role.alias("role"), content.alias("p"),
        flatten(content).alias("body"),
        F.concat(F.lit(START), escape(one_line(role)), F.lit("\n")).alias("head"),
    )
    start = F.length("head")
    return one.select(
        "conv_id", "turn", "role",
        F.concat("head", "body", F.lit(END)).alias("formatted"),
        start.cast("long").alias("loss_start"),
        F.when(F.col("role").isin(*trained), start + F.length("body")).otherwise(start).cast("long").alias("loss_end"),
        F.filter(
            F.transform("p", lambda x, i: F.struct(x["type"].alias("type"), x["ref"].alias("ref"), i.alias("index"))),
            lambda x: x["type"].isin(*EXPANSION),
        ).alias("attachments"),
        F.aggregate(F.transform("p", expanded), F.lit(0).cast("long"), lambda a, x: a + x).alias("attachment_tokens"),
    )


READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


class _Reader:
    """Parses one conversation's segments as they come and keeps digests only."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()

    def segment(self, formatted: str, start: int, end: int) -> None:
        self.chars += len(formatted)
        for m in _TURN.finditer(formatted):
            self.turns += 1
            self.all.update(f"{unescape_role(m[1])}\n{unescape_text(m[2])}\n".encode())
        if end > start:
            said = unescape_text(formatted[start:end])
            self.loss += len(said)
            self.trained.update(said.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = READ_BACK.replace(" bigint", "").replace(" string", "").split(", ")
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    reader, done = None, []
    for batch in batches:
        for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if reader is None or reader.conv != conv:
                done += [reader.row()] if reader else []
                reader = _Reader(conv)
            reader.segment(text, start, end)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done = []
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(reader.row(), types, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, parsed from its segments.

    A digest over a whole conversation is sequential, so a conversation's
    segments meet in one task, but sorted and one batch at a time: memory
    doesn't grow with the conversation. Turns with equal numbers keep a fixed
    order by role and content. A null conv_id is one conversation of its own.
    """
    return (
        formatted.select("conv_id", "formatted", "loss_start", "loss_end", "turn", "role")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
        .select("conv_id", "formatted", "loss_start", "loss_end")
        .mapInArrow(_read, READ_BACK)
    )
