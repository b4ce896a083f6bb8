"""Chat formatting with typed content parts.

A message is a list of parts, each text, image, audio or document.  A visitor turns every part, in
order, into its piece of the formatted turn: text is escaped, any other part becomes a numbered
placeholder, with a record of the attachment it stands for and of the tokens it expands to.  The
template marks turns by control strings; an escape, undone when reading back, keeps a text from
spelling one.  All of this is column work on single rows, so a conversation of any length costs no
more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: What a text must not spell: this template's markers and those of common other ones, also when cut at the end of a part.
CONTROL = r"([<\[]\\*)(\||/?s>|/?INST\]|/?s?\z|/?(?:I(?:N(?:ST?)?)?)?\z)"
_ESCAPED = re.compile(r"([<\[]\\*)\\(\||/?s>|/?INST\]|/?s?\Z|/?(?:I(?:N(?:ST?)?)?)?\Z)")

#: One content part.  ``width``, ``height``: pixels of an image; ``seconds``: length of audio; ``pages``: of a document.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """``text`` with a backslash inside every control string; ``unescape`` takes exactly that one away."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "<" in text or "[" in text else text


class PartVisitor:
    """Rules for each type of part; subclass to change the placeholder or the token counts.

    ``visit`` gives (piece, tokens): the piece of the formatted turn, and the tokens that the
    placeholder expands to.  Text has none here, since a tokenizer counts it.  Missing measures
    count as one patch, second or page; an unknown type is an attachment of one token.
    """

    def __init__(self, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 256):
        self.patch, self.per_second, self.per_page = patch, tokens_per_second, tokens_per_page

    def text(self, part: Column) -> Column:
        return escape(part["text"])

    def placeholder(self, part: Column, number: Column) -> Column:
        return F.concat(F.lit("<|"), self.kind(part), F.lit(" "), number.cast("string"), F.lit("|>"))

    def kind(self, part: Column) -> Column:
        return F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("other")

    def image(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["width"], F.lit(1)) / self.patch) * F.ceil(F.coalesce(part["height"], F.lit(1)) / self.patch)

    def audio(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * self.per_second)

    def document(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(1)) * self.per_page

    def tokens(self, part: Column) -> Column:
        kind = part["type"]
        return (F.when(kind == "text", 0).when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part))
                .when(kind == "document", self.document(part)).otherwise(1).cast("long"))

    def visit(self, part: Column, number: Column) -> Column:
        piece = F.when(part["type"] == "text", self.text(part)).otherwise(self.placeholder(part, number))
        return F.struct(part["type"].alias("type"), part["uri"].alias("uri"), piece.alias("piece"), self.tokens(part).alias("tokens"))


def text_part(text: Column) -> Column:
    """The content of a plain text message: one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_turns(turns: DataFrame, parts: str = "parts", conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 loss_role: str = "assistant", visitor: PartVisitor | None = None) -> DataFrame:
    """One row per message: (conv, turn, role, formatted, text_spans, loss, attachments, expanded_tokens).

    ``formatted`` is the message under the template; the strings of a conversation, joined in the
    order of (turn, role, formatted), nulls first, are its formatted form.  ``text_spans`` are the
    [start, end) code points of its text parts, ``loss`` says whether they are under the loss mask
    (role = ``loss_role``), ``attachments`` lists (number, type, uri, position, tokens) of the other
    parts, numbered from 0 in each message, and ``expanded_tokens`` sums their tokens.

    Null parts are left out, a null list or text is empty, a null role is an empty one (and not
    under the mask); repeated turns all stay.  Columns beyond those named are not read.
    """
    visitor = visitor or PartVisitor()
    kept = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    slim = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), kept.alias("parts"))
    # the number of a part is how many attachments come before it
    numbered = F.aggregate("parts", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("numbers")), lambda acc, p: F.struct(
        (acc["n"] + F.when(p["type"] == "text", 0).otherwise(1)).alias("n"), F.concat(acc["numbers"], F.array(acc["n"])).alias("numbers")))
    slim = slim.withColumn("numbers", numbered["numbers"])
    pieces = F.transform("parts", lambda p, i: visitor.visit(p, F.element_at("numbers", i + 1)))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    seen = slim.withColumn("pieces", pieces).withColumn("head", head)
    ends = F.aggregate("pieces", F.struct(F.length("head").alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, p: F.struct(
        (acc["at"] + F.length(p["piece"])).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
    seen = seen.withColumn("starts", ends["starts"])
    placed = F.zip_with("pieces", "starts", lambda p, s: F.struct(p["type"].alias("type"), p["uri"].alias("uri"), p["tokens"].alias("tokens"),
                                                                 s.alias("start"), (s + F.length(p["piece"])).alias("end")))
    other = F.filter(placed, lambda p: ~p["type"].eqNullSafe("text"))
    return seen.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.coalesce("role", F.lit("")).alias(role),
        F.concat("head", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(END)).alias("formatted"),
        F.transform(F.filter(placed, lambda p: p["type"] == "text"), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("text_spans"),
        F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"),
        F.transform(other, lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["uri"].alias("uri"), p["start"].alias("position"),
                                                 p["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Per conversation: what its formatted turns say, as counts and digests.

    The turns of a conversation stream in order through one task (a digest is a sequence), which
    keeps the running digests alone: formatting, the costly part, has been done row by row before.
    Role and texts are read from the ``formatted`` string, not from the source columns.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, text, spans, loss, attachments, tokens in zip(*(batch[c] for c in batch.columns)):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = key, _Conversation()
                state.add(text, spans, loss, len(attachments), tokens)
            if done:
                yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, *state.row())], columns=names)

    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    kind = formatted.schema[conv].dataType.simpleString()
    # the key travels as text, so that a null or large integer key keeps its exact value
    slim = formatted.select(F.col(conv).cast("string").alias("key"), turn, role, "formatted", "text_spans", "loss", "attachments", "expanded_tokens")
    sorted_ = slim.repartition("key").sortWithinPartitions("key", F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), "formatted")
    out = sorted_.select("key", "formatted", "text_spans", "loss", "attachments", "expanded_tokens").mapInPandas(
        run, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, "
             "expanded_tokens long")
    return out.select(F.col("key").cast(kind).alias(conv), *names[1:])


class _Conversation:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.attachments = self.tokens = 0

    def add(self, formatted: str, spans, loss: bool, attachments: int, tokens: int) -> None:
        role, _, _ = formatted.removeprefix(TURN).partition(BODY)
        text = "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)
        self.turns.update(f"{unescape(role)}\n{text}\n".encode())
        if loss:
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.n, self.chars = self.n + 1, self.chars + len(formatted)
        self.attachments, self.tokens = self.attachments + attachments, self.tokens + int(tokens)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens
