"""Chat formatting of typed content parts, in DataFrame expressions only.

A message is a role and a list of parts: text, image, audio or document. The visitor turns each part into its place in
the formatted string: a text is escaped, an attachment becomes a placeholder, and its reference, order and expanded
token count are recorded beside it. Control strings in texts and roles are escaped reversibly: U+2060 goes in after
their first character, one more where some stand there already, so the string parses back to the same parts.
Neighbouring texts of a message become one text first, so no control string can form where two of them meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import let

PART = "struct<kind: string, text: string, uri: string, width: int, height: int, millis: long, pages: int>"
ATTACHED = ("image", "audio", "document")

JOINER = "\u2060"
#: What begins a control string of this template or of other common ones, after its first character.
_CONTROL = r"(\||/?s>|/?INST\]|/?SYS>>)"
_ESCAPE = rf"([<\[])({JOINER}*){_CONTROL}"
_UNESCAPE = rf"([<\[])({JOINER}*){JOINER}{_CONTROL}"


@dataclass(frozen=True)
class Template:
    """Turn marks, all of which begin with <| so that no escaped text contains one, and the size of attachments in tokens."""

    begin: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    patch: int = 14
    audio_millis: int = 80
    page_tokens: int = 256

    def placeholder(self, kind: str) -> str:
        return f"<|{kind}|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, f"$1$2{JOINER}$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def text_part(text: Column) -> Column:
    """A text as the only part of a message; null: an empty text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("millis"), F.lit(None).cast("int").alias("pages")).cast(PART))


def part_tokens(part: Column, t: Template) -> Column:
    """Tokens that a part's placeholder expands to; null for text, 0 where a size is missing."""
    up = lambda x, by: F.ceil(F.coalesce(x, F.lit(0)) / by).cast("long")
    return (F.when(part["kind"] == "image", up(part["width"], t.patch) * up(part["height"], t.patch))
            .when(part["kind"] == "audio", up(part["millis"], t.audio_millis))
            .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * t.page_tokens))


def visit(part: Column, t: Template) -> Column:
    """The string that stands for a part. Unknown and null kinds are read as text; null text is empty."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind in ATTACHED:
        out = F.when(part["kind"] == kind, F.lit(t.placeholder(kind))).otherwise(out)
    return out


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["kind"], F.lit("")).isin(*ATTACHED)


def joined(parts: Column) -> Column:
    """parts with each run of texts (and of unknown kinds, which are read as text) as one text."""

    def step(a: Column, p: Column) -> Column:
        last = F.element_at(a, -1)
        both = last.withField("text", F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(p["text"], F.lit(""))))
        return F.when((F.size(a) > 0) & _is_text(p) & F.coalesce(_is_text(F.get(a, F.size(a) - 1)), F.lit(False)), F.array_append(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), both)).otherwise(F.array_append(a, p))

    return F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(parts, F.array().cast(f"array<{PART}>"), step))


def _messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): the turns of a conversation in order of turn; ties by role, then by content, nulls first."""
    m = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), joined(F.coalesce("parts", F.array().cast(f"array<{PART}>"))).alias("parts"))
    return turns.select("conv_id", m.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))


def format_turns(turns: DataFrame, template: Template | None = None, loss_role: str = "assistant") -> DataFrame:
    """Format turns (conv_id, turn, role, parts) into one row a conversation.

    Returns conv_id, formatted, loss_spans (start and length in code points of the bodies of `loss_role`) and
    attachments (number, turn's place, kind, uri, start of the placeholder, expanded tokens). A null role is ''; null
    parts are none; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table gives
    an empty result. A conversation is one row by definition of its output, so its turns meet in one task.
    """
    t = template or Template()
    head = lambda m: F.concat(F.lit(t.begin), escape(m["role"]), F.lit(t.body))
    pieces = F.transform("messages", lambda m: F.struct(head(m).alias("head"), (m["role"] == loss_role).alias("loss"),
                         F.transform(m["parts"], lambda p: F.struct(visit(p, t).alias("text"), p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p, t).alias("tokens"))).alias("parts")))
    whole = _messages(turns).select("conv_id", pieces.alias("m"))
    whole = whole.select("conv_id", F.transform("m", lambda m: F.struct(
        m["head"].alias("head"), m["loss"].alias("loss"), m["parts"].alias("parts"), F.array_join(F.transform(m["parts"], lambda p: p["text"]), "").alias("body"))).alias("m"))
    # a fold over turns for where each body starts
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    step = lambda a, m: F.struct((a["at"] + F.length(m["head"]) + F.length(m["body"]) + len(t.end)).cast("long").alias("at"), F.array_append(a["starts"], (a["at"] + F.length(m["head"])).cast("long")).alias("starts"))
    whole = whole.withColumn("starts", F.aggregate("m", zero, step, lambda a: a["starts"]))
    spans = F.filter(F.transform("m", lambda m, i: F.struct(F.get("starts", i).alias("start"), F.length(m["body"]).cast("long").alias("length"), m["loss"].alias("loss"))), lambda s: s["loss"])

    def attached(m: Column, i: Column) -> Column:
        start0 = F.struct(F.get("starts", i).alias("at"), F.array().cast("array<struct<place: int, kind: string, uri: string, start: bigint, tokens: bigint>>").alias("got"))
        def step(a: Column, p: Column) -> Column:
            one = F.struct(i.alias("place"), p["kind"].alias("kind"), p["uri"].alias("uri"), a["at"].alias("start"), p["tokens"].alias("tokens"))
            return F.struct((a["at"] + F.length(p["text"])).cast("long").alias("at"), F.when(p["tokens"].isNotNull(), F.array_append(a["got"], one)).otherwise(a["got"]).alias("got"))
        return F.aggregate(m["parts"], start0, step, lambda a: a["got"])

    found = F.flatten(F.transform("m", attached))
    formatted = F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"], F.lit(t.end))), "")
    return whole.select("conv_id", formatted.alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
                        F.transform(found, lambda a, n: F.struct(n.alias("number"), a["place"].alias("place"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["start"].alias("start"), a["tokens"].alias("tokens"))).alias("attachments"))


def parse(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted string as array<struct<role, body>>, role unescaped, body with its placeholders and escapes; null: null, '': none."""
    t = template or Template()
    quote = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    turns = F.filter(F.split(formatted, quote(t.end) + f"(?={quote(t.begin)}|$)"), lambda x: x != "")
    return F.transform(turns, lambda x: let(F.split(x, quote(t.body), 2), lambda p: F.struct(
        unescape(F.substring(p[0], len(t.begin) + 1, 1 << 30)).alias("role"), p[1].alias("body"))))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest columns read back from format_turns()'s output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens.

    A null conv_id keeps its row; a conversation without turns cannot be there; an empty table gives an empty result.
    """
    back = formatted.select("conv_id", "formatted", "attachments", parse(F.col("formatted"), template).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), unescape(x["body"]), F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"),
                       F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))
