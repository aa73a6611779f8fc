"""Chat formatting of typed content parts, with column expressions only.

A turn's content is a list of parts: text, image, audio or document. A visitor
turns each into its place in the formatted text: texts with their control
strings escaped, the others as placeholders whose references and expanded token
counts are recorded in order. Turns are marked

    <|im_start|>role\\ncontent<|im_end|>\\n

Escaping: any ``<`` + backslashes + ``|`` in a text gets one backslash more, so
no text holds a control string, and taking one backslash away gives the text
back. A role that isn't a plain word is written as ``=`` and its UTF-8 bytes in
hexadecimal. The loss mask covers the content of assistant turns, placeholders
that the assistant gives included. A conversation is one row of the result, so
it must fit into one (2 GB); its turns are brought together by one shuffle.

Defined cases: null texts and roles are empty; a turn without parts has empty
content; a part of unknown kind is treated as text; turns are in the order of
(turn, role, parts), nulls first; repeated rows are repeated turns; rows with
a null conv_id are one conversation; an empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_OPEN, TURN_END = "<|im_start|>", "<|im_end|>\n"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_name(role: Column) -> Column:
    return F.when(role.rlike(r"^[A-Za-z0-9_.-]*\z"), role).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def role_of(name: Column) -> Column:
    return F.when(name.startswith("="), F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8")).otherwise(name)


class Visitor:
    """What each kind of part becomes: its text in the output, and the tokens that it expands to (0 for texts)."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 1000) -> None:
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def image_tokens(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["width"], F.lit(0)) / self.patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / self.patch)

    def audio_tokens(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate)

    def document_tokens(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(0)) * self.page_tokens

    def text(self, part: Column) -> Column:
        kind = part["kind"]
        place = F.when(kind == "image", F.lit("<|image|>")).when(kind == "audio", F.lit("<|audio|>")).when(kind == "document", F.lit("<|document|>"))
        return F.coalesce(place, escape(F.coalesce(part["text"], F.lit(""))))

    def tokens(self, part: Column) -> Column:
        kind = part["kind"]
        return F.coalesce(F.when(kind == "image", self.image_tokens(part)).when(kind == "audio", self.audio_tokens(part)).when(kind == "document", self.document_tokens(part)), F.lit(0)).cast("long")


def format_chats(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """Of ``turns`` (conv_id, turn, role, parts: array of PART), one row a conversation.

    conv_id, formatted string, loss array<struct<turn int, start long, end long>> (code point
    offsets of the assistant contents in formatted), attachments array<struct<turn int, kind, ref,
    tokens long>> in order, attachment_tokens long.
    """
    see = visitor or Visitor()
    rows = turns.select(
        F.col("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.array_join(F.transform("parts", see.text), "").alias("content"),
        F.transform(
            F.filter("parts", lambda p: p["kind"].isin("image", "audio", "document")),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), see.tokens(p).alias("tokens")),
        ).alias("files"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "files"))).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN_OPEN), role_name(t["role"]), F.lit("\n"))
    pieces = whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(TURN_END))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(head(t)).cast("long").alias("head"), F.length(t["content"]).cast("long").alias("size"))).alias("sizes"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))).alias("attachments"),
    )
    loss = "array<struct<turn:int,start:long,end:long>>"
    tail = len(TURN_END)
    fold = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("turn"), F.lit(0).cast("long").alias("at"), F.array().cast(loss).alias("loss")),
        lambda a, s: F.struct(
            (a["turn"] + 1).alias("turn"),
            (a["at"] + s["head"] + s["size"] + tail).alias("at"),
            F.when(s["role"] == "assistant", F.concat(a["loss"], F.array(F.struct(a["turn"].alias("turn"), (a["at"] + s["head"]).alias("start"), (a["at"] + s["head"] + s["size"]).alias("end"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return pieces.select("conv_id", "formatted", fold.alias("loss"), "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of struct<role, content>, content still escaped), loss: read back from formatted texts."""
    cut = F.split("formatted", r"<\|im_end\|>\n", -1)
    bodies = formatted.select("conv_id", "formatted", "loss", F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda x: F.substr(x, F.lit(len(TURN_OPEN) + 1))).alias("bodies"))
    name = lambda b: F.substring_index(b, "\n", 1)
    turn = lambda b: F.struct(role_of(name(b)).alias("role"), F.substr(b, F.length(name(b)) + 2).alias("content"))
    return bodies.select("conv_id", "formatted", "loss", F.transform("bodies", turn).alias("turns"))


def text_parts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as turns of one text part each."""
    null = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def digests(read: DataFrame) -> DataFrame:
    plain = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n")))
    # what lies between a mask's offsets in the formatted text, and nothing else, is under the loss
    cut = lambda x: F.substr("formatted", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    under = F.array_join(F.transform("loss", lambda x: unescape(cut(x))), "")
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(F.array_join(plain, ""), "UTF-8"), 256).alias("turns_sha256"), under.alias("under"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("under").cast("long").alias("loss_chars"), F.sha2(F.encode("under", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns_of(table(spark, sf_dir, "conversations"), {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(CONTROL).alias("text"))
    return digests(read_chats(format_chats(text_parts(rows.union(more)))))


OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN_OPEN) + 1 + len(TURN_END)} + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
