"""Chat formatting by relational operations and Spark expressions only.

A conversation's turns are collected as structs and sorted. Array functions then
merge adjacent turns of one role into blocks and concatenate them. The template is

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT...<|end|>\\n

Inside roles and texts a backslash becomes two, and `<|` becomes `<\\|`, so that
no control string can stand in a text and every turn can be read back. The loss
mask is the list of the assistant texts' spans in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Turns whose lengths are summed one by one; sums of such groups give each group its start.
GROUP = 128
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_col, formatted string, loss array<struct<start, length>>.

    Turns are ordered by turn, ties by role and text; rows that repeat stay. Null
    roles and texts are empty. Null turns come first, and rows without a
    conversation id are one conversation. Spans count code points, in order. A
    conversation is one string, as its format demands; conversations are dealt
    out by their id and no task holds more than those it is given.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    turns = rows.select(F.col(conv_col).alias("conv"), turn.alias("turn"))
    chats = turns.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    chats = chats.select("conv", _pieces(F.col("turns")).alias("pieces"))
    chats = chats.select("conv", "pieces", starts(F.transform("pieces", lambda x: F.length(x["piece"]))).alias("starts"))
    spans = F.zip_with("pieces", "starts", lambda x, s: F.struct(x["role"].alias("role"), (s + x["before"]).alias("start"), x["length"].alias("length")))
    masked = F.filter(spans, lambda x: x["role"].isin(*loss_roles))
    return chats.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(masked, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def _pieces(turns: Column) -> Column:
    """Sorted turns to pieces, the strings that make up the format: role, piece, characters before the text, and its own.

    A block begins where the role is not the one before; its turns are the slice
    up to the next beginning, joined as one block.
    """

    def block(known: Column, begins: Column, k: Column) -> Column:
        begin, stop = begins[k], F.coalesce(F.get(begins, k + 1), F.size(known) + 1)
        here = F.slice(known, begin, stop - begin)
        role = known[begin - 1]["role"]

        def piece(x: Column, i: Column) -> Column:
            head = F.when(i > 0, F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), escape(role), F.lit(TEXT)))
            tail = F.when(i == stop - begin - 1, F.lit(END)).otherwise(F.lit(""))
            body = escape(x["text"])
            return F.struct(role.alias("role"), F.concat(head, body, tail).alias("piece"), F.length(head).cast("long").alias("before"), F.length(body).cast("long").alias("length"))

        return F.transform(here, piece)

    def blocks(known: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(1), F.size(known)), lambda i: F.coalesce(F.get(known, i - 2)["role"] != known[i - 1]["role"], F.lit(True)))
        return let(fresh, lambda begins: F.flatten(F.transform(begins, lambda _, k: block(known, begins, k))))

    return let(turns, blocks)


def starts(lengths: Column) -> Column:
    """For each of an array's lengths the sum of all before it, summed in groups of GROUP."""
    none = lambda: F.array().cast("array<bigint>")

    def running(xs: Column) -> Column:
        first = F.struct(none().alias("out"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(xs, first, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["total"])).alias("out"), (acc["total"] + x).alias("total")), lambda acc: acc["out"])

    def grouped(xs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / GROUP).cast("int")), lambda g: F.slice(xs, g * GROUP + 1, F.lit(GROUP)))
        totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: acc + x))
        return let(running(totals), lambda bases: F.flatten(F.zip_with(groups, bases, lambda g, base: F.transform(running(g), lambda x: base + x))))

    return let(F.transform(lengths, lambda x: x.cast("long")), grouped)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string, one for each turn that went in."""

    def texts(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        role = unescape(F.substring(parts[0], len(TURN) + 1, 2**31 - 1))
        return F.transform(F.split(parts[1], r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|end\|>\n", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), texts))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, joined with nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et,
        coalesce(lag(role) OVER w = role, false) AS joins, coalesce(lead(role) OVER w = role, false) AS goes_on
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN joins THEN 8 ELSE 16 + length(er) END + length(et) + CASE WHEN goes_on THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
