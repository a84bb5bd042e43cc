"""Chat formatting (operator 9): turns collected, sorted, merged and concatenated by Spark expressions alone.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per block; adjacent turns of one role share a block, with
``<|im_sep|>`` between their texts, so every turn can be read back. Inside texts and roles a backslash goes before the
bar of every ``<|``, and one more where there are backslashes already: no control string is left, and taking one away
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as one block: an array of (role, texts) from an array of (role, text) in order."""
    block = "struct<role:string,texts:array<string>>"

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["role"].alias("role"), F.array_append(last["texts"], x["text"]).alias("texts"))
        fresh = F.struct(x["role"].alias("role"), F.array(x["text"]).alias("texts"))
        return F.when(last["role"] == x["role"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(fresh))).cast(f"array<{block}>")

    return F.aggregate(turns, F.array().cast(f"array<{block}>"), step)


def head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))


def spans_of(blocks: Column, learn_role: str) -> Column:
    """Where the texts of learn_role are in the formatted string of blocks (texts escaped): code points, then bytes."""
    place = "struct<start:bigint,end:bigint,first_byte:bigint,end_byte:bigint>"
    state = lambda at, byte, out: F.struct(at.cast("long").alias("at"), byte.cast("long").alias("byte"), out.cast(f"array<{place}>").alias("out"))

    def text(acc: Column, x: Column) -> Column:
        at, byte = acc["at"] + F.length(x), acc["byte"] + F.octet_length(x)
        span = F.struct(acc["at"].alias("start"), at.alias("end"), acc["byte"].alias("first_byte"), byte.alias("end_byte"))
        return state(at + len(SEP), byte + len(SEP), F.array_append(acc["out"], span))

    def step(acc: Column, b: Column) -> Column:
        texts, begin = F.array_join(b["texts"], SEP), head(b["role"])
        at, byte = acc["at"] + F.length(begin), acc["byte"] + F.octet_length(begin)
        found = F.when(b["role"] == learn_role, F.aggregate(b["texts"], state(at, byte, acc["out"]), text)["out"]).otherwise(acc["out"])
        return state(at + F.length(texts) + len(END) + 1, byte + F.octet_length(texts) + len(END) + 1, found)

    return F.aggregate(blocks, state(F.lit(0), F.lit(0), F.array()), step)["out"]


def format_conversations(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learn_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, formatted (the whole string) and loss, the mask as places in that string.

    Rows are ordered by turn, role and text, null turns first, so ties and repeated rows have a fixed place and none
    is dropped. Null texts and roles are empty strings; rows of a null id make one conversation of that id; an empty
    table gives no rows; a conversation of any length is one string. loss has a span (start, end in code points,
    first_byte, end_byte; ends exclusive) for each text of learn_role, without what the template puts between merged
    turns; further columns are not read.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    talks = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    escaped = F.transform("t", lambda x: F.struct(x["role"].alias("role"), escape(x["text"]).alias("text")))
    blocks = talks.select("id", merged(escaped).alias("blocks"))
    formatted = F.concat_ws("", F.transform("blocks", lambda b: F.concat(head(b["role"]), F.array_join(b["texts"], SEP), F.lit(END + "\n"))))
    return blocks.select(F.col("id").alias(id_col), formatted.alias("formatted"), spans_of(F.col("blocks"), learn_role).alias("loss"))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, read from the formatted string and unescaped, in order."""
    piece = lambda octets, s: F.substr(octets, (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int"))
    # An array of one element binds the bytes once for all spans.
    return F.get(F.transform(F.array(formatted.cast("binary")), lambda octets: F.transform(loss, lambda s: unescape(piece(octets, s).cast("string")))), F.lit(0))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape(F.replace(head, F.lit(NEWLINE), F.lit("\n")))
        body = F.substr(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    loss = F.concat_ws("", under_mask(F.col("formatted"), F.col("loss")))
    back = formatted.select(id_col, "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
