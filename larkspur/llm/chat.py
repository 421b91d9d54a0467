"""Chat formatting as Spark expressions over collected turns.

Template: a block is ``<|im_start|>role\\n``, the texts of adjacent turns of that role with ``<|im_sep|>``
between them, then ``<|im_end|>\\n``. A control string inside a text gets a backslash bar, ``<\\|``, and a
text's own ``<\\``-runs grow by one backslash, which undoes uniquely; so control strings in the output come
from the template alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.spans import add, blocks_of, cut, let, running

#: The role whose texts are trained on.
TRAINED = "assistant"
START, SEP, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_break|>"


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|`` wherever only backslashes stand between them."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_mask)`` for every conversation: its turns by number, adjacent turns of a role merged.

    ``loss_mask`` has the spans (start, end; code points) of the assistant's texts in ``formatted``, one for each turn.

    Ties of a turn number go by role, then text; a null turn number sorts first; a null role or text
    is empty; rows whose conversation is null form one conversation; repeated rows are repeated turns; a very long
    text is one value, and a conversation one row, as its format asks; an empty table gives an empty result; other
    columns are not read. Merged turns keep a separator, so the output
    still tells them apart.
    """
    own = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("one"),
    )
    lists = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    # A turn opens a block where its role differs from the one before; a block's texts are the slice up to the next opening.
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    lists = lists.select("conv_id", "turns", at.alias("opens"))
    blocks = F.transform(
        "opens",
        lambda i, k: F.struct(
            F.element_at("turns", i)["role"].alias("role"),
            F.slice("turns", i, F.coalesce(F.get("opens", k + 1), F.size("turns") + 1) - i)["text"].alias("texts"),
        ),
    )
    # Roles are escaped too: like texts, they come from outside. Their line breaks become a control string.
    name = lambda r: F.replace(escape(r), F.lit("\n"), F.lit(BREAK))
    shown = F.transform(blocks, lambda b: F.concat(F.lit(START), name(b["role"]), F.lit("\n"), F.array_join(F.transform(b["texts"], escape), SEP), F.lit(END + "\n")))

    def spans(own: Column) -> Column:
        """Of each turn, where its text ends: after all before it, and what the template puts in front of each."""
        size = lambda t: F.length(escape(t["text"]))
        opening = lambda t: F.length(name(t["role"])) + (len(START) + 1)

        def take(t: Column, i: Column) -> Column:
            before = F.get(own, i - 1)["role"]
            front = F.when(i == 0, opening(t)).when(before == t["role"], F.lit(len(SEP))).otherwise(opening(t) + (len(END) + 1))
            return (front + size(t)).cast("bigint")

        ends = running(F.transform(own, take), add)
        placed = F.zip_with(own, ends, lambda t, end: F.struct((end - size(t)).alias("start"), end.alias("end"), t["role"].alias("role")))
        return F.transform(F.filter(placed, lambda s: s["role"] == TRAINED), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return lists.select("conv_id", F.array_join(shown, "").alias("formatted"), let(F.col("turns"), spans).alias("loss_mask"))


def parse_formatted(formatted: Column) -> Column:
    """Blocks (role, texts) read back from the formatted string alone."""
    cut = F.filter(F.split(formatted, r"\Q<|im_start|>\E", -1), lambda s: s != "")

    def block(s: Column) -> Column:
        body = F.substring(s, 1, F.length(s) - len(END) - 1)
        role = F.substring_index(body, "\n", 1)
        rest = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), F.transform(F.split(rest, r"\Q<|im_sep|>\E", -1), unescape).alias("texts"))

    return F.transform(cut, block)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return let(blocks_of(formatted), lambda blocks: F.array_join(F.transform(mask, lambda s: unescape(cut(blocks, s["start"], s["end"]))), ""))
