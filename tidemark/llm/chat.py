"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; neighbours with the same role become one block, and
the blocks are concatenated. Layout: ``<|im_start|>role\\ntext<|turn|>text<|im_end|>\\n``; ``<|turn|>`` parts the
turns that a block merges. Control strings can't occur in what stands between them: in roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles a newline becomes ``<\\n>``.

The loss mask comes as runs (loss, chars) that cover the output in turn: a mark, a text, a mark ... a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Fixed values of the layout.
START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
LEARN = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, blocks, formatted, loss_runs.

    Null roles and texts count as empty. Rows sort by turn (null first), then role, then text, so ties and
    repeated rows have one order; none is dropped. A null conversation id is a conversation. No rows: no rows.
    A conversation is one output row, so its turns meet in one task, gathered beforehand in each input task.
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    # Where a block starts: the first turn, and each whose role isn't the one before it.
    t = t.select(
        "conv_id",
        "t",
        F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"])).alias("s"),
        F.size("t").alias("n"),
    )
    ends = F.concat(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.col("n") + 1))
    blocks = F.zip_with("s", ends, lambda a, b: F.struct(F.element_at("t", a)["role"].alias("role"), F.transform(F.slice("t", a, b - a), lambda x: escape(x["text"])).alias("texts")))
    t = t.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit("<\\n>")), F.lit("\n"))
    run = lambda loss, chars: F.struct(loss.alias("loss"), chars.cast("long").alias("chars"))
    text_runs = lambda b, i: F.flatten(
        F.transform(
            b["texts"],
            lambda x, j: F.array(
                run(F.lit(False), F.when(j > 0, len(TURN)).otherwise(F.length(head(b)) + F.when(i > 0, len(END)).otherwise(0))), run(b["role"] == LEARN, F.length(x))
            ),
        )
    )
    return t.select(
        "conv_id",
        F.size("blocks").alias("n_blocks"),
        F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], TURN), F.lit(END))), "").alias("formatted"),
        F.concat(F.flatten(F.transform("blocks", text_runs)), F.array(run(F.lit(False), F.lit(len(END))))).alias("loss_runs"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back from format_chats(): conv_id, turns (role, text, loss), formatted. ``loss`` is what the mask says."""
    quote = lambda s: s.replace("|", r"\|")
    parts = F.split("formatted", quote(END), -1)
    df = formatted.select("conv_id", "formatted", "loss_runs", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("parts"))

    def turns(part: Column) -> Column:
        line = F.instr(part, "\n")
        role = unescape(F.replace(F.substring(part, F.lit(len(START) + 1), line - len(START) - 1), F.lit("<\\n>"), F.lit("\n")))
        return F.transform(F.split(F.substring(part, line + 1, F.length(part)), quote(TURN), -1), lambda x: F.struct(role.alias("role"), x.alias("text")))

    df = df.select("conv_id", "formatted", F.flatten(F.transform("parts", turns)).alias("texts"), F.filter("loss_runs", lambda _, i: i % 2 == 1).alias("runs"))
    same = lambda x, r: F.when(F.length(x["text"]) == r["chars"], r["loss"])  # noqa: E731  null if the mask doesn't fit
    both = F.zip_with("texts", "runs", lambda x, r: F.struct(x["role"].alias("role"), unescape(x["text"]).alias("text"), same(x, r).alias("loss")))
    return df.select("conv_id", "formatted", both.alias("turns"))


def chat_digest(read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
