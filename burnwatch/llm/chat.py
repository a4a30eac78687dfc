"""Chat formatting with Spark expressions only.

A conversation becomes one string of marked turns:

    <|turn|>role\ntext<|next|>text<|end|>

Turns of one role that follow each other are merged into one marked turn, whose texts stay apart by `<|next|>`. Inside roles
and texts `&`, `<` and line ends of roles are written as entities, so no text can hold a mark, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks and entities of the template.
TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, formatted, loss_runs.

    `loss_runs` is the loss mask over the code points of `formatted`, as runs of (skip, take): so many are out, then so many in.
    Texts of the roles in `learn` are in; marks, also those between merged texts, are out.
    Rows are ordered by turn, then role and text, so ties and repeated rows have one result, and all of them are kept. Null texts
    and roles are empty; null turns come first; null conv_ids form one conversation. Other columns are ignored.
    A conversation is one string, so it is limited by what one string can hold.
    """
    row = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    # A row opens a marked turn unless the row before has its role; each row brings the text before its own text and after it.
    def piece(x: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(F.col("rows"), i - 1)["role"] != x["role"])
        closes = (i + 1 == F.size("rows")) | (F.get(F.col("rows"), i + 1)["role"] != x["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(TURN), escaped_role(x["role"]), F.lit("\n"))).otherwise(F.lit(NEXT)).alias("before"),
            escaped(x["text"]).alias("text"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("after"),
            x["role"].isin(*learn).alias("learn"),
        )

    pieces = chats.select("conv_id", F.transform("rows", piece).alias("pieces"))

    def length(*columns: Column) -> Column:
        return F.char_length(F.concat(*columns))

    def run(skip: Column, take: Column) -> Column:
        return F.struct(skip.alias("skip"), take.alias("take"))

    runs = F.flatten(
        F.transform(
            "pieces",
            lambda x: F.when(
                x["learn"],
                F.array(run(length(x["before"]), length(x["text"])), run(length(x["after"]), F.lit(0))),
            ).otherwise(F.array(run(length(x["before"], x["text"], x["after"]), F.lit(0)))),
        )
    )
    whole = F.array_join(F.transform("pieces", lambda x: F.concat(x["before"], x["text"], x["after"])), "")
    return pieces.select("conv_id", whole.alias("formatted"), runs.alias("loss_runs"))


def read_chats(formatted: Column) -> Column:
    """Array of (role, text) of every turn that went into a formatted string, merged ones apart again."""
    marked = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.replace(block, F.lit(TURN), F.lit("")), "\n", 1)
        body = F.substr(block, F.char_length(role) + F.lit(len(TURN) + 2))
        return F.transform(
            F.split(body, r"<\|next\|>"),
            lambda text: F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text")),
        )

    return F.flatten(F.transform(marked, turns))


def under_mask(formatted: Column, runs: Column) -> Column:
    """Array of the stretches of a formatted string that are in the mask, unescaped."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["skip"]
        text = unescaped(F.substr(formatted, at, x["take"]))
        return F.struct(
            (at + x["take"]).alias("at"),
            F.when(x["take"] > 0, F.array_append(acc["texts"], text)).otherwise(acc["texts"]).alias("texts"),
        )

    return F.aggregate(runs, start, step, lambda acc: acc["texts"])
