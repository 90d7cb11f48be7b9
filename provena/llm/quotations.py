"""Quotation linking: find which message a quoted passage came from and order messages by reply.

A line's quote level is the number of > signs at its start. Consecutive lines of one level, cut at blank lines,
are a passage; its key is the hash of its lower-cased text with white space runs made one space. Passages of level
one or more are looked up among the passages of level zero. Only built-in functions are used; nothing is grouped by
message or by conversation except to keep one smallest row, so that a hot key costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import materialize

PREFIX = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)^[^>]*\bwrote:[ \t]*$"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 1), "[^>]", ""))


def with_passages(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `passages`, array<struct<level int, body string>> in order, blank ones left out.

    Three projections, so that each array is made once for a row and then only indexed.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(level_of(x).alias("level"), F.trim(F.regexp_replace(x, PREFIX, "")).alias("body")))
    df = df.withColumn("_lines", lines)
    here, above = (lambda i: F.get(F.col("_lines"), i)), (lambda i: F.get(F.col("_lines"), i - 1))
    opens = lambda i: (i == 0) | (here(i)["level"] != above(i)["level"]) | (here(i)["body"] == "") | (above(i)["body"] == "")
    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), opens))
    end = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_lines"))
    run = lambda s, k: F.array_join(F.transform(F.slice("_lines", s + 1, end(k) - s), lambda x: x["body"]), " ")
    made = F.transform("_starts", lambda s, k: F.struct(here(s)["level"].alias("level"), run(s, k).alias("body")))
    return df.withColumn("_made", made).withColumn("passages", F.filter("_made", lambda x: x["body"] != "")).drop("_lines", "_starts", "_made")


def passage_key(body: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(F.lower(body), r"[ \t\r\x0b\x0c]+", " ")).cast("binary"))


def with_body(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `body`: the lines of level zero without attribution lines above a quotation; null stays null."""
    df = df.withColumn("_rows", F.when(F.instr(text, ">") > 0, F.split(text, "\n")))
    after = lambda i: F.coalesce(F.get(F.col("_rows"), i + 1), F.lit(""))
    kept = F.filter("_rows", lambda x, i: (level_of(x) == 0) & ~(x.rlike(ATTRIBUTION) & (level_of(after(i)) > 0)))
    return df.withColumn("body", F.coalesce(F.regexp_replace(F.array_join(kept, "\n"), r"^[ \n]+|[ \n]+$", ""), F.col(text))).drop("_rows")


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, n_quotes, quote_depth, n_linked, parent_conv, parent_turn, root_turn, reply_depth, body.

    A quoted passage is linked to the earliest message of its own conversation that holds it outside quotes, if
    that is an earlier turn; else to the first message by (conv_id, turn) anywhere that holds it, if in another
    conversation. The parent is the linked message of the shallowest, then latest link. root_turn follows parents
    within the conversation to the first message of the exchange, reply_depth counts the steps; ordering by
    (conv_id, root_turn, turn) gives conversations in reply order, as write_conversations does. Null texts have no
    passages and a null body, empty ones an empty body; rows with null keys link to nothing; repeated rows yield one
    row each; texts are whole, other columns are ignored, and no messages give no rows.
    """
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    quoting = base.filter(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quotes = with_passages(quoting).select("conv_id", "turn", F.explode(F.filter("passages", lambda x: x["level"] > 0)).alias("p"))
    quotes = materialize(quotes.select("conv_id", "turn", F.col("p.level").alias("level"), passage_key(F.col("p.body")).alias("key")).distinct(), "quotes")
    if quotes.isEmpty():  # no links to follow
        none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        return with_body(base).select(
            "conv_id", "turn", zero.alias("n_quotes"), F.lit(0).alias("quote_depth"), zero.alias("n_linked"), none.alias("parent_conv"), none.alias("parent_turn"),
            F.col("turn").alias("root_turn"), zero.alias("reply_depth"), "body",
        )
    plain = F.filter("passages", lambda x: x["level"] == 0)
    held = with_passages(base).select("conv_id", "turn", F.explode(plain).alias("p")).select("conv_id", "turn", passage_key(F.col("p.body")).alias("key"))
    within = held.groupBy("key", "conv_id").agg(F.min("turn").alias("own_turn"))
    within = materialize(within.join(materialize(quotes.select("key").distinct(), "quote-keys"), "key", "left_semi"), "quote-sources")
    first = materialize(within.groupBy("key").agg(F.min(F.struct("conv_id", "own_turn")).alias("at")), "quote-first")
    found = quotes.join(within, ["key", "conv_id"], "left").join(first, "key", "left")
    inside, outside = F.col("own_turn") < F.col("turn"), F.col("at.conv_id") != F.col("conv_id")
    found = found.select(
        "conv_id", "turn", "level",
        F.when(inside, F.col("conv_id")).when(outside, F.col("at.conv_id")).alias("to_conv"),
        F.when(inside, F.col("own_turn")).when(outside, F.col("at.own_turn")).alias("to_turn"),
    )
    best = F.min(F.when(F.col("to_conv").isNotNull(), F.struct(F.col("to_conv") != F.col("conv_id"), "level", (-F.col("to_turn")).alias("back"), "to_conv", "to_turn")))
    per = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.max("level").alias("quote_depth"), F.count("to_conv").alias("n_linked"), best.alias("best"))
    per = materialize(per.select("conv_id", "turn", "n_quotes", "quote_depth", "n_linked", F.col("best.to_conv").alias("parent_conv"), F.col("best.to_turn").alias("parent_turn")), "quote-parents")
    steps = per.filter("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("reply_depth"))
    up = materialize(steps, "quote-roots")
    while True:  # each round doubles the distance followed
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("reply_depth").alias("more"))
        joined = materialize(up.join(above, ["conv_id", "root_turn"], "left"), "quote-roots")
        further = F.col("reply_depth") + F.coalesce("more", F.lit(0))
        up = joined.select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), further.alias("reply_depth"))
        if joined.filter("higher is not null").isEmpty():
            break
    per = materialize(per.join(up, ["conv_id", "turn"], "left"), "quote-links")
    out = with_body(base).join(per, ["conv_id", "turn"], "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select(
        "conv_id", "turn", zero("n_quotes", "long"), zero("quote_depth", "int"), zero("n_linked", "long"), F.col("parent_conv").cast("long").alias("parent_conv"),
        F.col("parent_turn").cast("long").alias("parent_turn"), F.coalesce("root_turn", "turn").alias("root_turn"), zero("reply_depth", "long"), "body",
    )


def write_conversations(linked: DataFrame, path: str) -> None:
    """Write linked messages without their quotations as conversations in reply order: a thread's rows follow each other.

    Files hold ranges of (conv_id, root_turn, turn), so that no task gathers a conversation; a message comes after the
    one that it replies to. An existing target fails.
    """
    order = ["conv_id", "root_turn", "turn"]
    linked.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
