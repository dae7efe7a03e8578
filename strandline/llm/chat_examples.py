"""Operator 7: chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply alone trainable
(loss_start and loss_length count code points in the formatted text; the mask covers the escaped reply, without the
marks). A conversation that does not end with an assistant turn has one more example, with no trainable span, that
holds it whole; so the output keeps every turn.

Template: `<s>[INST] role [/INST]\\n` text `</s>\\n` for each turn. Inside roles and texts a backslash is doubled and a
control string gets a backslash after its first character, so no control string is ever left in them; reading back
drops each first backslash.

Defined cases: null texts and roles are empty. Turns are ordered by turn (nulls first), then role and text; repeated
rows are turns of their own. A null conv_id is a conversation of its own. Examples repeat their context, so the output
of one conversation grows with the square of its turns; that is the method's format. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import table

#: The control strings of the template and of its family.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"(<|\[)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
OPEN, MID, END = "<s>[INST] ", " [/INST]\n", "</s>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def expand_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row by example: conv_id, example (position of its last turn), trainable, formatted, loss_start, loss_length."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("t"), blank(role).alias("r"), blank(text).alias("x")).alias("_t"))
    by = by.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    by = by.withColumn(
        "_parts",
        F.transform("_turns", lambda t: F.struct(t["r"].alias("r"), F.concat(F.lit(OPEN), escape(t["r"]), F.lit(MID)).alias("head"), escape(t["x"]).alias("body"))),
    )
    whole = F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    by = by.select("conv_id", "_parts", whole.alias("_whole"))
    last = F.size("_parts") - 1
    picks = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("_parts", i)["r"] == "assistant") | (i == last))

    def example(i: Column) -> Column:
        part, context = F.get("_parts", i), F.array_join(F.slice("_whole", F.lit(1), i), "")
        trains = part["r"] == "assistant"
        return F.struct(
            i.alias("example"), trains.alias("trainable"), F.concat(context, F.get("_whole", i)).alias("formatted"),
            F.when(trains, F.length(context) + F.length(part["head"])).otherwise(0).cast("bigint").alias("loss_start"),
            F.when(trains, F.length(part["body"])).otherwise(0).cast("bigint").alias("loss_length"),
        )

    # examples are finished before they become rows, so no row carries the whole conversation beside its own text
    return by.select("conv_id", F.explode(F.transform(picks, example)).alias("_e")).select("conv_id", "_e.*")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, unescaped."""
    pieces = F.split(formatted, "</s>\n")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))  # nothing stands after the last mark
    head = lambda p: F.locate(" [/INST]\n", p)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(p.substr(F.lit(len(OPEN) + 1), head(p) - len(OPEN) - 1)).alias("role"),
            unescape(p.substr(head(p) + len(MID), F.length(p))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """By conversation, read back from the examples: its turns, its trainable text, and the characters of all examples."""
    loss = F.when(F.col("trainable"), unescape(F.col("formatted").substr(F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))))
    d = examples.select("conv_id", "example", "formatted", F.length("formatted").cast("bigint").alias("_n"), loss.alias("_loss"))
    by = d.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_last"),
        F.sort_array(F.collect_list(F.when(F.col("_loss").isNotNull(), F.struct("example", "_loss")))).alias("_losses"),
        F.sum("_n").alias("formatted_chars"),
    )
    by = by.select("conv_id", "formatted_chars", read_turns(F.col("_last")).alias("_turns"), F.array_join(F.transform("_losses", lambda x: x["_loss"]), "").alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and the planted conversation -7 whose texts are control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    planted = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(trap).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    return digest(expand_examples(turns.unionByName(planted)))
