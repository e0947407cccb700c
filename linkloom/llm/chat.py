"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, its text alone is trainable. Turns after
the last assistant turn become one more example without a trainable part, so that the output holds every turn. Control
strings inside texts and roles are escaped reversibly, so a text can't end its own turn or start another.

Defined results: null texts and roles are empty; rows with a null conv_id form one conversation of their own; equal turn
numbers are ordered by role, then text; repeated rows are repeated turns; a conversation without assistant turns gives
one example that trains nothing; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def escape(c: Column, header: bool = False) -> Column:
    """A backslash becomes backslash 0, the opening of a control string ``<\\1``; in headers a line end becomes backslash 2."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1"))
    return F.replace(c, F.lit("\n"), F.lit("\\2")) if header else c


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\2"), F.lit("\n")), F.lit("<\\1"), F.lit("<|"))
    return F.replace(c, F.lit("\\0"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), turns (context and target), formatted, loss_start, loss_length.

    The last two give the loss mask in code points of ``formatted``; loss_length is null where nothing is trained.
    One shuffle by conversation; the expansion keeps its partitioning.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    shown = F.transform(
        "t",
        lambda x: F.struct(
            (x["role"] == TRAINED).alias("trained"),
            F.concat(F.lit(START), escape(x["role"], True), F.lit("\n")).alias("head"),
            escape(x["text"]).alias("body"),
        ),
    )
    conv = conv.select("conv_id", shown.alias("s"))
    # Positions of targets; one past the end stands for the turns after the last assistant turn.
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.col("s")[i]["trained"])
    rest = F.when(F.element_at("s", -1)["trained"], F.lit(None)).otherwise(F.array(F.size("s")))
    conv = conv.select("conv_id", "s", F.posexplode(F.concat(at, F.coalesce(rest, F.expr("cast(array() AS array<int>)")))).alias("example", "target"))
    prefix = F.array_join(F.transform(F.slice("s", 1, F.col("target")), lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    has = F.col("target") < F.size("s")
    last = F.when(has, F.try_element_at("s", F.col("target") + 1))
    conv = conv.select("conv_id", "example", (F.col("target") + has.cast("int")).alias("turns"), prefix.alias("context"), last["head"].alias("head"), last["body"].alias("body"))
    return conv.select(
        "conv_id",
        "example",
        "turns",
        F.concat("context", F.coalesce("head", F.lit("")), F.coalesce("body", F.lit("")), F.when(F.col("head").isNull(), "").otherwise(END + "\n")).alias("formatted"),
        (F.length("context") + F.length("head")).alias("loss_start"),
        F.length("body").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    parts = F.split(formatted, "<\\|im_start\\|>")
    parts = F.slice(parts, 2, F.size(parts))
    body = lambda x: F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(END) - 1)
    return F.transform(parts, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(body(x)).alias("text")))


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, length))


def digest(ex: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    own = ex.select(
        "conv_id",
        "example",
        "turns",
        F.coalesce(trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")), F.lit("")).alias("trained"),
        F.length("formatted").cast("long").alias("chars"),
        "formatted",
    )
    out = own.groupBy("conv_id").agg(
        F.max_by("formatted", "turns").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    ).withColumn("t", read_back(F.col("whole")))
    hashed = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(hashed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
