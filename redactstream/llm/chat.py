"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is written turn by turn as `<|im_start|>role`, a line end, the text,
`<|im_end|>` and a line end. The grammar is deterministic: a turn ends at the next
`<|im_end|>` and its role at the first line end, no bare control string may stand inside, and
escaped ones are restored.
A control string in a role or text is escaped by a tilde behind its `<`; one with tildes gets
one more, so restoring takes one away. Each turn is rendered as it is and parsed back; only
turns that do not come back the same are escaped, rendered and parsed once more. One that still
differed would end the job, but none can: an escaped text holds no control string, and a control
string begins with its only `<`, so none arises where text and template meet. A line end inside
a role is written `<|nl|>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.llm.store import keep

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
CONTROL = r"<(~*)\|(im_start|im_end|nl)\|>"
ESCAPED = r"<~(~*)\|(im_start|im_end|nl)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<~$1|$2|>")


def restore(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"<$1|$2|>")


def write_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def read_role(role: Column) -> Column:
    return restore(F.replace(role, F.lit(BREAK), F.lit("\n")))


def render_turn(role: Column, text: Column) -> Column:
    """A written role and text inside the template."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse_turns(rendered: Column) -> Column:
    """The grammar: an array of (role, text), restored; null where the text is not of it."""
    parts = F.split(rendered, r"<\|im_end\|>\n")
    inner = F.slice(parts, 1, F.size(parts) - 1)

    def proper(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        text = F.substr(body, F.instr(body, "\n") + 1)
        holds = body.contains(START) | body.contains(END) | text.contains(BREAK)
        return p.startswith(START) & body.contains("\n") & ~holds

    whole = (F.element_at(parts, -1) == "") & F.forall(inner, proper)
    body = F.transform(inner, lambda p: F.substr(p, F.lit(len(START) + 1)))
    turns = F.transform(
        body,
        lambda p: F.struct(
            read_role(F.substring_index(p, "\n", 1)).alias("role"),
            restore(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    return F.when(whole, turns)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, `formatted`, and `runs`: per turn the characters before, under and after the loss mask.

    Null roles and texts count as empty. Turns go by turn number (null first), then role, then
    text, so ties and repeated rows have a fixed place. Rows without a conv_id form one
    conversation. A conversation is one string, so it must fit in a task; its rows reach that
    task once, as rendered turns. Only the template's columns are read, whatever else there is.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    same = parse_turns(render_turn(F.col("role"), F.col("text"))).eqNullSafe(source)
    escaped = F.struct(write_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    asis = F.struct(F.col("role").alias("role"), F.col("text").alias("text"))
    out = rows.withColumn("_same", same).withColumn("_out", F.when(F.col("_same"), asis).otherwise(escaped))
    back = parse_turns(render_turn(F.col("_out.role"), F.col("_out.text"))).eqNullSafe(source)
    text_out = F.when(F.col("_same") | back, F.col("_out.text")).otherwise(
        F.raise_error(F.lit("a turn does not come back from its escaped form"))
    )
    written = out.select(
        "conv_id",
        F.struct("turn", "role", "text", F.col("_out.role").alias("role_out"), text_out.alias("text_out")).alias("t"),
    )
    grouped = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rendered = F.transform("t", lambda t: render_turn(t["role_out"], t["text_out"]))

    def runs(t: Column) -> Column:
        head = F.lit(len(START) + 1) + F.length(t["role_out"])
        loss, size, tail = t["role"] == loss_role, F.length(t["text_out"]), F.lit(len(END) + 1)
        return F.struct(
            F.when(loss, head).otherwise(head + size + tail).alias("before"),
            F.when(loss, size).otherwise(0).alias("under"),
            F.when(loss, tail).otherwise(0).alias("after"),
        )

    return grouped.select(
        "conv_id",
        F.array_join(rendered, "").alias("formatted"),
        F.transform("t", runs).alias("runs"),
        F.sha2(spoken(F.col("t")), 256).alias("source_sha256"),
    )


def spoken(turns: Column) -> Column:
    """Role and text of all turns, each on lines of its own."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def under_mask(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, restored; null where the runs do not fit the turns.

    Each turn is cut by its own run, so the cost grows with the conversation and not its square.
    """
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(p, F.lit(END + "\n")))
    cut = F.zip_with(
        turns,
        runs,
        lambda t, r: F.struct(
            (F.length(t) == r["before"] + r["under"] + r["after"]).alias("fits"),
            restore(F.substr(t, r["before"] + 1, r["under"])).alias("text"),
        ),
    )
    fits = (F.size(turns) == F.size(runs)) & F.forall(cut, lambda c: F.coalesce(c["fits"], F.lit(False)))
    return F.when(fits, F.array_join(F.transform(cut, lambda c: c["text"]), ""))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when parsed back, and what lies under their mask.

    A conversation that does not parse, differs from its source, or whose mask does not fit its
    turns ends the job.
    """
    parsed = formatted.select(
        "conv_id", "formatted", "source_sha256", parse_turns(F.col("formatted")).alias("turns"),
        under_mask(F.col("formatted"), F.col("runs")).alias("loss"),
    )
    flat = parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken(F.col("turns")), 256).alias("said"),
        "source_sha256",
        "loss",
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.col("said").eqNullSafe(F.col("source_sha256")) & F.col("loss").isNotNull()
    broken = F.raise_error(F.concat(F.lit("conversation not recovered: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))))
    return flat.select(
        "conv_id",
        "n_turns",
        F.when(whole, F.col("said")).otherwise(broken).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def chat_round_trip(turns: DataFrame) -> DataFrame:
    """Format, store, and read back: one row per conversation."""
    return chat_digest(keep(format_conversations(turns), "chat"))
