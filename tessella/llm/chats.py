"""Multi-party dialogues from every participant's point of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, global_rank

#: Marks around a turn: who speaks, and its end. Turns of a segment.
OWN, OTHER, SYSTEM, END, SEGMENT = "<|assistant|>\n", "<|user name={}|>\n", "<|system|>\n", "<|end|>\n", 256
SYSTEM_ROLES = ("system",)


def plain_text(text: Column) -> Column:
    """text in which nothing reads as the start of a mark: every `<|`, with any backslashes between, gets one more backslash. Taking one
    away again gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def plain_name(name: Column) -> Column:
    """A name that can't end its mark either: every `|>` gets a backslash in the same way."""
    return F.regexp_replace(plain_text(name), r"\|(\\*)>", r"|\\$1>")


def rotate(turns: DataFrame, segment: int = SEGMENT, system_roles: tuple[str, ...] = SYSTEM_ROLES, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segment, speaker, n_turns, rendered, mask): for every participant of a conversation, the dialogue with that speaker
    as the assistant and all others as users under their names; mask has the code point ranges of rendered that the speaker wrote
    (bodies and end marks), which are to be learnt. Roles in system_roles set the scene for everyone and are no participants. What
    reads as a mark within names and texts is escaped by plain_name() and plain_text().

    A conversation is rendered whole if it has `segment` turns at most, in the order of turn, role and text. A longer one is rendered
    in segments of so many turns, so that no task holds more of one conversation than that, however many rows it has; every later
    segment begins with the conversation's first turn again if that is a system turn (it isn't counted in n_turns). In a segment
    where a speaker is silent its mask is empty. Positions come from a global rank, so one conversation may hold any share of the rows.
    A null or empty text is an empty turn, however long a text it stays whole, a null role is the participant "unknown", a null turn
    stands before all others, each row with a null conversation is a conversation of its own. Repeated rows are turns of their own;
    equal turn numbers are ordered by role and text. A conversation of system turns alone has no participant, hence no row; an empty
    table gives none. Other columns are ignored, whatever their names.
    """
    given = Rows(turns)
    at = lambda name: F.col(given.column(name))
    rows = given.df.select(at(conv).alias("conv_id"), at(turn).alias("turn"), F.coalesce(at(role), F.lit("unknown")).alias("role"), F.coalesce(at(text), F.lit("")).alias("text"))
    ranked, _ = global_rank(rows, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")])
    system = F.col("role").isin(*system_roles)
    alone = F.when(F.col("conv_id").isNull(), F.col("rank"))  # tells rows without a conversation apart
    ranked = ranked.withColumn("alone", F.coalesce(alone, F.lit(-1).cast("long")))
    heads = ranked.groupBy("conv_id", "alone").agg(F.min("rank").alias("head"), F.array_sort(F.collect_set(F.when(~system, F.col("role")))).alias("speakers"))
    heads = heads.withColumnsRenamed({"conv_id": "__conv", "alone": "__alone"})
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("alone") == F.col("__alone"))
    placed = ranked.join(heads.select("__conv", "__alone", "head"), same).drop("__conv", "__alone").withColumn("segment", F.expr(f"(rank - head) div {segment}"))
    first = placed.where((F.col("rank") == F.col("head")) & system).select(F.col("conv_id").alias("__conv"), F.col("alone").alias("__alone"), F.struct("rank", "role", "text").alias("first"))
    pieces = placed.groupBy("conv_id", "alone", "segment").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    pieces = pieces.join(heads.select("__conv", "__alone", "speakers"), same).drop("__conv", "__alone").join(first, same, "left")
    pieces = pieces.withColumn("shown", F.when((F.col("segment") > 0) & F.col("first").isNotNull(), F.concat(F.array("first"), "turns")).otherwise(F.col("turns")))
    views = pieces.select("conv_id", "segment", F.size("turns").cast("long").alias("n_turns"), F.transform("shown", lambda t: F.named_struct(F.lit("role"), t["role"], F.lit("text"), plain_text(t["text"]))).alias("turns"), F.explode("speakers").alias("speaker"))

    def head(t: Column) -> Column:
        before, after = OTHER.split("{}")
        other = F.when(t["role"].isin(*system_roles), F.lit(SYSTEM)).otherwise(F.concat(F.lit(before), plain_name(t["role"]), F.lit(after)))
        return F.when(t["role"] == F.col("speaker"), F.lit(OWN)).otherwise(other)

    body = lambda t: F.concat(t["text"], F.lit(END))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(head(t), body(t))), "")
    zero = F.expr("named_struct('at', 0L, 'mask', cast(array() as array<struct<start:bigint,end:bigint>>))")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t))
        end = start + F.length(body(t))
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == F.col("speaker"), F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    return views.select("conv_id", "segment", "speaker", "n_turns", rendered.alias("rendered"), F.aggregate("turns", zero, step)["mask"].alias("mask"))
