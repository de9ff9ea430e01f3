"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once, with that speaker as the assistant and
all others as named users; only the speaker's own turns are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_TURNS = 512
"""Turn numbers per rendered part: a dialogue of any length is rendered in parts of bounded size."""
INSTRUCTIONS = "system"


def _own(speaker: Column) -> Column:
    return F.col("role") == speaker


def safe(text: Column) -> Column:
    """``<|`` is written ``<\\|``, so that no text or name can hold a mark of the format."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rendered_turns(turns: DataFrame) -> DataFrame:
    """One row per participant and turn: conv_id, speaker, part, piece, turn, role, head, body, trained.

    Participants are the distinct non-null roles of a conversation without ``system``, whose turns are instructions in
    every rendering. A null role is an unnamed user, and no participant. A null text is empty; a null turn comes
    first, in part 0. Rows with a null conv_id are one conversation. Repeated rows stay repeated. Turns meet the
    speakers of their part, so that one long conversation is spread by its parts.
    """
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).cast("long")
    base = turns.select("conv_id", part.alias("part"), "turn", "role", safe(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    base = base.withColumn("piece", F.floor((F.row_number().over(order) - 1) / PART_TURNS).cast("long"))
    said = base.filter(F.col("role").isNotNull() & (F.col("role") != INSTRUCTIONS)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    parts = base.select("conv_id", "part").distinct()
    people = parts.join(said, F.col("conv_id").eqNullSafe(F.col("of"))).select("of", F.col("part").alias("of_part"), "speaker")
    met = base.join(people, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part")
    own = F.coalesce(_own(F.col("speaker")), F.lit(False))
    name = F.when(own, "assistant").when(F.col("role") == INSTRUCTIONS, "system").otherwise(F.concat(F.lit("user name="), safe(F.coalesce("role", F.lit("unknown")))))
    head = F.concat(F.lit("<|"), name, F.lit("|>\n"))
    return met.select("conv_id", "speaker", "part", "piece", "turn", "role", head.alias("head"), F.concat("text", F.lit("\n<|end|>\n")).alias("body"), own.alias("trained"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, part, piece, n_turns, text, spans: each dialogue from each participant's side.

    ``spans`` are the [start, end) code points of ``text`` to train on: the speaker's own turns with their end mark,
    without the header. A dialogue is cut at every PART_TURNS turn numbers, and a part of more rows (repeated or null
    turn numbers) at every PART_TURNS rows; its parts and pieces in order are the whole. Turns stand in order of
    (turn, role, text). A conversation of only instructions has no participant and no row.
    """
    rows = rendered_turns(turns)
    grouped = rows.groupBy("conv_id", "speaker", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "head", "trained"))).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(t["head"])
        end = body + F.length(t["body"])
        span = F.array(F.struct(body.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "")
    return grouped.select("conv_id", "speaker", "part", "piece", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("turns", start, step)["spans"].alias("spans"))
