"""Chat formatting: multi-party perspective rotation.

A conversation of several speakers becomes one training dialogue for each of them: that speaker's turns are rendered as
the assistant's, all others as those of named users, and only the assistant's turns are to be learned. Dialogues are
returned turn by turn with their places in the rendered text, so that even a conversation with a third of all rows is
never gathered in one place.

Marks within texts and names cannot forge a turn: each gets a backslash after its ``<`` (one more if there are some), which
taking one away undoes; line breaks in names become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
NOBODY = "unknown"
CHUNK = 512
#: A mark in a text, perhaps with backslashes already.
_MARK = r"<(\\*)\|im_(start|end)\|>"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """The dialogues of ``turns(conv_id, turn, role, text)`` from the perspective of each participant.

    Participants are the different roles of a conversation other than ``system``; a null role is the participant
    ``unknown``. A turn of a participant is rendered as ``<|im_start|>assistant\\n``, the text and ``<|im_end|>\\n`` in that
    participant's own dialogue, as ``<|im_start|>user name=<role>\\n...`` in those of the others; system turns keep their
    role. Returns for each perspective and turn ``conv_id, perspective, position INT`` (from 0), ``turn, speaker,
    rendered, learned BOOLEAN, start LONG, stop LONG, learn_start LONG, learn_stop LONG``: where the turn stands in the
    dialogue (code points, stop exclusive), and the part of it that is learned, text and end mark, for assistant turns
    (null otherwise).

    Turns are ordered by turn (null first), then speaker and text; repeated rows stay repeated and follow one another.
    ``speaker`` and ``perspective`` are the roles as they were; what is rendered has marks and names escaped.
    Null texts count as empty. A null conv_id is a conversation of its own. Conversations of system turns only have no
    participant and give no rows; neither does an empty table. Further columns are ignored.
    """
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(NOBODY)).alias("speaker"), _escaped(F.coalesce("text", F.lit(""))).alias("text"))
    participants = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(participants, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    learned = F.col("speaker") == F.col("perspective")
    head = F.when(learned, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), _escaped(F.regexp_replace("speaker", r"[\r\n]", " "))))
    head = F.concat(F.lit("<|im_start|>"), head, F.lit("\n"))
    rows = rows.select(
        "conv_id", "perspective", "turn", "speaker", F.concat(head, "text", F.lit("<|im_end|>\n")).alias("rendered"), learned.alias("learned"),
        F.char_length(head).alias("head"), "text", F.floor(F.coalesce("turn", F.lit(-CHUNK)) / CHUNK).cast("long").alias("chunk"),
    )
    rows = rows.withColumn("length", F.char_length("rendered").cast("long"))
    return _placed(rows).select(
        "conv_id", "perspective", "position", "turn", "speaker", "rendered", "learned", "start", (F.col("start") + F.col("length")).alias("stop"),
        _if_learned(F.col("start") + F.col("head")).alias("learn_start"), _if_learned(F.col("start") + F.col("length") - 1).alias("learn_stop"),
    )


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"<\\$1|im_$2|>")


def _if_learned(value: Column) -> Column:
    return F.when(F.col("learned"), value.cast("long"))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``position`` and ``start``: sums within chunks of turns, plus the sums of the chunks before."""
    key = ["conv_id", "perspective"]
    chunks = rows.groupBy(*key, "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("length_before"),
    )
    within = Window.partitionBy(*key, "chunk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("row", F.row_number().over(within) - 1).withColumn("ahead", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("chunk") == F.col("k")))
    return rows.withColumn("position", (F.col("row") + F.col("rows_before")).cast("int")).withColumn("start", (F.col("ahead") + F.col("length_before")).cast("long"))


_ESCAPED_SQL = rf"regexp_replace({{x}}, '{_MARK}', '<\\\1|im_\2|>', 'g')"
ORACLE = (
    """
with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, TEXT as text from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
h as (select t.*, perspective, speaker = perspective as learned,
    '<|im_start|>' || case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user name=' || NAME end || chr(10) as head
    from t join p on t.conv_id is not distinct from p.conv_id),
r as (select *, head || text || '<|im_end|>' || chr(10) as rendered from h),
o as (select *, row_number() over w - 1 as position, sum(length(rendered)) over w - length(rendered) as start from r
    window w as (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding))
select conv_id, perspective, cast(position as int) as position, turn, speaker, rendered, learned, cast(start as bigint) as start,
    cast(start + length(rendered) as bigint) as stop,
    case when learned then cast(start + length(head) as bigint) end as learn_start,
    case when learned then cast(start + length(rendered) - 1 as bigint) end as learn_stop
from o
""".replace("TEXT", _ESCAPED_SQL.format(x="coalesce(text, '')")).replace("NAME", _ESCAPED_SQL.format(x=r"regexp_replace(speaker, '[\r\n]', ' ', 'g')"))
)
