"""Multi-party perspective rotation of dialogues, in DataFrame functions alone.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant
and all others as named users; the mask marks what the assistant says (text and end marker), in
code points of the whole rendering.  ``context_roles`` (system) are rendered as themselves and never
take the assistant's part.

A rendering is one row.  One of more than about ``page_turns`` turns, which no single value could hold
at any length, comes in pages: rows numbered by ``page``, whose ``rendered``, put together, is the
rendering, and whose spans and ``start`` count from the rendering's beginning.  Nothing starts anew.

Turns are gathered by dialogue and range of turn numbers; where a range begins in each speaker's
rendering follows from counts and lengths alone, a small table, so a dialogue of any length is
rendered by many tasks.  Turns of one dialogue that share a number are put in order in one task.

Results: null text: empty. Null role: a participant named unknown. Null conv_id: each such row is a
dialogue of its own. Null turn: before all others, ordered by the SHA-256 of role and text. Turns with equal
numbers are ordered by role and text, and repeated rows are repeated. ``<|`` in texts is written ``< |``, so
that a text cannot forge a marker. Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PAGE_TURNS = 1024
RANGE = 512  # turn numbers that are gathered together
UNNAMED = "unknown"


def _name(role: Column) -> Column:
    return F.regexp_replace(role, r"[\s<>|]+", "_")


def _head(role: Column, speaker: Column | None, context_roles: tuple[str, ...]) -> Column:
    """What stands before a turn; ``speaker`` None: as everyone but its own speaker is shown it."""
    label = F.when(role.isin(*context_roles), _name(role)).otherwise(F.concat(F.lit("user name="), _name(role)))
    if speaker is not None:
        label = F.when(role == speaker, F.lit("assistant")).otherwise(label)
    return F.concat(F.lit(START), label, F.lit("\n"))


def _render(views: DataFrame, context_roles: tuple[str, ...]) -> DataFrame:
    """``views`` (said, speaker, start, ...) with rendered, mask, n_turns, n_spoken, n_masked instead of said."""
    speaker, end = F.col("speaker"), len(END)
    views = views.withColumn("turns", F.transform("said", lambda m: F.struct(_head(m["role"], speaker, context_roles).alias("head"), m["text"].alias("text"), (m["role"] == speaker).alias("own")))).drop("said")

    def step(done: Column, m: Column) -> Column:
        start = done["at"] + F.char_length(m["head"])
        stop = start + F.char_length(m["text"]) + end
        spans = F.when(m["own"], F.concat(done["mask"], F.when(done["mask"] == "", F.lit("")).otherwise(F.lit(" ")), start.cast("string"), F.lit(":"), stop.cast("string"))).otherwise(done["mask"])
        return F.struct(stop.alias("at"), spans.alias("mask"), (done["n"] + F.when(m["own"], stop - start).otherwise(F.lit(0).cast("long"))).alias("n"))

    zero = F.struct(F.col("start").alias("at"), F.lit("").alias("mask"), F.lit(0).cast("long").alias("n"))
    return views.withColumns(
        {
            "done": F.aggregate("turns", zero, step),
            "rendered": F.array_join(F.transform("turns", lambda m: F.concat(m["head"], m["text"], F.lit(END))), ""),
            "n_turns": F.size("turns").cast("long"),
            "n_spoken": F.size(F.filter("turns", lambda m: m["own"])).cast("long"),
        }
    ).withColumns({"mask": F.col("done.mask"), "n_masked": F.col("done.n")}).drop("turns", "done")


def _places(turns: DataFrame, context_roles: tuple[str, ...], page_turns: int) -> DataFrame:
    """(conv_id, chunk, speaker, page, start, chunks): for every range of turns and speaker, where it begins
    in the speaker's rendering.  Made from counts and lengths; no text is moved."""
    said = turns.groupBy("conv_id", "chunk", "role").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("size"))
    length = F.col("size") + F.col("n") * (F.char_length(_head(F.col("role"), None, context_roles)) + len(END))
    chunks = said.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"), F.sum(length).alias("length"))
    dialogue = Window.partitionBy("conv_id").orderBy("chunk")
    before = dialogue.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    chunks = chunks.select(
        "conv_id", "chunk", F.floor(F.coalesce(F.sum("n").over(before), none) / page_turns).cast("long").alias("page"),
        F.coalesce(F.sum("length").over(before), none).alias("start"), F.count("*").over(Window.partitionBy("conv_id")).alias("chunks"),
    )
    cast = said.where(~F.col("role").isin(*context_roles)).groupBy("conv_id", F.col("role").alias("speaker")).agg(F.count("*").alias("present"))
    views = chunks.join(cast, "conv_id").join(said.select("conv_id", "chunk", F.col("role").alias("speaker"), F.col("n").alias("own")), ["conv_id", "chunk", "speaker"], "left")
    own = F.coalesce(F.sum("own").over(Window.partitionBy("conv_id", "speaker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), none)
    shorter = F.char_length(F.lit("assistant")) - F.char_length(F.concat(F.lit("user name="), _name(F.col("speaker"))))
    return views.select("conv_id", "chunk", "speaker", "page", (F.col("start") + own * shorter).alias("start"), "chunks")


def rotate_perspectives(conversations: DataFrame, context_roles: tuple[str, ...] = ("system",), page_turns: int = PAGE_TURNS) -> DataFrame:
    """conv_id, speaker, page, start, n_turns, n_spoken, rendered, mask, n_masked of ``conversations`` (conv_id,
    turn, role, text).  ``mask``: the spans ``start:end`` that are trained on, separated by spaces."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    unnumbered = F.col("turn").isNull()
    turns = turns.withColumn("key", F.when(unnumbered, F.sha2(F.concat_ws("|", "role", "text").cast("binary"), 256)).otherwise(""))
    turns = turns.withColumn("chunk", F.struct((~unnumbered).alias("numbered"), F.floor(F.col("turn") / RANGE).cast("long").alias("range"), F.substring("key", 1, 3).alias("sub")))
    message = F.struct("turn", "key", "role", "text")
    known = turns.where(F.col("conv_id").isNotNull())
    ranges = known.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(message)).alias("said"))
    views = _render(ranges.join(_places(known, context_roles, page_turns), ["conv_id", "chunk"]), context_roles)
    columns = ["conv_id", "speaker", "page", "start", "n_turns", "n_spoken", "rendered", "mask", "n_masked"]
    short = views.where("chunks = 1").select(columns)
    pieces = F.sort_array(F.collect_list(F.struct("chunk", "rendered", "mask")))
    total = lambda c: F.sum(c).alias(c)
    long = views.where("chunks > 1").groupBy("conv_id", "speaker", "page").agg(F.min("start").alias("start"), total("n_turns"), total("n_spoken"), total("n_masked"), pieces.alias("pieces"))
    long = long.withColumns({"rendered": F.array_join("pieces.rendered", ""), "mask": F.array_join(F.filter("pieces.mask", lambda m: m != ""), " ")}).select(columns)
    alone = turns.where(F.col("conv_id").isNull() & ~F.col("role").isin(*context_roles))
    alone = alone.select("conv_id", F.col("role").alias("speaker"), F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("start"), F.array(message).alias("said"))
    return short.unionByName(long).unionByName(_render(alone, context_roles).select(columns))


def oracle(context_role: str = "system", page_turns: int = PAGE_TURNS) -> str:
    """The same rows in DuckDB's SQL."""
    order = "turn NULLS FIRST, key, role, text"
    return rf"""
WITH c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS d, turn, coalesce(role, '{UNNAMED}') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
k AS (SELECT *, CASE WHEN turn IS NULL THEN sha256(role || '|' || text) ELSE '' END AS key, turn IS NOT NULL AS numbered, floor(turn / {RANGE}) AS rng, key[1:3] AS sub FROM c),
g AS (SELECT d, numbered, rng, sub, floor(coalesce(sum(n) OVER (PARTITION BY d ORDER BY numbered, rng NULLS FIRST, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {page_turns})::BIGINT AS page FROM (SELECT d, numbered, rng, sub, count(*) AS n FROM k GROUP BY ALL)),
p AS (SELECT DISTINCT d, role AS speaker FROM c WHERE role <> '{context_role}'),
s AS (SELECT k.*, speaker, page, '{START}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = '{context_role}' THEN role ELSE 'user name=' || regexp_replace(role, '[\s<>|]+', '_', 'g') END || chr(10) AS head
      FROM k JOIN p USING (d) JOIN g ON k.d = g.d AND k.numbered = g.numbered AND k.rng IS NOT DISTINCT FROM g.rng AND k.sub = g.sub),
o AS (SELECT *, (coalesce(sum(length(head) + length(text) + {len(END)}) OVER (PARTITION BY d, speaker ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head))::BIGINT AS pos FROM s)
SELECT any_value(conv_id) AS conv_id, speaker, page, min(pos - length(head))::BIGINT AS start, count(*) AS n_turns, count(*) FILTER (role = speaker) AS n_spoken,
       string_agg(head || text || '{END.strip()}' || chr(10), '' ORDER BY {order}) AS rendered,
       coalesce(string_agg(pos || ':' || (pos + length(text) + {len(END)}), ' ' ORDER BY {order}) FILTER (role = speaker), '') AS mask,
       coalesce(sum(length(text) + {len(END)}) FILTER (role = speaker), 0)::BIGINT AS n_masked
FROM o GROUP BY d, speaker, page"""
