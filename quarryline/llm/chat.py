"""Dialogues from the view of each participant (operator 1), by DataFrame functions only.

Every speaker of a conversation but the system is a participant. For each of them the dialogue is rendered with that
speaker as assistant and the others as named users; the mask holds the stretches of the text that
the assistant says. Turns stand in order of their number, null last, then of speaker and text, so ties have one order;
a repeated row is a turn of its own. A null or blank role is the speaker "unknown", "system" in any case of letters is the
system, a null text is empty. Speakers are named by their roles. A role with other characters than letters, digits, _ and -
has them as _ and eight digits of its hash behind a ~, so that no two roles get one name. Marks of the format inside a
text are broken up. A conversation of the system alone has no participant and no row; one of null id is a conversation
like others. A dialogue comes in segments of 64 turn numbers, a segment of more rows in parts of 64: no group grows with a
long conversation. n_turns, n_chars and the mask's offsets are those of the row's own part. An empty table gives an empty
result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 64


def perspectives(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, segment, part, speaker, n_turns, text, n_chars and mask ("start:end" of the assistant's words, comma-joined)."""
    blank = F.trim(F.coalesce("role", F.lit("")))
    clean = F.regexp_replace(blank, r"[^\p{L}\p{N}_-]+", "_")
    apart = F.when(clean == blank, clean).otherwise(F.concat(clean, F.lit("~"), F.left(F.md5(blank), F.lit(8))))
    name = F.when(blank == "", "unknown").when(F.lower(blank) == "system", "system").otherwise(apart)
    turns = conversations.select(
        "conv_id", F.col("turn"), name.alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
        F.floor(F.col("turn") / span).alias("segment"),
    )
    order = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_last(), "speaker", "said")
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("part", F.floor((F.col("place") - 1) / span))
    rows = turns.groupBy("conv_id", "segment", "part").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "said"))).alias("turns"))
    people = conversations.select(F.col("conv_id").alias("id"), name.alias("view")).where("view <> 'system'").distinct()
    joined = rows.join(people, F.col("conv_id").eqNullSafe(F.col("id")))
    head = lambda t: (
        F.when(t["speaker"] == "system", "<|im_start|>system\n").when(t["speaker"] == F.col("view"), "<|im_start|>assistant\n")
        .otherwise(F.concat(F.lit("<|im_start|>user name="), t["speaker"], F.lit("\n")))
    )
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["said"].alias("said"), (t["speaker"] == F.col("view")).alias("own")))
    joined = joined.select("conv_id", "segment", "part", "view", pieces.alias("pieces"))
    tail = "<|im_end|>\n"
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["said"]) + len(tail))
    joined = joined.withColumn("sizes", sizes)
    # characters before each piece; a part has span pieces at most
    before = F.transform("pieces", lambda p, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(p["head"]))
    spans = F.transform(F.arrays_zip(F.col("pieces").alias("p"), before.alias("at")), lambda z: F.struct(z["p"]["own"].alias("own"), z["at"].alias("a"), (z["at"] + F.length(z["p"]["said"])).alias("b")))
    mask = F.array_join(F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",")
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["said"], F.lit(tail))), "")
    return joined.select(
        "conv_id", "segment", "part", F.col("view").alias("speaker"), F.size("pieces").cast("long").alias("n_turns"),
        text.alias("text"), F.length(text).cast("long").alias("n_chars"), mask.alias("mask"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, text, trim(coalesce(role, '')) AS own, regexp_replace(trim(coalesce(role, '')), '[^\p{L}\p{N}_-]+', '_', 'g') AS clean FROM conversations),
t AS (
  SELECT conv_id, turn, CASE WHEN own = '' THEN 'unknown' WHEN lower(own) = 'system' THEN 'system' WHEN own = clean THEN own ELSE clean || '~' || left(md5(own), 8) END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS said, CAST(floor(turn / 64.0) AS BIGINT) AS segment FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS LAST, speaker, said) AS place FROM t),
v AS (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker <> 'system'),
x AS (
  SELECT o.conv_id, o.segment, CAST((o.place - 1) // 64 AS BIGINT) AS part, v.speaker AS view, o.place, o.said, o.speaker = v.speaker AS own,
         CASE WHEN o.speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN o.speaker = v.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || o.speaker || chr(10) END AS head
  FROM o JOIN v ON o.conv_id IS NOT DISTINCT FROM v.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, segment, part, view ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM x),
z AS (
  SELECT conv_id, segment, part, view AS speaker, count(*) AS n_turns, string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY place) AS text,
         coalesce(string_agg(CAST(a AS VARCHAR) || ':' || CAST(a + length(said) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE own), '') AS mask
  FROM y GROUP BY conv_id, segment, part, view)
SELECT conv_id, segment, part, speaker, n_turns, text, length(text) AS n_chars, mask FROM z
"""
