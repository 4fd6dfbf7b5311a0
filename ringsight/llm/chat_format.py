"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold a conversation once for every state it went through. A conversation whose turns are the first turns of a
longer one is such a snapshot and goes; of equal conversations the one with the smallest id stays. Every turn gets the signature of
the conversation up to it: running sums of four 31-bit hashes of (place, role, text), 124 bits in all, which need
no conversation in one task. Whole conversations are then anti-joined with the signatures of proper prefixes, pre-aggregated, so
that a common first turn is one row.

What stays is rendered turn by turn, with the place of each piece in the text of its conversation: a conversation
of any length is written without gathering it.

Turns are ordered by (turn, role, text), a null turn first, nulls before values; a null role or text counts as empty. Exact repeats of a row are one
turn. Rows without conv_id form one conversation. An empty table gives an empty result. Columns other than conv_id,
turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.llm.stages import settle
from ringsight.operators.ordered import Lane, Running, running

OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"
_LANE = ("conv", "lost")
_SUMS = ("s1", "s2", "s3", "s4")


def _turns(turns: DataFrame) -> DataFrame:
    """conv and lost (no id) as never-null keys, the turn's order, role and text; exact repeats once."""
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("lost"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("at"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()


def prefix_signatures(turns: DataFrame) -> DataFrame:
    """Per turn: conv, lost, nth (from 1), and the four sums of the conversation up to it. Texts go in as hashes."""
    slim = turns.select(*_LANE, "at", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "role", "text").alias("g"), F.col("turn").isNotNull().alias("dated"))
    ties = ("dated", "role", "h", "g")
    numbered = settle(running(slim, Lane(_LANE, "at", ties), nth=Running("sum", F.lit(1).cast("long"))))
    low, high = (lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF))), (lambda c: F.shiftrightunsigned(c, 33))
    a, b = F.xxhash64("nth", "role", "h", "g"), F.xxhash64("g", "h", "nth", F.lit(1))
    terms = {"s1": low(a), "s2": high(a), "s3": low(b), "s4": high(b)}
    return settle(running(numbered, Lane(_LANE, "nth"), **{k: Running("sum", v) for k, v in terms.items()}).select(*_LANE, "nth", *_SUMS))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, lost) of the conversations that are no prefix of another."""
    signed = prefix_signatures(turns)
    length = signed.groupBy(*_LANE).agg(F.max("nth").alias("n"))
    marked = signed.join(length, [*_LANE])
    whole = marked.filter("nth = n").groupBy("nth", *_SUMS).agg(F.min(F.struct("lost", "conv")).alias("first"))
    proper = marked.filter("nth < n").select("nth", *_SUMS).distinct()
    return whole.join(proper, ["nth", *_SUMS], "left_anti").select("first.conv", "first.lost")


def render(turns: DataFrame, opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """conv_id, turn, role, nth, start and rendered: the pieces of every retained conversation in their order."""
    clean = settle(_turns(turns))
    kept = clean.join(maximal(clean), [*_LANE], "left_semi")
    before, after = opening.split("{role}")
    piece = F.concat(F.lit(before), "role", F.lit(after), "text", F.lit(closing))
    pieces = kept.select(*_LANE, "at", "turn", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "role", "text").alias("g"), F.col("turn").isNotNull().alias("dated"), piece.alias("rendered"))
    lane = Lane(_LANE, "at", ("dated", "role", "h", "g"))
    placed = running(
        pieces,
        lane,
        nth=Running("sum", F.lit(1).cast("long")),
        start=Running("sum", F.length("rendered").cast("long"), inclusive=False, default=0),
    )
    return placed.select(F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "turn", "role", "nth", "start", "rendered")


def oracle(table: str = "conversations") -> str:
    """The digest of ``render`` in DuckDB, for tables without nulls and with one row per turn."""
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM {table}),
c AS (SELECT conv_id, string_agg(role || chr(31) || text || chr(30), '' ORDER BY turn) s FROM t GROUP BY conv_id),
gone AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON starts_with(b.s, a.s) AND (length(b.s) > length(a.s) OR b.conv_id < a.conv_id)),
r AS (SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS p FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone))
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT nth,
  coalesce(sum(length(p)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  length(p)::BIGINT n_chars, sha256(p) AS sha256
FROM r
"""
