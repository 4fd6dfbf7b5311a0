"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base measures come from one pass over each text; equal 3-word windows inside a text are found by sorting its window
hashes (64 bits, compared only within one text). Beyond two fixed base rules every ratio is sketched per
language and source, and a document fails where a ratio lies beyond the fence
``q75 + REACH * max(q75 - q25, least spread)`` of its group. The least spread is a constant; where a group varies less, it decides (README has figures).

The sketch is a histogram with buckets that keep the top ``PRECISION`` bits of a value, so a quantile is right to one part in
32. Sketches merge by adding counts: sources add up to their language, languages to the whole. A group of fewer than ``MIN_GROUP``
documents is judged by its language, or else by the whole. Sketching pre-aggregates, so a hot source sends few rows.

Null and empty texts have no words and fail the base rules. Null languages and sources are groups like others. Repeated rows count as
often as they occur. An empty table gives an empty result. Columns other than doc_id, text, lang and source are passed through by
``filter_documents`` and not read elsewhere; one named ``_measures`` is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.llm.columns import carry, once
from ringsight.llm.stages import settle, settle_compact

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PRECISION = 6
MIN_GROUP = 200
REACH = 3
#: Ratio -> least spread of its group, in its own unit.
RATIOS = {"symbols": 100, "dup_lines": 200, "repeats": 100, "word_length": 10}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """The documents with a struct ``_measures`` of long fields."""
    passed = [c for c in docs.columns if c != "_measures"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = once(docs.select(*passed), "_w", F.struct(words.alias("words"), lines.alias("lines")))
    df = df.withColumns({"_words": F.col("_w.words"), "_lines": F.col("_w.lines")}).drop("_w")

    def window(i: Column) -> Column:
        at = lambda k: F.get("_words", i + k)
        return F.struct(F.xxhash64(at(0), at(1), at(2)).alias("h"), i.alias("p"))

    count = F.size("_words")
    windows = F.when(count >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), count - 3), window)))
    df = once(df, "_sorted", windows)
    twice = F.filter("_sorted", lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["covered"] + F.least(F.lit(3), p - acc["last"])).alias("covered")),
        lambda acc: acc["covered"],
    )
    values = {
        "n_words": count,
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    packed = F.struct(*[v.cast("long").alias(k) for k, v in values.items()])
    return df.select(*passed, packed.alias("_measures"))


def base_failed(m: Column | str) -> Column:
    get = (lambda k: F.col(k)) if m == "" else (lambda k: F.col(f"{m}.{k}"))
    return (get("n_words") < MIN_WORDS) | (100 * get("n_repeat_words") > MAX_REPEAT_PERCENT * get("n_words"))


def _ratios(m: str) -> dict[str, Column]:
    """Whole numbers: per mille of words or lines, and tenths of a character."""
    part = lambda scale, up, down: F.floor(F.lit(scale) * F.col(f"{m}.{up}") / F.greatest(F.col(f"{m}.{down}"), F.lit(1))).cast("long")
    return {
        "symbols": part(1000, "n_symbols", "n_words"),
        "dup_lines": part(1000, "n_dup_lines", "n_lines"),
        "repeats": part(1000, "n_repeat_words", "n_words"),
        "word_length": part(10, "word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """Smallest value of the sketch bucket: the top PRECISION bits stay."""
    drop = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, n): one mergeable histogram per language, source and ratio, of what passes the base rules."""
    ratios = _ratios("_measures")
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("value")) for k, v in ratios.items()])
    rows = measured.filter(~base_failed("_measures")).select("lang", "source", F.inline(pairs))
    return rows.groupBy("lang", "source", "ratio", "value").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest accepted value of each ratio for each group, as a map, and the size of the group."""
    merged = sketches.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    upto = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))
    quantile = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("value")))
    one = ranked.groupBy(*keys, "ratio").agg(quantile(25).alias("low"), quantile(75).alias("high"), F.max("total").alias("size"))
    least = reduce(lambda rest, kv: F.when(F.col("ratio") == kv[0], F.lit(kv[1])).otherwise(rest), RATIOS.items(), F.lit(0))
    room = F.lit(REACH) * F.greatest(F.col("high") - F.col("low"), least)
    shut = one.select(*keys, "size", "ratio", (F.col("low") - room).alias("least"), (F.col("high") + room).alias("most"))
    pick = lambda k, side: F.max(F.when(F.col("ratio") == k, F.col(side))).alias(f"{k}_{side}")
    return shut.groupBy(*keys).agg(F.max("size").alias("size"), *[pick(k, s) for k in RATIOS for s in ("least", "most")])


def judge(measured: DataFrame) -> DataFrame:
    """Add ``_base_failed`` and ``_kept`` to measured documents. Give it a written stage: it is read twice."""
    sketches = settle(sketch(measured))
    sides = [f"{k}_{s}" for k in RATIOS for s in ("least", "most")]
    own = fences(sketches, ["lang", "source"]).filter(F.col("size") >= MIN_GROUP)
    by_lang = fences(sketches, ["lang"]).filter(F.col("size") >= MIN_GROUP)
    whole = fences(sketches.withColumn("all", F.lit(1)), ["all"]).first()  # one row
    groups = measured.select("lang", "source").distinct()

    def named(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_{prefix}_{k}") for k in keys], *[F.col(s).alias(f"_{prefix}_{s}") for s in sides])

    a, b = named(own, "a", ["lang", "source"]), named(by_lang, "b", ["lang"])
    limits = (
        groups.join(a, groups["lang"].eqNullSafe(a["_a_lang"]) & groups["source"].eqNullSafe(a["_a_source"]), "left")
        .join(b, groups["lang"].eqNullSafe(b["_b_lang"]), "left")
        .select(
            groups["lang"].alias("_l_lang"),
            groups["source"].alias("_l_source"),
            F.struct(*[F.coalesce(f"_a_{s}", f"_b_{s}", F.lit(whole[s] if whole else None).cast("long")).alias(s) for s in sides]).alias("_limits"),
        )
    )
    joined = measured.join(
        settle(limits), measured["lang"].eqNullSafe(F.col("_l_lang")) & measured["source"].eqNullSafe(F.col("_l_source")), "left"
    )
    fits = lambda k, v: F.coalesce((v <= F.col(f"_limits.{k}_most")) & (v >= F.col(f"_limits.{k}_least")), F.lit(True))
    inside = reduce(lambda x, y: x & y, [fits(k, v) for k, v in _ratios("_measures").items()])
    failed = base_failed("_measures")
    return joined.select(*[measured[c] for c in measured.columns], failed.alias("_base_failed"), (~failed & inside).alias("_kept"))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept, for every row."""
    small = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    judged = judge(settle(measure(small).drop("text")))
    fields = [F.col(f"_measures.{k}").alias(k) for k in MEASURES if k != "n_lines"]
    return judged.select("doc_id", *fields, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    named = carry(docs, F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    judged = judge(settle_compact(measure(named).drop("text")))
    return judged.filter("_kept").select("row.*")


def oracle(table: str = "documents") -> str:
    """The rows of ``assess`` in DuckDB."""
    ratio = {
        "symbols": "1000 * n_symbols // greatest(n_words, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
        "word_length": "10 * word_chars // greatest(n_words, 1)",
    }
    union = " UNION ALL ".join(f"SELECT lang, source, '{k}' ratio, {k} v FROM r WHERE NOT base_failed" for k in RATIOS)
    spread = "CASE ratio " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATIOS.items()) + " END"

    def level(name: str, keys: str) -> str:
        part = f"{keys}, ratio" if keys else "ratio"
        first = f"{keys}," if keys else ""
        return f"""
{name}_m AS (SELECT {first} ratio, value, sum(n) n FROM sk GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY value ROWS UNBOUNDED PRECEDING) upto, sum(n) OVER (PARTITION BY {part}) total FROM {name}_m),
{name}_q AS (SELECT {first} ratio, min(value) FILTER (WHERE upto * 100 >= total * 25) lo, min(value) FILTER (WHERE upto * 100 >= total * 75) hi, max(total) size FROM {name}_c GROUP BY ALL),
{name} AS (SELECT {first} ratio, size, lo - {REACH} * greatest(hi - lo, {spread}) least, hi + {REACH} * greatest(hi - lo, {spread}) most FROM {name}_q)"""

    checks, joins = [], []
    for k in RATIOS:
        limit = f"coalesce(a_{k}.most, b_{k}.most, c_{k}.most)", f"coalesce(a_{k}.least, b_{k}.least, c_{k}.least)"
        checks.append(f"coalesce(r.{k} <= {limit[0]} AND r.{k} >= {limit[1]}, true)")
        joins.append(
            f"LEFT JOIN la a_{k} ON a_{k}.ratio = '{k}' AND a_{k}.size >= {MIN_GROUP} AND a_{k}.lang IS NOT DISTINCT FROM r.lang AND a_{k}.source IS NOT DISTINCT FROM r.source\n"
            f"LEFT JOIN lb b_{k} ON b_{k}.ratio = '{k}' AND b_{k}.size >= {MIN_GROUP} AND b_{k}.lang IS NOT DISTINCT FROM r.lang\n"
            f"LEFT JOIN lc c_{k} ON c_{k}.ratio = '{k}'"
        )
    return rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM {table}),
ln AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc0 AS (SELECT rid, count(*) n_lines, count(*) - count(DISTINCT line) n_dup FROM ln GROUP BY rid),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) i FROM d)),
two AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) n_rep FROM two, (VALUES (0), (1), (2)) x(o) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, lang, source, len(w)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(n_lines, 0) n_lines, coalesce(n_dup, 0) n_dup_lines,
    coalesce(n_rep, 0) n_repeat_words
  FROM d LEFT JOIN lc0 USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT *, {", ".join(f"{v} {k}" for k, v in ratio.items())}, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) base_failed FROM m),
sk AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - {PRECISION}, 0)) << greatest(length(bin(v)) - {PRECISION}, 0) AS value, count(*) n
  FROM ({union}) GROUP BY ALL),{level("la", "lang, source")},{level("lb", "lang")},{level("lc", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(checks)} AS kept
FROM r {" ".join(joins)}
"""
