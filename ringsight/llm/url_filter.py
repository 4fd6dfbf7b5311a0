"""URL rules by hashed host suffixes and path prefixes, in DataFrame functions only.

A rule is an action, a host and a path. It fits a URL whose host is the rule's or a subdomain of it, and whose path starts with
the rule's; the longest rule wins (of equally long ones that with the longer host, then block before allow). Every distinct (host,
path) is spelt out as host suffix + path prefix, cut only at the label counts and path lengths that some rule has; these
expressions meet the rules by the first ``SHORT`` hex digits of their SHA-256, and the full digest confirms. Pages then take
the verdict of their (host, path). A host or page that a third of all rows share is one distinct row before it is spelt
out, and the join back splits by size at run time. No side is broadcast by hand.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path
runs on to ``?``, ``#`` or the end. A null URL and one without ``://`` have neither (both empty). Where no rule fits, the rule is
null and the verdict ``default``. Repeated rows are judged alike. An empty table or an empty list of rules gives rows
without rules. Columns other than the key and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.llm.columns import ascii_lower, literal_table, once

SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, F.lit("://"))
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as (action, "host/path"); a text without slash is a host alone."""
    rows = []
    for action, rule in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        host, slash, path = rule.partition("/")
        rows.append((action, host, slash + path))
    names = ("action", "rule_host", "rule_path")
    return literal_table(spark, names, rows or [("allow", "", "")]).filter(F.lit(bool(rows)))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict for every page. ``rules``: columns action, rule_host, rule_path."""
    host, path = host_and_path(F.col("url"))
    parsed = once(pages.select(F.col(key).alias("_key"), "url"), "_hp", F.struct(host.alias("h"), path.alias("p"))).select("_key", "_hp.h", "_hp.p")
    table = rules.select("action", ascii_lower(F.col("rule_host")).alias("rh"), F.col("rule_path").alias("rp"))
    labels = F.size(F.split("rh", r"\."))
    shape = table.agg(F.array_sort(F.collect_set(labels)).alias("labels"), F.array_sort(F.collect_set(F.length("rp"))).alias("lengths")).first()
    counts, lengths = shape["labels"] or [], shape["lengths"] or []  # as many numbers as a host has labels, a path characters
    digest = lambda a, b: F.sha2(F.concat(a, b).cast("binary"), 256)

    parts = F.size(F.split("h", r"\."))
    present = lambda cells: F.filter(F.array(*cells).cast("array<string>"), lambda x: x.isNotNull())
    suffixes = present([F.when(parts >= n, F.substring_index("h", ".", -n)) for n in counts])
    prefixes = present([F.when(F.length("p") >= n, F.left("p", F.lit(n))) for n in lengths])
    spelt = (
        parsed.select("h", "p")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("full", digest(F.col("suffix"), F.col("prefix")))
        .select("h", "p", "full", F.left("full", F.lit(SHORT)).alias("short"))
    )
    known = table.withColumn("rfull", digest(F.col("rh"), F.col("rp"))).withColumn("rshort", F.left("rfull", F.lit(SHORT)))
    hits = spelt.join(known, spelt["short"] == known["rshort"]).filter("full = rfull")
    order = F.struct(F.length(F.concat("rh", "rp")), F.length("rh"), "action", F.concat("rh", "rp").alias("rule"))
    best = hits.groupBy("h", "p").agg(F.max(order).alias("best")).select(F.col("h").alias("_h"), F.col("p").alias("_p"), "best.rule", "best.action")
    joined = parsed.join(best, (F.col("h") == F.col("_h")) & (F.col("p") == F.col("_p")), "left")
    return joined.select(
        F.col("_key").alias(key), F.col("h").alias("host"), F.col("p").alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )


def oracle(rules: list[tuple[str, str]], table: str = "pages", key: str = "page_id", default: str = "allow") -> str:
    """The rows of ``judge`` in DuckDB."""
    values = ", ".join(f"('{a}', '{r.partition('/')[0]}', '{'/' + r.partition('/')[2] if '/' in r else ''}')" for a, r in rules)
    return rf"""
WITH r(action, rh, rp) AS (VALUES {values}),
u AS (SELECT row_number() OVER () rid, {key}, coalesce(url, '') url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM {table}),
s AS (SELECT rid, {key}, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path FROM u),
best AS (SELECT rid, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) rule, arg_max(action, length(rh || rp) * 1000 + length(rh)) action
  FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT {key}, host, path, rule, coalesce(action, '{default}') verdict FROM s LEFT JOIN best USING (rid)
"""
