"""Queries over the sources and sinks, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.plans.registry import query, with_views
from ringsight.sources import readers, sinks
from ringsight.sources import tables as t


@query(
    "image_stream_split",
    """WITH d AS (SELECT doc_id, doc_id // 10 AS stream, octet_length(encode(text)) + 4 AS n_bytes FROM documents)
    SELECT stream, row_number() OVER w - 1 AS image_no, CAST(sum(n_bytes + 3) OVER w AS BIGINT) - n_bytes AS offset, n_bytes, false AS truncated
    FROM d WINDOW w AS (PARTITION BY stream ORDER BY doc_id)""",
)
def image_stream_split(spark, sf):
    """Ten documents per stream, each between image markers with three stray bytes ahead of it."""
    d = t.table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 10").alias("stream"), F.encode("text", "UTF-8").alias("raw"))
    mark = lambda h: F.unhex(F.lit(h))
    image = F.concat(mark("000102"), mark("FFD8"), F.col("raw"), mark("FFD9"))
    streams = d.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("doc_id", image.alias("b")))).alias("l"))  # ten rows each
    joined = F.aggregate("l", F.lit(b""), lambda acc, s: F.concat(acc, s["b"]))
    out = readers.split_images(streams.select("stream", joined.alias("content")), "stream", "content")
    return out.select(F.col("path").alias("stream"), "image_no", "offset", F.octet_length("image").cast("bigint").alias("n_bytes"), "truncated")


@query(
    "slot_table",
    """SELECT event_id AS slot, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS peak, round(event_id * 0.8::DOUBLE, 6) AS t_wall,
      event_type AS status FROM events""",
)
def slot_table(spark, sf):
    """Slot rows through their CSV text."""
    e = t.table(spark, sf, "events")
    peak = F.when(F.col("event_id") % 9 == 0, "NaN").otherwise(F.col("value").cast("string"))
    text = F.concat_ws(",", F.col("event_id").cast("string"), F.col("event_type"), peak)
    rows = e.select(F.from_csv(text, "slot bigint, status string, peak double").alias("r")).select("r.*")
    return readers.typed_slots(rows).select("slot", "peak", F.round("t_wall", 6).alias("t_wall"), "status")


@query(
    "bundle_check",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 10 = 0 THEN 'format' END, CASE WHEN p_size > 30 THEN 'pitch' END,
      CASE WHEN NOT (abs(p_retailprice / 10000) BETWEEN 0.05 AND 0.20) THEN 'slope_left' END) AS problems FROM part""",
)
def bundle_check(spark, sf):
    rules = F.struct(
        F.when(F.col("p_size") % 10 == 0, 1).otherwise(2).alias("format"), F.lit(2).alias("expected_format"),
        (F.lit(16097) + F.when(F.col("p_size") > 30, 100).otherwise(0)).alias("loop_cols"), F.lit(100).alias("elements"),
        F.lit(160.97).alias("pitch"), (F.col("p_retailprice") / 10000).alias("slope_left"), F.lit(0.1).alias("slope_right"),
    )
    return t.table(spark, sf, "part").select("p_partkey", F.array_join(readers.bundle_problems(rules), ",").alias("problems"))


@query(
    "manifest_verification",
    """SELECT doc_id AS name, CASE WHEN doc_id % 40 = 1 THEN 'unlisted' WHEN doc_id % 40 = 2 THEN 'missing'
      WHEN doc_id % 40 = 3 THEN 'changed' ELSE 'ok' END AS status FROM documents""",
)
def manifest_verification(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 40
    manifest = d.filter(k != 1).select(F.concat_ws("  ", F.sha2("text", 256), F.col("doc_id").cast("string")).alias("value"))
    content = F.when(k == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    files = d.filter(k != 2).select(F.col("doc_id").cast("string").alias("name"), content.alias("content"))
    out = readers.verify_manifest(manifest, files)
    return out.select(F.col("name").cast("bigint").alias("name"), "status")


@query(
    "version_text",
    "SELECT doc_id, substr(sha256(text), 1, 8) || '+' || source || '+' || lang AS version FROM documents",
)
def version_text(spark, sf):
    v = readers.version_text(F.sha2("text", 256), F.col("source"), F.col("lang"))
    return t.table(spark, sf, "documents").select("doc_id", v.alias("version"))


@query(
    "settings_scan",
    """WITH s AS (SELECT event_id, user_id % 24 AS g, CAST(props->>'k' AS BIGINT) % 8 AS m, event_id % 13 = 0 AS broken FROM events)
    SELECT event_id, CASE WHEN NOT broken AND g BETWEEN 2 AND 20 AND m BETWEEN 1 AND 6 AND m <= g THEN g ELSE 4 END AS gap,
      CASE WHEN NOT broken AND g BETWEEN 2 AND 20 AND m BETWEEN 1 AND 6 AND m <= g THEN m ELSE 3 END AS spacing FROM s""",
)
def settings_scan(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint") % 8
    good = F.format_string('{"wheel_max_gap_godets": %d, "wheel_min_spacing_godets": %d}', F.col("user_id") % 24, k)
    text = F.when(F.col("event_id") % 13 == 0, F.lit('{"wheel_max_gap_godets": 5')).otherwise(good)
    s = readers.parse_settings(text)
    return t.table(spark, sf, "events").select("event_id", s["gap"].cast("bigint").alias("gap"), s["spacing"].cast("bigint").alias("spacing"))


@query(
    "snapshot_restore",
    """WITH l AS (SELECT user_id, max(event_id) AS saved_no, arg_max(value, event_id) AS state, arg_max(event_id % 3, event_id) AS v FROM events GROUP BY 1)
    SELECT user_id, saved_no, state FROM l WHERE v = 1""",
)
def snapshot_restore(spark, sf):
    snaps = t.table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("saved_no"), F.col("value").alias("state"),
        F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"),
    )
    return readers.restore_latest(snaps, ["user_id"], "saved_no", "v1").select("user_id", "saved_no", "state")


@query(
    "schema_migration",
    """SELECT o_orderkey AS alert_id, o_custkey AS event_key, CAST(o_totalprice AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS confidence,
      CAST(NULL AS VARCHAR) AS rule_id FROM orders""",
)
def schema_migration(spark, sf):
    old = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("id"), F.col("o_custkey").alias("event_key"), F.col("o_totalprice").alias("amount")
    )
    return sinks.migrate(old, "alert_id bigint, event_key bigint, amount double, confidence double, rule_id string", {"id": "alert_id"})


@query(
    "duplicate_event_keys",
    with_views(t.ALERTS) + "SELECT event_key, count(*) AS n FROM alerts GROUP BY event_key HAVING count(*) > 1",
)
def duplicate_event_keys(spark, sf):
    return sinks.duplicate_keys(t.alerts(spark, sf), "event_key")
